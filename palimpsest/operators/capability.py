"""Capability tokens: what a chain of delegations lets a request do.

A token is a block with a parent; the chain ends at a root block, which has no parent and allows all. Each block may restrict the
action, role, resource, tenant and handoff of requests, and the time; a request passes if every block of its chain lets it, so a
delegation can only narrow what it was given. Chains are resolved by frontier joins, one link of all open requests at a time; requests that
failed, or reached their root, leave the frontier. A chain that breaks off, or is longer than DEPTH, was not signed by a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import refusal
from .shared import written

DEPTH = 64
#: What a request states and a block may pin, and the name of its refusal, in the order in which they are told.
PINNED = ("action", "to_role", "resource", "tenant", "handoff_id")


def authorised(requests: DataFrame, blocks: DataFrame, revoked: DataFrame) -> DataFrame:
    """requests (request_id, token, at, and requested_ each of PINNED), blocks (token, parent, expires, and each of PINNED; null pins
    nothing), revoked (handoff_id) -> request_id, verdict, links.

    Verdicts: malformed (a requested field or the token is null), signature (no chain to a root), revoked, then the first of PINNED that a
    block of the chain does not allow, expired, granted. A revoked request is told so before the chain's checks. Blocks that share a token
    are no chain: the smallest parent counts."""
    c = F.col
    asked = [f"requested_{p}" for p in PINNED]
    whole = requests.select("request_id", "token", "at", *asked).withColumn("whole", c("token").isNotNull() & ~F.exists(F.array(*[c(a).isNull() for a in asked]), lambda x: x))
    gone = revoked.select(c("handoff_id").alias("requested_handoff_id"), F.lit(True).alias("gone")).distinct()
    link = blocks.filter("token IS NOT NULL").groupBy("token").agg(F.min_by(F.struct("parent", "expires", *PINNED), F.struct(c("parent").isNotNull(), "parent")).alias("b"))
    faults = [F.when(c(f"b.{p}").isNotNull() & (c(f"b.{p}") != c(f"requested_{p}")), i) for i, p in enumerate(PINNED)] + [F.when(c("b.expires").isNotNull() & (c("at") >= c("b.expires")), len(PINNED))]
    frontier = written(whole.filter("whole").withColumns({"links": F.lit(0), "fault": F.lit(len(PINNED) + 1)}), "requests")
    ended = []
    for _ in range(DEPTH):
        step = frontier.join(link, "token", "left").withColumn("links", c("links") + c("b").isNotNull().cast("int"))
        step = step.withColumn("fault", F.least("fault", *faults)).withColumn("state", F.when(c("b").isNull(), "broken").when(c("b.parent").isNull(), "root").otherwise("open"))
        now = written(step.select("request_id", c("b.parent").alias("token"), "at", *asked, "whole", "links", "fault", "state"), "requests")
        ended.append(now.filter("state <> 'open'"))
        frontier = now.filter("state = 'open'").drop("state")
        if not frontier.limit(1).count():
            break
    else:
        ended.append(frontier.withColumn("state", F.lit("broken")))
    found = ended[0]
    for e in ended[1:]:
        found = found.unionByName(e)
    told = F.get(F.array(*[F.lit(p) for p in PINNED], F.lit("expired"), F.lit("granted")), c("fault"))
    out = found.join(gone, "requested_handoff_id", "left")
    verdict = F.coalesce(refusal((c("state") == "broken", "signature"), (F.coalesce(c("gone"), F.lit(False)), "revoked")), told)
    return out.select("request_id", verdict.alias("verdict"), "links").unionByName(whole.filter("NOT whole").select("request_id", F.lit("malformed").alias("verdict"), F.lit(0).alias("links")))
