"""Queries of capability tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import capability as C
from ..sources import adapters as A

#: Each user has a chain of one to four blocks; the last is the handoff's, those between narrow one thing each.
_BLOCK = {
    "action": "CASE WHEN k = user_id % 4 AND k > 0 THEN 'read' END", "to_role": "CASE WHEN k = 3 OR k = user_id % 4 AND k > 0 THEN 'decider' END", "resource": "CASE WHEN k = 1 THEN concat('handoffs/', user_id) END", "tenant": "CASE WHEN k = 2 THEN 'bench' END",
    "handoff_id": "CASE WHEN k = user_id % 4 AND k > 0 THEN concat('h', user_id) END", "expires": "CASE WHEN k = 1 THEN 1705000000000000 END",
}
_TOKEN, _PARENT = "concat('t', user_id, '-', k)", "CASE WHEN k > 0 THEN concat('t', user_id, '-', k - 1) WHEN user_id % 13 = 5 THEN 'unknown' END"
_ASKED = {
    "action": "CASE WHEN event_id % 11 = 1 THEN 'write' ELSE 'read' END", "to_role": "CASE WHEN event_id % 11 = 2 THEN 'analyst' ELSE 'decider' END", "resource": "CASE WHEN event_id % 11 = 3 THEN 'handoffs/0' ELSE concat('handoffs/', user_id) END",
    "tenant": "CASE WHEN event_id % 11 = 4 THEN 'other' WHEN event_id % 11 = 5 THEN NULL ELSE 'bench' END", "handoff_id": "CASE WHEN event_id % 11 = 6 THEN 'h0' ELSE concat('h', user_id) END",
}


@query(
    "H68_delegation_chains",
    f"""WITH RECURSIVE {A.EV_STREAM}, users AS (SELECT DISTINCT user_id FROM events), ks AS (SELECT user_id, unnest(range(user_id % 4 + 1)) AS k FROM users),
blocks AS (SELECT {_TOKEN} AS token, {_PARENT} AS parent, {', '.join(f'{v} AS {n}' for n, v in _BLOCK.items())} FROM ks),
asked AS (SELECT event_id AS request_id, concat('t', user_id, '-', user_id % 4) AS token, timestamp_us AS when_us, {', '.join(f'{v} AS requested_{n}' for n, v in _ASKED.items())} FROM ev_stream),
good AS (SELECT * FROM asked WHERE requested_tenant IS NOT NULL),
r AS (SELECT request_id, token, when_us, {', '.join(f'requested_{p}' for p in C.PINNED)}, 0 AS links, 6 AS fault, 'open' AS state FROM good
  UNION ALL SELECT request_id, b.parent, when_us, {', '.join(f'requested_{p}' for p in C.PINNED)}, links + (b.token IS NOT NULL)::INT, least(fault, {', '.join(f'CASE WHEN b.{p} <> requested_{p} THEN {i} ELSE 9 END' for i, p in enumerate(C.PINNED))}, CASE WHEN when_us >= b.expires THEN 5 ELSE 9 END),
  CASE WHEN b.token IS NULL THEN 'broken' WHEN b.parent IS NULL THEN 'root' ELSE 'open' END FROM r LEFT JOIN blocks b ON b.token = r.token WHERE state = 'open')
SELECT request_id, CASE WHEN state = 'broken' THEN 'signature' WHEN requested_handoff_id IN (SELECT concat('h', user_id) FROM users WHERE user_id % 7 = 3) THEN 'revoked' ELSE ['action', 'to_role', 'resource', 'tenant', 'handoff_id', 'expired', 'granted'][fault + 1] END AS verdict, links FROM r WHERE state <> 'open'
UNION ALL SELECT request_id, 'malformed', 0 FROM asked WHERE requested_tenant IS NULL""",
)
def delegation_chains(spark, sf):
    """Users' events as requests, their tokens as chains of delegations."""
    users = A.table(spark, sf, "events").select("user_id").distinct()
    blocks = users.withColumn("k", F.expr("explode(sequence(0L, user_id % 4))")).selectExpr(f"{_TOKEN} AS token", f"{_PARENT} AS parent", *[f"{v} AS {n}" for n, v in _BLOCK.items()])
    requests = A.ev_stream(spark, sf).selectExpr("event_id AS request_id", "concat('t', user_id, '-', user_id % 4) AS token", "timestamp_us AS at", *[f"{v} AS requested_{n}" for n, v in _ASKED.items()])
    return C.authorised(requests, blocks, users.filter("user_id % 7 = 3").select(F.concat(F.lit("h"), "user_id").alias("handoff_id")))
