"""Replay audit: stored projections are made again from the raw log, compared, certified, and corrected where they drifted.

One plan for any number of checkpoints: integrity of manifest and payload, a projection of each checkpoint's events, a certificate for
each that could be audited, and for each that drifted a blocking correction with the closure of what was built on it. What is not whole
gets an error and no certificate.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec as K
from . import graph
from . import projection as P
from .audit import refusal
from .shared import written


@dataclass(frozen=True)
class Auditor:
    projection: P.Config
    artifact_hash: str
    model_id: str
    policy: str
    branch_id: str = "main"


@dataclass
class Audit:
    """results: a row for each checkpoint, with verdict or error. certificates: the canonical bytes too. corrections: with
    invalidates, sorted. nodes: the certificates as nodes of provenance, child of their checkpoint."""

    results: DataFrame
    certificates: DataFrame
    corrections: DataFrame
    nodes: DataFrame


def _manifests(batches):
    for b in batches:
        rows = []
        for h, data in zip(b["hash"], b["data"]):
            f, error = K.decoded(bytes(data), K.MANIFEST)
            rows.append((h, error, f.get("tenant_id"), f.get("session_id"), f.get("body_hash"), f.get("range_start"), f.get("range_end") or f.get("base_event_index")))
        yield pd.DataFrame(rows, columns=["hash", "decode_error", "tenant_id", "session_id", "manifest_body", "range_start", "range_end"]).astype({"range_start": "Int64", "range_end": "Int64"})


def whole(store: DataFrame, log: DataFrame) -> DataFrame:
    """store (hash, digest and data of the manifest, body_hash that it is filed under, body, created_us) with the manifest's own fields, the
    log's length and fault: the first of manifest bytes, body hash, manifest hash, payload missing, payload hash, event range."""
    read = store.select("hash", "data").mapInPandas(_manifests, "hash string, decode_error string, tenant_id string, session_id string, manifest_body string, range_start long, range_end long")
    lengths = log.groupBy("session_id").agg(F.count("*").alias("generation"))
    rows = store.join(read, "hash").join(lengths, "session_id", "left").withColumn("generation", F.coalesce("generation", F.lit(0)))
    c = F.col
    fault = refusal(
        (c("decode_error") != "", "manifest bytes"), (c("manifest_body") != c("body_hash"), "manifest body hash"), (F.sha2("data", 256) != c("digest"), "manifest hash"), (c("body").isNull(), "payload missing"),
        (F.sha2("body", 256) != c("body_hash"), "payload hash"), ((c("range_end") <= c("range_start")) | (c("range_end") > c("generation")), "event range"),
    )
    return rows.withColumn("fault", fault)


def replayed(rows: DataFrame, log: DataFrame, runner: P.Runner, config: P.Config) -> DataFrame:
    """rows (hash, session_id, range_start, range_end) -> hash, replay, replay_error: each range of events projected again."""
    events = log.join(rows.select("hash", "session_id", "range_start", "range_end"), "session_id").filter("event_index >= range_start AND event_index < range_end")
    asked = P.prompts(events, None, ["hash"], config).withColumn("attempt", F.lit(0))
    answers = P.checked(runner(asked.filter("error IS NULL").drop("error")), config).select("hash", F.col("canonical").alias("replay"), F.concat(F.lit("projection replay failed: "), "error").alias("replay_error"))
    return answers.unionByName(asked.filter("error IS NOT NULL").select("hash", F.lit(None).cast("string").alias("replay"), F.concat(F.lit("projection replay failed: "), "error").alias("replay_error")))


def drifted_fields(one: Column, two: Column) -> Column:
    """Which of a projection's three lists differ; an unreadable side differs in all."""
    lists = lambda c: F.from_json(c, ", ".join(f"{f} ARRAY<STRING>" for f in P.FIELDS))
    differs = lambda f: F.when(lists(one)[f].isNull() | lists(two)[f].isNull() | (lists(one)[f] != lists(two)[f]), F.lit(f))
    return F.array_compact(F.array(*[differs(f) for f in P.FIELDS]))


def audit(store: DataFrame, log: DataFrame, edges: DataFrame, runner: P.Runner, by: Auditor) -> Audit:
    """edges (src, dst): dst was built on src."""
    rows = whole(store, log)
    sound = written(rows.filter("fault IS NULL").drop("data", "digest", "decode_error", "manifest_body"), "sound")
    again = sound.join(replayed(sound, log, runner, by.projection), "hash", "left")
    body = F.coalesce("replay_error", "replay")
    matched = F.col("replay_error").isNull() & (F.sha2("replay", 256) == F.col("body_hash"))
    correction = F.concat(F.lit("corr-"), F.substring(F.sha2(F.concat_ws(":", F.lit("correction"), "hash", F.sha2(body, 256), "created_us"), 256), 1, 32))
    again = again.withColumn("matched", matched).withColumn("correction_id", F.when(~F.col("matched"), correction)).withColumn("structured", F.size(drifted_fields(F.col("body"), F.coalesce("replay", F.lit("")))) / len(P.FIELDS))
    none = F.array().cast("array<string>")
    bound = again.select(
        F.col("hash").alias("checkpoint_manifest_hash"), F.col("body_hash").alias("checkpoint_body_hash"), "tenant_id", "session_id", F.lit(by.branch_id).alias("branch_id"), F.col("range_start").alias("event_range_start"), F.col("range_end").alias("event_range_end"),
        F.col("generation").alias("log_generation"), F.lit(by.projection.schema_id).alias("schema_id"), F.lit(by.artifact_hash).alias("model_artifact_hash"), F.lit(by.projection.model_id).alias("projection_model_id"), F.lit(by.model_id).alias("auditor_model_id"),
        F.lit(by.policy).alias("audit_policy_version"), F.when(F.col("matched"), "pass").otherwise("correction_emitted").alias("verdict"), F.when(F.col("matched"), 0.0).otherwise(1.0).alias("drift_score"),
        F.when(F.col("matched"), none).when(F.col("replay_error").isNull(), F.array(F.lit("projected_memory_hash"))).otherwise(F.array(F.lit("projection_replay_error"))).alias("drift_fields"), F.when(F.col("matched"), none).otherwise(F.array("correction_id")).alias("correction_event_ids"),
        F.col("hash").alias("provenance_root_hash"), F.col("created_us").alias("created_unix_micros"), F.lit(0).cast("long").alias("expires_unix_micros"), body.alias("replacement"), "replay_error", "structured",
    )
    certificates = written(bound.withColumn("canonical", K.certificate()).withColumn("certificate_id", F.sha2("canonical", 256)), "certificates")
    emitted = certificates.filter("verdict = 'correction_emitted'")
    seeds = emitted.select(F.col("checkpoint_manifest_hash").alias("seed"), F.col("checkpoint_manifest_hash").alias("node"))
    closed = graph.reachable(edges, seeds).groupBy("seed").agg(F.array_sort(F.collect_set("node")).alias("invalidates"))
    corrections = emitted.join(closed, emitted["checkpoint_manifest_hash"] == closed["seed"]).select(
        F.get("correction_event_ids", F.lit(0)).alias("correction_id"), F.col("checkpoint_manifest_hash").alias("target"), "event_range_start", "event_range_end", F.col("certificate_id").alias("audit_certificate_id"), F.lit("projection_replay_mismatch").alias("reason_code"),
        F.lit("blocking").alias("severity"), "drift_fields", "invalidates", F.col("replacement").alias("replacement_projection"),
        F.coalesce("replay_error", F.lit("Replay produced a different projected-memory body; the stale checkpoint must not be used for the next decision.")).alias("correction_text"), F.lit(True).alias("must_interrupt"), "created_unix_micros",
    )
    said = certificates.select("checkpoint_manifest_hash", "verdict", "drift_score", "structured", "certificate_id", F.get("correction_event_ids", F.lit(0)).alias("correction_id"), F.lit(None).cast("string").alias("error")).withColumnRenamed("checkpoint_manifest_hash", "hash")
    lost = rows.filter("fault IS NOT NULL").select("hash", *[F.lit(None).cast(k).alias(c) for c, k in said.dtypes[1:-1]], F.col("fault").alias("error"))
    note = F.concat(F.lit("audit_certificate;checkpoint_manifest_hash="), "checkpoint_manifest_hash", F.lit(";verdict="), "verdict", F.lit(";policy="), "audit_policy_version")
    nodes = certificates.select(F.col("certificate_id").alias("hash"), F.array("checkpoint_manifest_hash").alias("parent_hashes"), F.col("created_unix_micros").alias("created_us"), note.alias("annotations"))
    return Audit(said.unionByName(lost), certificates, corrections, nodes)
