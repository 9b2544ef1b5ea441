"""Certificates, compatibility and the decision gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(certificates: DataFrame) -> DataFrame:
    """The newest certificate of each checkpoint; of equally new ones the one that was issued first. One aggregation, no sort."""
    best = F.min_by(F.struct("*"), F.struct((-F.col("created_us")).alias("age"), "issued"))
    return certificates.groupBy("checkpoint_hash").agg(best.alias("c")).select("c.*")


def valid_signatures(signatures: Column, allowed: list[str]) -> Column:
    """How many have an allowed algorithm; an empty list allows all."""
    return F.size(F.filter(signatures, lambda s: s.isin(allowed))) if allowed else F.size(signatures)


def refusal(*ladder: tuple[Column, str]) -> Column:
    """The first reason whose condition holds, or null."""
    return F.coalesce(*[F.when(c, r) for c, r in ladder])


ZERO = "0" * 64
REPLAY_SAFE = "fp16"


def incompatible() -> Column:
    """The first mismatch of a manifest and a request (columns of one row), or null: identity, model, artifact, class if one is
    asked for, architecture, and the stored type if the request must replay exactly."""
    c = F.col
    return refusal(
        ((c("tenant_id") != c("want_tenant")) | (c("session_id") != c("want_session")) | (c("branch_id") != c("want_branch")), "identity"), (c("model_id") != c("want_model"), "model"),
        (~c("artifact_hash").rlike("^[0-9a-f]{64}$"), "malformed_artifact"), (c("artifact_hash") != c("want_artifact"), "artifact"), ((c("want_class") != "") & (c("model_class") != c("want_class")), "class"),
        (c("architecture_tag") != c("want_arch"), "architecture"), (c("replay_safe") & (c("kv_dtype") != REPLAY_SAFE), "dtype"),
    )


def thaw_fault(expected: Column, actual: Column) -> Column:
    """missing if either digest is unset, mismatch if they differ, else null."""
    return refusal(((expected == ZERO) | (actual == ZERO), "missing"), (expected != actual, "mismatch"))


def blocked(corrections: DataFrame) -> DataFrame:
    """hash -> how many corrections name the checkpoint, as target or among the invalidated, how many of them block, and
    whether one of these must interrupt."""
    m = corrections.select("user_id", "w", "severity", "interrupts", F.explode(F.array_union(F.array("target"), "invalidated")).alias("hash"))
    blocking = F.col("severity") == "blocking"
    return m.groupBy("hash").agg(F.count("*").alias("corrections"), F.count_if(blocking).alias("blocking"), F.coalesce(F.bool_or(blocking & F.col("interrupts")), F.lit(False)).alias("interrupt"))


def gated(checkpoints: DataFrame, corrections: DataFrame, certificates: DataFrame, *, drift: float, signatures: int, allowed: list[str]) -> DataFrame:
    """checkpoints with reason: why one may not be used, the first refusal, or accepted; and interrupt."""
    l = certificates.groupBy(F.col("checkpoint_hash").alias("hash")).agg(F.min_by(F.struct("verdict", "covered_start", "covered_end", "drift_score", "signatures"), F.struct((-F.col("created_us")).alias("age"), "issued")).alias("l"))
    rows = checkpoints.join(blocked(corrections), "hash", "left").join(l, "hash", "left")
    c = F.col
    ladder = refusal(
        (incompatible().isNotNull(), "incompatible"), (thaw_fault(c("expected_digest"), c("actual_digest")).isNotNull(), "thaw"), (c("blocking") > 0, "blocking_correction"), (c("l").isNull(), "no_certificate"),
        (c("l.verdict") == "pending", "pending"), (c("l.verdict") != "pass", "not_pass"), ((c("l.covered_start") > c("range_start")) | (c("l.covered_end") < c("range_end")), "range"), (c("l.drift_score") > drift, "drift"),
        (valid_signatures(c("l.signatures"), allowed) < signatures, "signatures"),
    )
    return rows.withColumn("reason", F.coalesce(ladder, F.lit("accepted"))).withColumn("interrupt", F.coalesce("interrupt", F.lit(False)))
