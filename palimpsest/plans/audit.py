"""Queries over certificates and the decision gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import audit as U
from ..sources import adapters as A

W = f"WITH {A.CERT}"
_LATEST = "latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY checkpoint_hash ORDER BY created_us DESC, issued) AS r FROM cert) WHERE r = 1)"


@query("A19_ledger_list", f"{W} SELECT session_id, count(*) AS certificates, count(DISTINCT checkpoint_hash) AS checkpoints, min(certificate_id) AS first FROM cert GROUP BY session_id")
def ledger_list(spark, sf):
    return A.cert(spark, sf).groupBy("session_id").agg(F.count("*").alias("certificates"), F.count_distinct("checkpoint_hash").alias("checkpoints"), F.min("certificate_id").alias("first"))


#: Certificates with fields that may be missing, and one rule for each.
_CERTIFIED = [
    "certificate_id", f"CASE WHEN covered_start % 56 = 8 THEN '{A.ZERO}' ELSE checkpoint_hash END AS manifest_hash", f"CASE WHEN covered_start % 56 = 16 THEN '{A.ZERO}' ELSE reverse(checkpoint_hash) END AS body_hash", "tenant_id", "session_id",
    "CASE WHEN covered_start % 56 = 24 THEN '' ELSE 'main' END AS branch_id", "covered_start", "CASE WHEN covered_start % 56 = 32 THEN covered_start - 1 ELSE covered_end END AS covered_end",
    "CASE WHEN issued = 2 AND covered_start % 72 = 0 THEN '' ELSE 'schema-1' END AS schema_id", f"CASE WHEN covered_start % 88 = 40 THEN '{A.ZERO}' ELSE reverse(certificate_id) END AS artifact_hash", "'p' AS projection_model",
    "CASE WHEN issued = 2 AND covered_start % 48 = 24 THEN '' ELSE 'a' END AS auditor_model", "'policy-1' AS policy", "CASE WHEN covered_start % 40 = 0 THEN CAST('nan' AS DOUBLE) WHEN covered_start % 40 = 8 THEN 1.5 ELSE drift_score END AS drift",
    "CASE WHEN covered_start % 104 = 48 THEN 0 ELSE created_us END AS created_us",
]


@query(
    "B8_certificate_validity",
    f"""{W}, c AS (SELECT {', '.join(_CERTIFIED)} FROM cert) SELECT certificate_id, CASE WHEN manifest_hash = '{A.ZERO}' THEN 'manifest_hash' WHEN body_hash = '{A.ZERO}' THEN 'body_hash' WHEN tenant_id = '' OR session_id = '' OR branch_id = '' THEN 'identity'
  WHEN covered_end < covered_start THEN 'range' WHEN schema_id = '' OR artifact_hash = '{A.ZERO}' OR projection_model = '' OR auditor_model = '' OR policy = '' THEN 'binding' WHEN isnan(drift) OR drift < 0 OR drift > 1 THEN 'drift' WHEN created_us <= 0 THEN 'created' ELSE 'ok' END AS fault FROM c""",
)
def certificate_validity(spark, sf):
    c, col = A.cert(spark, sf).selectExpr(*_CERTIFIED), F.col
    empty = lambda *names: F.least(*[F.length(n) for n in names]) == 0
    fault = U.refusal(
        (col("manifest_hash") == U.ZERO, "manifest_hash"), (col("body_hash") == U.ZERO, "body_hash"), (empty("tenant_id", "session_id", "branch_id"), "identity"), (col("covered_end") < col("covered_start"), "range"),
        (empty("schema_id", "projection_model", "auditor_model", "policy") | (col("artifact_hash") == U.ZERO), "binding"), (F.isnan("drift") | ~col("drift").between(0, 1), "drift"), (col("created_us") <= 0, "created"),
    )
    return c.select("certificate_id", F.coalesce(fault, F.lit("ok")).alias("fault"))


_ABI = f"WITH {A.CKPT}, {A.ABI}"
_COMPAT = "CASE WHEN tenant_id <> want_tenant OR session_id <> want_session OR branch_id <> want_branch THEN 'identity' WHEN model_id <> want_model THEN 'model' WHEN NOT regexp_full_match(artifact_hash, '[0-9a-f]{64}') THEN 'malformed_artifact' WHEN artifact_hash <> want_artifact THEN 'artifact' WHEN want_class <> '' AND model_class <> want_class THEN 'class' WHEN architecture_tag <> want_arch THEN 'architecture' WHEN replay_safe AND kv_dtype <> 'fp16' THEN 'dtype' ELSE 'ok' END"
_THAW = f"CASE WHEN expected_digest = '{A.ZERO}' OR actual_digest = '{A.ZERO}' THEN 'missing' WHEN expected_digest <> actual_digest THEN 'mismatch' ELSE 'ok' END"


@query("B9_compatibility", f"{_ABI} SELECT hash, {_COMPAT} AS reason FROM abi")
def compatibility(spark, sf):
    """First failing check of a request against a manifest."""
    return A.abi(spark, sf).select("hash", F.coalesce(U.incompatible(), F.lit("ok")).alias("reason"))


@query("B10_thaw_verification", f"{_ABI} SELECT hash, {_THAW} AS thaw FROM abi")
def thaw_verification(spark, sf):
    return A.abi(spark, sf).select("hash", F.coalesce(U.thaw_fault(F.col("expected_digest"), F.col("actual_digest")), F.lit("ok")).alias("thaw"))


@query("B11_storage_tiers", f"{_ABI} SELECT hash, CASE WHEN metadata_tier <> 'memorydb_metadata' THEN 'metadata_tier' WHEN blob_tier = 'memorydb_metadata' THEN 'blob_tier' WHEN metadata_uri = '' THEN 'metadata_uri' WHEN blob_uri = '' THEN 'blob_uri' ELSE 'ok' END AS fault FROM abi")
def storage_tiers(spark, sf):
    """Metadata lives in the hot tier and blobs do not; both have a place."""
    c = F.col
    fault = U.refusal((c("metadata_tier") != "memorydb_metadata", "metadata_tier"), (c("blob_tier") == "memorydb_metadata", "blob_tier"), (c("metadata_uri") == "", "metadata_uri"), (c("blob_uri") == "", "blob_uri"))
    return A.abi(spark, sf).select("hash", F.coalesce(fault, F.lit("ok")).alias("fault"))


@query("B12_transport_tier", f"{_ABI} SELECT hash, CASE WHEN rack_local AND rdma_available AND NOT cross_az THEN 'rdma_roce' ELSE 'grpc_flatbuffers' END AS transport FROM abi")
def transport_tier(spark, sf):
    near = F.col("rack_local") & F.col("rdma_available") & ~F.col("cross_az")
    return A.abi(spark, sf).select("hash", F.when(near, "rdma_roce").otherwise("grpc_flatbuffers").alias("transport"))


@query("B13_dtype_policy", f"{_ABI} SELECT hash, CASE WHEN replay_safe THEN 'fp16' ELSE approved_dtype END AS picked, NOT replay_safe OR kv_dtype = 'fp16' AS allowed FROM abi")
def dtype_policy(spark, sf):
    """What to store under a policy, and whether what is stored satisfies it: only one type replays exactly."""
    return A.abi(spark, sf).select("hash", F.when(F.col("replay_safe"), U.REPLAY_SAFE).otherwise(F.col("approved_dtype")).alias("picked"), (~F.col("replay_safe") | (F.col("kv_dtype") == U.REPLAY_SAFE)).alias("allowed"))


_MENTIONED = "mentioned AS (SELECT hash, count(*) AS corrections, count(*) FILTER (severity = 'blocking') AS blocking, bool_or(severity = 'blocking' AND interrupts) AS interrupt FROM (SELECT severity, interrupts, unnest(list_distinct(list_concat([target], invalidated))) AS hash FROM cor) GROUP BY hash)"


@query("C2_mentioned_checkpoints", f"WITH {A.CKPT}, {A.CHECKPOINT_CORRECTIONS}, {_MENTIONED} SELECT c.hash, corrections, blocking, interrupt FROM ckpt c JOIN mentioned m ON m.hash = c.hash")
def mentioned_checkpoints(spark, sf):
    """How many corrections name a checkpoint, how many of them block it, and whether the next step must be interrupted."""
    return A.ckpt(spark, sf).select("hash").join(U.blocked(A.checkpoint_corrections(spark, sf)), "hash")


@query("C3_latest_certificate", f"{W}, {_LATEST} SELECT checkpoint_hash, certificate_id, verdict, drift_score, created_us FROM latest")
def latest_certificate(spark, sf):
    return U.latest(A.cert(spark, sf)).select("checkpoint_hash", "certificate_id", "verdict", "drift_score", "created_us")


@query("F3_latest_tie", f"{W}, n AS (SELECT *, rank() OVER (PARTITION BY checkpoint_hash ORDER BY created_us DESC) AS r FROM cert), t AS (SELECT checkpoint_hash, count(*) AS tied, min(issued) AS issued FROM n WHERE r = 1 GROUP BY checkpoint_hash) SELECT checkpoint_hash, issued, tied FROM t WHERE tied > 1")
def latest_tie(spark, sf):
    """Where several certificates are equally new, the one seen first stays the latest."""
    newest = A.cert(spark, sf).groupBy("checkpoint_hash", "created_us").agg(F.count("*").alias("tied")).groupBy("checkpoint_hash").agg(F.max_by("tied", "created_us").alias("tied"))
    return U.latest(A.cert(spark, sf)).select("checkpoint_hash", "issued").join(newest, "checkpoint_hash").filter("tied > 1")


@query("C4_without_audit", f"{W}, {_LATEST} SELECT c.hash FROM ckpt c WHERE c.level = 0 AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.checkpoint_hash = c.hash AND l.verdict = 'pass' AND l.drift_score <= 0.3)")
def without_audit(spark, sf):
    good = U.latest(A.cert(spark, sf)).filter("verdict = 'pass' AND drift_score <= 0.3D").select(F.col("checkpoint_hash").alias("hash"))
    return A.ckpt(spark, sf).filter("level = 0").select("hash").join(good, "hash", "left_anti")


@query("C8_range_covered", f"{W} SELECT k.certificate_id, c.hash, k.covered_start <= c.range_start AND k.covered_end >= c.range_end AS covered FROM cert k JOIN ckpt c ON c.hash = k.checkpoint_hash")
def range_covered(spark, sf):
    c = A.ckpt(spark, sf).select("hash", "range_start", "range_end")
    k = A.cert(spark, sf).withColumnRenamed("checkpoint_hash", "hash")
    return k.join(c, "hash").selectExpr("certificate_id", "hash", "covered_start <= range_start AND covered_end >= range_end AS covered")


@query("D25_audit_summary", f"{W}, {_LATEST}, n AS (SELECT checkpoint_hash, count(*) AS certificates FROM cert GROUP BY checkpoint_hash) SELECT c.hash, coalesce(n.certificates, 0) AS certificates, CASE WHEN l.verdict IS NULL THEN 'unaudited' WHEN l.verdict = 'pass' AND l.drift_score <= 0.3 THEN 'passing' ELSE 'failing' END AS summary FROM ckpt c LEFT JOIN latest l ON l.checkpoint_hash = c.hash LEFT JOIN n ON n.checkpoint_hash = c.hash")
def audit_summary(spark, sf):
    """Count and newest certificate in one aggregation."""
    key = F.struct((-F.col("created_us")).alias("age"), "issued")
    s = A.cert(spark, sf).groupBy(F.col("checkpoint_hash").alias("hash")).agg(F.count("*").alias("certificates"), F.min_by("verdict", key).alias("verdict"), F.min_by("drift_score", key).alias("drift"))
    return A.ckpt(spark, sf).select("hash").join(s, "hash", "left").selectExpr("hash", "coalesce(certificates, 0) AS certificates", "CASE WHEN verdict IS NULL THEN 'unaudited' WHEN verdict = 'pass' AND drift <= 0.3D THEN 'passing' ELSE 'failing' END AS summary")


@query("D26_signature_count", f"{W} SELECT certificate_id, len(list_filter(signatures, lambda s: s IN ('ed25519', 'ml-dsa-65'))) AS allowed, len(signatures) AS total FROM cert")
def signature_count(spark, sf):
    return A.cert(spark, sf).select("certificate_id", U.valid_signatures(F.col("signatures"), ["ed25519", "ml-dsa-65"]).alias("allowed"), U.valid_signatures(F.col("signatures"), []).alias("total"))


_GATE = f"""{W}, {_LATEST}, {A.ABI}, {A.CHECKPOINT_CORRECTIONS}, {_MENTIONED},
g AS (SELECT a.hash, coalesce(m.interrupt, false) AS interrupt, CASE WHEN {_COMPAT.replace('tenant_id <>', 'a.tenant_id <>').replace('session_id <>', 'a.session_id <>')} <> 'ok' THEN 'incompatible' WHEN {_THAW} <> 'ok' THEN 'thaw' WHEN coalesce(m.blocking, 0) > 0 THEN 'blocking_correction'
  WHEN l.verdict IS NULL THEN 'no_certificate' WHEN l.verdict = 'pending' THEN 'pending' WHEN l.verdict <> 'pass' THEN 'not_pass' WHEN l.covered_start > a.range_start OR l.covered_end < a.range_end THEN 'range' WHEN l.drift_score > 0.3 THEN 'drift'
  WHEN len(list_filter(l.signatures, lambda s: s IN ('ed25519', 'ml-dsa-65'))) < 1 THEN 'signatures' ELSE 'accepted' END AS reason
  FROM abi a LEFT JOIN latest l ON l.checkpoint_hash = a.hash LEFT JOIN mentioned m ON m.hash = a.hash)"""


@query("B14_decision_gate", f"{_GATE} SELECT hash, reason, reason = 'accepted' AS may_use, interrupt FROM g")
def decision_gate(spark, sf):
    """Compatibility, thaw, correction barrier, certificate, verdict, range, drift, signatures: the first refusal is the answer."""
    return _gated(spark, sf).select("hash", "reason", (F.col("reason") == "accepted").alias("may_use"), "interrupt")


def _gated(spark, sf):
    return U.gated(A.abi(spark, sf), A.checkpoint_corrections(spark, sf), A.cert(spark, sf), drift=0.3, signatures=1, allowed=["ed25519", "ml-dsa-65"])


@query("K4_gate_then_load", f"{_GATE} SELECT hash, CASE reason WHEN 'accepted' THEN 'load' WHEN 'blocking_correction' THEN 'replay' ELSE 'refuse' END AS action FROM g")
def gate_then_load(spark, sf):
    """Replay only where a blocking correction is the reason; any other refusal fails closed."""
    return _gated(spark, sf).selectExpr("hash", "CASE reason WHEN 'accepted' THEN 'load' WHEN 'blocking_correction' THEN 'replay' ELSE 'refuse' END AS action")


@query("D27_structured_drift", "SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 1.0 ELSE (CAST(doc_id % 2 = 0 AS INTEGER) + CAST(doc_id % 3 = 0 AS INTEGER) + CAST(doc_id % 5 = 0 AS INTEGER)) / 3.0 END::DOUBLE AS drift FROM documents")
def structured_drift(spark, sf):
    """Share of required fields that differ or are missing on either side; unreadable JSON is 1."""
    docs = A.table(spark, sf, "documents").selectExpr("doc_id", "IF(doc_id % 19 = 0, '{', concat('{\"a\":1', IF(doc_id % 3 = 0, '', ',\"b\":2'), ',\"c\":3}')) AS l", "concat('{\"a\":', IF(doc_id % 2 = 0, 9, 1), ',\"b\":2', IF(doc_id % 5 = 0, '', ',\"c\":3'), '}') AS r")
    schema = "a INT, b INT, c INT, bad STRING"
    opts = {"columnNameOfCorruptRecord": "bad"}
    rows = docs.withColumn("x", F.from_json("l", schema, opts)).withColumn("y", F.from_json("r", schema, opts))
    differs = lambda f: (F.col(f"x.{f}").isNull() | F.col(f"y.{f}").isNull() | (F.col(f"x.{f}") != F.col(f"y.{f}"))).cast("int")
    return rows.select("doc_id", F.when(F.col("x.bad").isNotNull() | F.col("y.bad").isNotNull(), 1.0).otherwise((differs("a") + differs("b") + differs("c")) / 3.0).alias("drift"))


@query("H68_capabilities", f"WITH {A.EV_STREAM}, t AS (SELECT event_id, user_id, event_id % 3 AS action, timestamp_us FROM ev_stream), revoked AS (SELECT DISTINCT user_id FROM events WHERE user_id % 11 = 3) SELECT event_id, CASE WHEN r.user_id IS NOT NULL THEN 'revoked' WHEN timestamp_us > 1706000000000000 THEN 'expired' WHEN action = 2 THEN 'action' ELSE 'granted' END AS verdict FROM t LEFT JOIN revoked r ON r.user_id = t.user_id")
def capabilities(spark, sf):
    revoked = A.table(spark, sf, "events").filter("user_id % 11 = 3").select("user_id", F.lit(True).alias("gone")).distinct()
    rows = A.ev_stream(spark, sf).join(revoked, "user_id", "left")
    return rows.select("event_id", F.coalesce(U.refusal((F.col("gone"), "revoked"), (F.col("timestamp_us") > 1706000000000000, "expired"), (F.col("event_id") % 3 == 2, "action")), F.lit("granted")).alias("verdict"))
