"""The provided tables as event logs, directives, checkpoints, certificates and result rows.

Each frame has a twin in SQL, a list of common table expressions for DuckDB.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an event log."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "'local' AS tenant_id",
        "CAST(conv_id AS STRING) AS session_id",
        "turn AS event_index",
        "CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'model' ELSE 'internal' END AS type",
        "text AS payload",
        "1700000000000000 + conv_id * 1000000 + turn AS timestamp_us",
        "turn + 1 AS step_index",
        "conv_id",
    )


EV_CONV = """ev_conv AS (SELECT 'local' AS tenant_id, CAST(conv_id AS VARCHAR) AS session_id, turn AS event_index,
  CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'model' ELSE 'internal' END AS type, text AS payload,
  1700000000000000 + conv_id * 1000000 + turn AS timestamp_us, turn + 1 AS step_index, conv_id FROM conversations)"""


def ev_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one session per user, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("event_index", F.row_number().over(order).cast("long") - 1).selectExpr(
        "'local' AS tenant_id",
        "CAST(user_id AS STRING) AS session_id",
        "event_index",
        "CASE event_type WHEN 'purchase' THEN 'tool' WHEN 'error' THEN 'correction' WHEN 'signup' THEN 'model' ELSE 'user' END AS type",
        "concat(event_type, ':', props) AS payload",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS timestamp_us",
        "CAST(floor(value) AS INT) AS tokens",
        "event_id",
        "user_id",
    )


EV_STREAM = """ev_stream AS (SELECT 'local' AS tenant_id, CAST(user_id AS VARCHAR) AS session_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_index,
  CASE event_type WHEN 'purchase' THEN 'tool' WHEN 'error' THEN 'correction' WHEN 'signup' THEN 'model' ELSE 'user' END AS type,
  event_type || ':' || props AS payload, epoch_us(ts) AS timestamp_us, CAST(floor(value) AS INTEGER) AS tokens, event_id, user_id FROM events)"""


def corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction directive for every fifth conversation: its fact is the first long word of turn 0."""
    conv = table(spark, sf_dir, "conversations").filter("conv_id % 5 = 0")
    return conv.groupBy("conv_id").agg(F.max(F.expr("CASE WHEN turn = 0 THEN regexp_extract(text, '[A-Za-z]{5,}', 0) END")).alias("fact"), F.max("turn").alias("correction_index")).selectExpr(
        "'local' AS tenant_id",
        "CAST(conv_id AS STRING) AS session_id",
        "concat('corr-', conv_id) AS correction_id",
        "fact",
        "correction_index",
        "CASE conv_id % 3 WHEN 0 THEN 'prior_events' WHEN 1 THEN 'checkpoint_range' ELSE 'global' END AS scope",
        "CASE WHEN conv_id % 10 = 5 THEN 'info' ELSE 'blocking' END AS severity",
        "conv_id",
    )


CORR = """corr AS (SELECT 'local' AS tenant_id, CAST(conv_id AS VARCHAR) AS session_id, 'corr-' || conv_id AS correction_id,
  max(CASE WHEN turn = 0 THEN regexp_extract(text, '[A-Za-z]{5,}') END) AS fact, max(turn) AS correction_index,
  CASE conv_id % 3 WHEN 0 THEN 'prior_events' WHEN 1 THEN 'checkpoint_range' ELSE 'global' END AS scope,
  CASE WHEN conv_id % 10 = 5 THEN 'info' ELSE 'blocking' END AS severity, conv_id
  FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id)"""


def ckpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-0 checkpoints over windows of 8 events, and level-1 roll-ups of 4 of them."""
    zero = ev_stream(spark, sf_dir).withColumn("w", F.expr("event_index div 8")).groupBy("tenant_id", "session_id", "user_id", "w").agg(
        F.min("event_index").alias("range_start"),
        (F.max("event_index") + 1).alias("range_end"),
        F.max("timestamp_us").alias("created_us"),
        F.expr("listagg(payload, '\n') WITHIN GROUP (ORDER BY event_index)").alias("body"),
    )
    zero = zero.selectExpr("tenant_id", "session_id", "user_id", "0 AS level", "w", "range_start", "range_end", "created_us", "sha2(body, 256) AS body_hash", "length(body) AS body_size", "CAST(array() AS ARRAY<STRING>) AS parent_hashes")
    zero = zero.withColumn("hash", F.expr("sha2(concat_ws('|', tenant_id, session_id, level, range_start, range_end, body_hash, created_us), 256)"))
    one = zero.groupBy("tenant_id", "session_id", "user_id", F.expr("w div 4").alias("w")).agg(
        F.min("range_start").alias("range_start"),
        F.max("range_end").alias("range_end"),
        F.max("created_us").alias("created_us"),
        F.expr("listagg(hash, ',') WITHIN GROUP (ORDER BY range_start)").alias("children"),
    )
    one = one.selectExpr("tenant_id", "session_id", "user_id", "1 AS level", "w", "range_start", "range_end", "created_us", "sha2(children, 256) AS body_hash", "length(children) AS body_size", "split(children, ',') AS parent_hashes")
    one = one.withColumn("hash", F.expr("sha2(concat_ws('|', tenant_id, session_id, level, range_start, range_end, body_hash, created_us), 256)"))
    return zero.unionByName(one)


CKPT = (
    EV_STREAM
    + r""", ck0 AS (SELECT tenant_id, session_id, user_id, 0 AS level, event_index // 8 AS w, min(event_index) AS range_start, max(event_index) + 1 AS range_end,
  max(timestamp_us) AS created_us, string_agg(payload, chr(10) ORDER BY event_index) AS body FROM ev_stream GROUP BY ALL),
ckz AS (SELECT *, sha256(body) AS body_hash, length(body) AS body_size FROM ck0),
ckzh AS (SELECT tenant_id, session_id, user_id, level, w, range_start, range_end, created_us, body_hash, body_size, CAST([] AS VARCHAR[]) AS parent_hashes,
  sha256(concat_ws('|', tenant_id, session_id, level, range_start, range_end, body_hash, created_us)) AS hash FROM ckz),
ck1 AS (SELECT tenant_id, session_id, user_id, 1 AS level, w // 4 AS w, min(range_start) AS range_start, max(range_end) AS range_end, max(created_us) AS created_us,
  string_agg(hash, ',' ORDER BY range_start) AS children FROM ckzh GROUP BY tenant_id, session_id, user_id, w // 4),
ckoh AS (SELECT tenant_id, session_id, user_id, level, w, range_start, range_end, created_us, sha256(children) AS body_hash, length(children) AS body_size,
  string_split(children, ',') AS parent_hashes FROM ck1),
ckpt AS (SELECT * FROM ckzh UNION ALL SELECT *, sha256(concat_ws('|', tenant_id, session_id, level, range_start, range_end, body_hash, created_us)) AS hash FROM ckoh)"""
)


def cert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One certificate for each level-0 checkpoint, a second for every third."""
    base = ckpt(spark, sf_dir).filter("level = 0").withColumn("k", F.expr("explode(CASE WHEN w % 3 = 0 THEN array(1, 2) ELSE array(1) END)"))
    return base.selectExpr(
        "tenant_id",
        "session_id",
        "hash AS checkpoint_hash",
        "sha2(concat_ws('|', hash, k), 256) AS certificate_id",
        "CASE (user_id + w + k) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'correction_emitted' WHEN 2 THEN 'inconclusive' ELSE 'pass' END AS verdict",
        "((user_id + w + k) % 7) / 10.0D AS drift_score",
        "created_us + k - CASE WHEN w % 6 = 0 AND k = 2 THEN 1 ELSE 0 END AS created_us",
        "range_start AS covered_start",
        "range_end - CASE WHEN w % 11 = 0 THEN 1 ELSE 0 END AS covered_end",
        "filter(array('ed25519', 'hmac-sha256', 'ml-dsa-65'), (a, i) -> i < (w + k) % 4) AS signatures",
        "k AS issued",
    )


CERT = (
    CKPT
    + """, cert AS (SELECT tenant_id, session_id, hash AS checkpoint_hash, sha256(concat_ws('|', hash, k)) AS certificate_id,
  CASE (user_id + w + k) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'correction_emitted' WHEN 2 THEN 'inconclusive' ELSE 'pass' END AS verdict,
  ((user_id + w + k) % 7)::DOUBLE / 10.0::DOUBLE AS drift_score, created_us + k - CASE WHEN w % 6 = 0 AND k = 2 THEN 1 ELSE 0 END AS created_us,
  range_start AS covered_start, range_end - CASE WHEN w % 11 = 0 THEN 1 ELSE 0 END AS covered_end, ['ed25519', 'hmac-sha256', 'ml-dsa-65'][1:((w + k) % 4)::INT] AS signatures, k AS issued
  FROM (SELECT *, unnest(CASE WHEN w % 3 = 0 THEN [1, 2] ELSE [1] END) AS k FROM ckpt WHERE level = 0))"""
)

ZERO = "0" * 64
_ARTIFACTS = [hashlib.sha256(f"artifact-{i}".encode()).hexdigest() for i in (1, 2)]
#: A manifest's identity, model, producer and storage, and what a request to thaw it wants; most agree.
ABI_FIELDS = [
    "'main' AS branch_id", "'m1' AS model_id", f"CASE WHEN user_id % 23 = 5 THEN 'not-a-hash' ELSE '{_ARTIFACTS[0]}' END AS artifact_hash", "'decoder' AS model_class", "'x86_64' AS architecture_tag",
    "CASE WHEN w % 5 = 3 THEN 'int8_per_token' ELSE 'fp16' END AS kv_dtype", "CASE WHEN user_id % 17 = 4 THEN 'other' ELSE 'local' END AS want_tenant", "session_id AS want_session",
    "CASE WHEN user_id % 19 = 7 THEN 'side' ELSE 'main' END AS want_branch", "CASE WHEN (user_id + w) % 13 = 6 THEN 'm2' ELSE 'm1' END AS want_model",
    f"CASE WHEN (user_id + w) % 11 = 3 THEN '{_ARTIFACTS[1]}' ELSE '{_ARTIFACTS[0]}' END AS want_artifact", "CASE WHEN w % 4 = 0 THEN '' WHEN user_id % 7 = 2 THEN 'encoder' ELSE 'decoder' END AS want_class",
    "CASE WHEN (user_id + w) % 12 = 5 THEN 'arm64' ELSE 'x86_64' END AS want_arch", "user_id % 2 = 0 AS replay_safe", "CASE WHEN user_id % 3 = 0 THEN 'int8_per_token' ELSE 'fp16' END AS approved_dtype",
    f"CASE WHEN w % 9 = 4 THEN '{ZERO}' ELSE hash END AS expected_digest", f"CASE WHEN w % 9 = 5 THEN reverse(hash) WHEN w % 9 = 6 THEN '{ZERO}' ELSE hash END AS actual_digest",
    "CASE WHEN w % 7 = 1 THEN 'local_file' ELSE 'memorydb_metadata' END AS metadata_tier", "CASE WHEN w % 7 = 2 THEN 'memorydb_metadata' WHEN w % 2 = 0 THEN 's3_express' ELSE 'local_file' END AS blob_tier",
    "CASE WHEN w % 7 = 3 THEN '' ELSE 'meta/' || hash END AS metadata_uri", "CASE WHEN w % 7 = 4 THEN '' ELSE 'blob/' || hash END AS blob_uri",
    "user_id % 2 = 1 AS rack_local", "w % 2 = 0 AS rdma_available", "user_id % 5 = 0 AS cross_az",
]
ABI = f"abi AS (SELECT *, {', '.join(ABI_FIELDS)} FROM ckpt)"


def abi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints with the fields of their manifests and of a request for each."""
    return ckpt(spark, sf_dir).selectExpr("*", *ABI_FIELDS)


_REPAIR = ["hash AS target", "CASE WHEN w % 2 = 0 THEN 'info' ELSE 'blocking' END AS severity", "w % 6 = 1 AS interrupts"]


def checkpoint_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of every third level-0 checkpoint: its hash, others that they invalidate, severity."""
    return ckpt(spark, sf_dir).filter("level = 0 AND w % 3 = 1").selectExpr("user_id", "w", *_REPAIR, "IF(w % 2 = 0, array(hash, reverse(hash)), array(reverse(hash))) AS invalidated")


CHECKPOINT_CORRECTIONS = f"cor AS (SELECT user_id, w, {', '.join(_REPAIR)}, CASE WHEN w % 2 = 0 THEN [hash, reverse(hash)] ELSE [reverse(hash)] END AS invalidated FROM ckpt WHERE level = 0 AND w % 3 = 1)"


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives of several facts, for every fifth conversation one, for every tenth a second one without an id, in order."""
    conv = table(spark, sf_dir, "conversations").filter("conv_id % 5 = 0")
    word = lambda turn: F.max(F.expr(f"CASE WHEN turn = {turn} THEN regexp_extract(text, '[A-Za-z]{{5,}}', 0) END"))
    c = conv.groupBy("conv_id").agg(F.coalesce(word(0), F.lit("")).alias("one"), F.coalesce(word(1), F.lit("")).alias("two"), F.max("turn").alias("correction_index"))
    c = c.withColumn("directive_index", F.expr("explode(CASE WHEN conv_id % 10 = 0 THEN array(0, 1) ELSE array(0) END)"))
    return c.selectExpr(
        "CAST(conv_id AS STRING) AS session_id", "CASE WHEN directive_index = 0 THEN concat('z-', conv_id) ELSE '' END AS correction_id", "directive_index",
        "CASE WHEN directive_index = 0 THEN array(one, two, '') ELSE array(two) END AS facts", "correction_index", "CASE (conv_id + directive_index) % 3 WHEN 0 THEN 'prior_events' WHEN 1 THEN 'checkpoint_range' ELSE 'global' END AS scope",
    )


DIRECTIVES = """dir AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN k = 0 THEN 'z-' || conv_id ELSE '' END AS correction_id, k AS directive_index, CASE WHEN k = 0 THEN [one, two, ''] ELSE [two] END AS facts,
  correction_index, CASE (conv_id + k) % 3 WHEN 0 THEN 'prior_events' WHEN 1 THEN 'checkpoint_range' ELSE 'global' END AS scope
  FROM (SELECT *, unnest(CASE WHEN conv_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS k FROM (SELECT conv_id, coalesce(max(CASE WHEN turn = 0 THEN regexp_extract(text, '[A-Za-z]{5,}') END), '') AS one,
    coalesce(max(CASE WHEN turn = 1 THEN regexp_extract(text, '[A-Za-z]{5,}') END), '') AS two, max(turn) AS correction_index FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id)))"""

CONDITIONS = ("raw_oracle", "rolling_summary", "dpm_phase3_checkpoint", "rolling_summary_plus_dpm_gate")
_CONDITION = "CASE doc_id % 4 WHEN 0 THEN 'raw_oracle' WHEN 1 THEN 'rolling_summary' WHEN 2 THEN 'dpm_phase3_checkpoint' ELSE 'rolling_summary_plus_dpm_gate' END"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels as evaluation rows: case, condition, repeat, budget, nullable scores and costs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.filter("NOT (doc_id % 12 = 5 AND (doc_id div 12) % 3 = 0)").selectExpr(
        "doc_id",
        "doc_id div 12 AS case_id",
        f"{_CONDITION} AS condition",
        "(doc_id div 4) % 3 AS repeat",
        "1338 + 669 * CAST(doc_id % 29 = 0 AS INT) AS budget_chars",
        "CASE doc_id % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'memory_projection' ELSE 'correction_safety' END AS test_kind",
        "CASE WHEN doc_id % 17 = 0 THEN 'skipped' WHEN doc_id % 31 = 0 THEN 'errored' ELSE 'ok' END AS status",
        "CAST(quality AS DOUBLE) AS decision_score",
        "toxic = 1 AS stale_memory_escape",
        "CASE WHEN doc_id % 4 >= 2 THEN quality = 1 END AS audit_pass",
        "CASE WHEN doc_id % 4 >= 2 THEN toxic = 0 END AS gate_may_use",
        "n_chars AS wall_ms",
        "CAST(n_chars DIV 4 AS BIGINT) AS input_tokens",
        "doc_id % 5 AS model_calls",
    )


RESULTS = f"""results AS (SELECT d.doc_id, d.doc_id // 12 AS case_id, {_CONDITION.replace('doc_id', 'd.doc_id')} AS condition, (d.doc_id // 4) % 3 AS repeat,
  1338 + 669 * CAST(d.doc_id % 29 = 0 AS INTEGER) AS budget_chars,
  CASE d.doc_id % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'memory_projection' ELSE 'correction_safety' END AS test_kind,
  CASE WHEN d.doc_id % 17 = 0 THEN 'skipped' WHEN d.doc_id % 31 = 0 THEN 'errored' ELSE 'ok' END AS status,
  CAST(quality AS DOUBLE) AS decision_score, toxic = 1 AS stale_memory_escape, CASE WHEN d.doc_id % 4 >= 2 THEN quality = 1 END AS audit_pass,
  CASE WHEN d.doc_id % 4 >= 2 THEN toxic = 0 END AS gate_may_use, n_chars AS wall_ms, n_chars // 4 AS input_tokens, d.doc_id % 5 AS model_calls
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (d.doc_id % 12 = 5 AND (d.doc_id // 12) % 3 = 0))"""


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd conversations branch from the one before at turn 2."""
    return table(spark, sf_dir, "conversations").filter("conv_id % 2 = 1").select("conv_id").distinct().selectExpr("conv_id", "conv_id - 1 AS parent_id", "2 AS parent_count")


BRANCHES = "branches AS (SELECT DISTINCT conv_id, conv_id - 1 AS parent_id, 2 AS parent_count FROM conversations WHERE conv_id % 2 = 1)"
