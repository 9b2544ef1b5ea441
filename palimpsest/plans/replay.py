"""Queries of replay audits and of certificates' bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import codec as K
from ..operators import projection as P
from ..operators import replay as R
from ..operators.shared import written
from ..sources import adapters as A
from .checkpoints import _EDGES, _edges
from .composites import _BOUND, _bytes_sql

CONFIG = P.Config(schema_id="memory-v1", schema_json='{"type":"object"}', model_id="stand-in-1", budget=119)
AUDITOR = R.Auditor(CONFIG, artifact_hash="ab" * 32, model_id="auditor-1", policy="policy-v1")


def stored(spark, sf, log: DataFrame) -> DataFrame:
    """Checkpoints with their projections as they were stored. Of twelve one manifest is cut, one filed under another digest, one under
    another body, one reaches beyond the log; one payload is missing, one altered; every fourth was made from something else."""
    c = A.ckpt(spark, sf).filter("level = 0").selectExpr("* EXCEPT (body_hash, body_size)", "(user_id + w) % 12 AS k", *[f"{v} AS {n}" for n, v in _BOUND.items()])
    made = written(c.join(R.replayed(c, log, P.stand_in, CONFIG).drop("replay_error"), "hash").withColumn("body", F.coalesce("replay", F.lit("{}"))).drop("replay"), "checkpoints")
    made = made.withColumn("body", F.when(F.col("k") % 4 == 2, F.replace("body", F.lit('"Reasoning":[]'), F.lit('"Reasoning":["old [1]"]'))).otherwise(F.col("body")))
    made = made.withColumns({"body_hash": F.sha2("body", 256), "body_size": F.octet_length("body"), "range_end": F.expr("IF(k = 9, range_end + 1000, range_end)")}).withColumn("data", K.encoded(K.MANIFEST))
    return made.select(
        "hash", F.expr("IF(k = 3, sha2('x', 256), sha2(data, 256))").alias("digest"), F.expr("IF(k = 1, substring(data, 1, length(data) - 1), data)").alias("data"), F.expr("IF(k = 11, sha2('other', 256), body_hash)").alias("body_hash"),
        F.expr("CASE k WHEN 5 THEN NULL WHEN 7 THEN concat(body, 'x') ELSE body END").alias("body"), "created_us",
    )


_CERTIFICATE_SQL = {
    "checkpoint_manifest_hash": "hash", "checkpoint_body_hash": "sha256(body)", "branch_id": f"'{AUDITOR.branch_id}'", "event_range_start": "range_start", "event_range_end": "range_end", "log_generation": "generation", "schema_id": f"'{CONFIG.schema_id}'",
    "model_artifact_hash": f"'{AUDITOR.artifact_hash}'", "projection_model_id": f"'{CONFIG.model_id}'", "auditor_model_id": f"'{AUDITOR.model_id}'", "audit_policy_version": f"'{AUDITOR.policy}'",
    "verdict": "CASE WHEN matched THEN 'pass' ELSE 'correction_emitted' END", "drift_score": "CASE WHEN matched THEN 0.0 ELSE 1.0 END::DOUBLE", "drift_fields": "CASE WHEN matched THEN [] WHEN replay_error IS NULL THEN ['projected_memory_hash'] ELSE ['projection_replay_error'] END",
    "correction_event_ids": "CASE WHEN matched THEN [] ELSE [correction_id] END", "provenance_root_hash": "hash", "created_unix_micros": "created_us", "expires_unix_micros": "0",
}
_AUDIT = f"""p AS (SELECT c.hash, '{{"Facts":' || replace(to_json(list(left(e.payload, 40) || ' [' || (e.event_index + 1) || ']' ORDER BY e.event_index)[1:3])::VARCHAR, '\\/', '/') || ',"Reasoning":[],"Compliance":[]}}' AS canonical
  FROM ckpt c JOIN ev_stream e ON e.session_id = c.session_id AND e.event_index >= c.range_start AND e.event_index < c.range_end WHERE c.level = 0 GROUP BY c.hash),
q AS (SELECT hash, canonical, CASE WHEN strlen(canonical) > {CONFIG.budget} THEN 'projection replay failed: over budget: ' || strlen(canonical) || ' > {CONFIG.budget} bytes' END AS replay_error FROM p),
s AS (SELECT c.*, (user_id + w) % 12 AS k, q.canonical, q.replay_error, CASE WHEN replay_error IS NOT NULL THEN '{{}}' WHEN (user_id + w) % 4 = 2 THEN replace(canonical, '"Reasoning":[]', '"Reasoning":["old [1]"]') ELSE canonical END AS body, g.generation
  FROM ckpt c JOIN q USING (hash) JOIN (SELECT session_id, count(*) AS generation FROM ev_stream GROUP BY session_id) g ON g.session_id = c.session_id WHERE c.level = 0),
a AS (SELECT *, replay_error IS NULL AND body = canonical AS matched, 'corr-' || left(sha256('correction:' || hash || ':' || sha256(coalesce(replay_error, canonical)) || ':' || created_us), 32) AS correction_id FROM s WHERE k % 2 = 0),
bound AS (SELECT hash, matched, replay_error, correction_id, tenant_id, session_id, {', '.join(f'{v} AS {n}' for n, v in _CERTIFICATE_SQL.items())} FROM a),
certificates AS (SELECT *, sha256(unhex('{K.CERTIFICATE_VERSION.to_bytes(4, "little").hex()}' || {' || '.join(_bytes_sql(n, kind) for n, kind in K.CERTIFICATE)})) AS certificate_id FROM bound)"""


@query(
    "K3_replay_certificates",
    f"""WITH RECURSIVE {A.CKPT}, {_AUDIT}, {_EDGES}, r AS (SELECT hash AS seed, hash AS node FROM certificates WHERE NOT matched UNION SELECT r.seed, e.dst FROM r JOIN edges e ON e.src = r.node),
closed AS (SELECT seed, count(*) AS n, sha256(string_agg(node, ',' ORDER BY node)) AS digest FROM r GROUP BY seed)
SELECT hash, verdict, drift_score, CASE WHEN matched THEN 0.0 WHEN replay_error IS NULL THEN 1 / 3 ELSE 1.0 END::DOUBLE AS structured, certificate_id, CASE WHEN NOT matched THEN correction_id END AS correction_id, coalesce(n, 0)::INTEGER AS n_invalidated, closed.digest AS invalidated, NULL AS error
FROM certificates LEFT JOIN closed ON closed.seed = hash
UNION ALL SELECT hash, NULL, NULL, NULL, NULL, NULL, 0, NULL, CASE k WHEN 1 THEN 'manifest bytes' WHEN 3 THEN 'manifest hash' WHEN 5 THEN 'payload missing' WHEN 7 THEN 'payload hash' WHEN 9 THEN 'event range' ELSE 'manifest body hash' END FROM s WHERE k % 2 = 1""",
)
def replay_certificates(spark, sf):
    """Every stored projection made again: certificates for all that are whole, corrections with their closures for those that drifted."""
    log = A.ev_stream(spark, sf)
    found = R.audit(stored(spark, sf, log), log, _edges(spark, sf), P.stand_in, AUDITOR)
    closed = found.corrections.select("correction_id", F.size("invalidates").alias("n_invalidated"), F.sha2(F.array_join("invalidates", ","), 256).alias("invalidated"))
    return found.results.join(closed, "correction_id", "left").select("hash", "verdict", "drift_score", "structured", "certificate_id", "correction_id", F.coalesce("n_invalidated", F.lit(0)).alias("n_invalidated"), "invalidated", "error")


#: Fields of a certificate over the provided ones; some hold what no certificate may.
_HELD = {
    "checkpoint_manifest_hash": "checkpoint_hash", "checkpoint_body_hash": "certificate_id", "tenant_id": "CASE WHEN k = 5 THEN '' ELSE tenant_id END", "session_id": "session_id", "branch_id": "'main é'", "event_range_start": "covered_start", "event_range_end": "covered_end",
    "log_generation": "covered_end + 1", "schema_id": "'memory-v1'", "model_artifact_hash": f"'{'ab' * 32}'", "projection_model_id": "'m1'", "auditor_model_id": "'a1'", "audit_policy_version": "'v1'", "verdict": "CASE WHEN k = 6 THEN 'maybe' ELSE verdict END",
    "drift_score": "CASE WHEN k = 4 THEN 1.5 ELSE drift_score END", "provenance_root_hash": "checkpoint_hash", "created_unix_micros": "created_us", "expires_unix_micros": "0",
}
_KEY = "(length(session_id) + covered_start // 8 + issued) % 8"


def _double_sql(x: str) -> str:
    """The bits of a positive double, or 0."""
    e = f"CAST(floor(log2({x})) AS BIGINT)"
    return f"CASE WHEN {x} = 0 THEN 0 ELSE (({e} + 1023) << 52) + CAST(({x} / pow(2, {e}) - 1) * 4503599627370496 AS BIGINT) END"


@query(
    "H63_certificate_codec",
    f"""WITH {A.CERT}, h AS (SELECT *, {_KEY} AS k FROM cert), b AS (SELECT certificate_id AS key, k, signatures, issued, {', '.join(f'{v} AS {n}' for n, v in _HELD.items())}, CASE WHEN verdict = 'pass' THEN [] ELSE ['a', 'bé'] END AS drift_fields, CASE WHEN verdict = 'correction_emitted' THEN ['corr-' || left(certificate_id, 8)] ELSE [] END AS correction_event_ids FROM h),
x AS (SELECT *, '01000000' || {' || '.join(_bytes_sql(n, kind) if kind != 'f64' else _bytes_sql('(' + _double_sql(n) + ')', 'u64') for n, kind in K.CERTIFICATE)} AS canonical FROM b)
SELECT key, sha256(unhex(canonical)) AS digest, CAST(length(canonical) // 2 AS BIGINT) AS size, CASE k WHEN 1 THEN 'truncated' WHEN 2 THEN 'trailing' WHEN 3 THEN 'version' WHEN 4 THEN 'drift' WHEN 5 THEN 'identity' WHEN 6 THEN 'verdict' ELSE '' END AS error,
  CASE WHEN k IN (0, 7) THEN session_id END AS session_id, CASE WHEN k IN (0, 7) THEN verdict END AS verdict, CASE WHEN k IN (0, 7) THEN drift_score END::DOUBLE AS drift_score,
  CASE WHEN k IN (0, 7) THEN array_to_string(correction_event_ids, ',') ELSE '' END AS corrections, CASE WHEN k IN (0, 7) THEN array_to_string(signatures, ',') ELSE '' END AS algorithms FROM x""",
)
def certificate_codec(spark, sf):
    """Canonical bytes, their hash, and what is read back of the signed envelope; some were cut, lengthened, put in another order, or hold
    a wrong value."""
    c = A.cert(spark, sf).withColumn("k", F.expr(_KEY.replace("//", "DIV")))
    none = "CAST(array() AS ARRAY<STRING>)"
    held = c.selectExpr("certificate_id AS key", "k", "signatures", "issued", *[f"{v} AS {n}" for n, v in _HELD.items()], f"IF(verdict = 'pass', {none}, array('a', 'bé')) AS drift_fields", f"IF(verdict = 'correction_emitted', array(concat('corr-', left(certificate_id, 8))), {none}) AS correction_event_ids")
    held = held.withColumn("drift_score", F.col("drift_score").cast("double")).withColumn("canonical", K.certificate())
    signed = F.transform("signatures", lambda s: F.struct(s.alias("algorithm"), F.concat(F.lit("key-"), F.col("issued").cast("string")).alias("key_id"), F.col("key").alias("signature")))
    held = held.withColumn("x", K.envelope(F.col("canonical"), signed))
    damaged = F.expr("CASE k WHEN 1 THEN substring(x, 1, length(x) - 1) WHEN 2 THEN concat(x, X'00') WHEN 3 THEN concat(substring(x, 5, 60), substring(x, 1, 4), substring(x, 65)) ELSE x END")
    back = held.select("key", damaged.alias("data")).mapInPandas(K.decode_envelopes, "key string, error string, session_id string, verdict string, drift_score double, corrections string, algorithms string")
    return held.select("key", F.sha2("canonical", 256).alias("digest"), F.length("canonical").cast("long").alias("size")).join(back, "key")
