"""Queries of composite operators: project, store, audit, decide, sweep."""

from __future__ import annotations

import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import codec as K
from ..functions import text as T
from ..operators import evidence as V
from ..operators import plugins, runner
from ..sources import adapters as A
from ..streaming import decode

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VIEW = f"""hits AS (SELECT e.session_id, e.event_index, c.correction_id FROM ev_conv e JOIN corr c ON e.session_id = c.session_id AND (c.scope <> 'prior_events' OR e.event_index < c.correction_index) AND c.fact <> ''
  AND contains(translate(e.payload, '{UP}', '{LOW}'), translate(c.fact, '{UP}', '{LOW}')) WHERE e.type <> 'correction'),
g AS (SELECT session_id, event_index, count(*) AS n, string_agg(correction_id, ',' ORDER BY correction_id) AS revoked_by FROM hits GROUP BY ALL),
view AS (SELECT e.session_id, e.event_index, CASE WHEN revoked_by IS NULL THEN payload ELSE '{V.MARKER[0]}' || n || '{V.MARKER[1]}' || revoked_by || '{V.MARKER[2]}' END AS payload FROM ev_conv e LEFT JOIN g USING (session_id, event_index))"""
#: What the stand-in projects: the first words of the events, cited, while they fit the budget.
_PROJECT = """lines AS (SELECT session_id, event_index, left(split_part(payload, '.', 1), 40) || ' [' || (event_index + 1) || ']' AS item FROM view),
fits AS (SELECT *, sum(length(item) + 1) OVER (PARTITION BY session_id ORDER BY event_index) AS used FROM lines),
proj AS (SELECT session_id, string_agg(item, '|' ORDER BY event_index) AS memory, count(*) AS items FROM fits WHERE used <= 200 GROUP BY session_id)"""


@query("K1_project", f"WITH {A.EV_CONV}, {A.CORR}, {_VIEW}, {_PROJECT} SELECT session_id, memory, items, length(memory) <= 200 AS fits FROM proj")
def project(spark, sf):
    """Active evidence, then the deterministic runner within the budget."""
    view = V.active_view(A.ev_conv(spark, sf), A.corr(spark, sf), ["session_id"])
    p = runner.project(view, 200)
    return p.withColumn("fits", F.length("memory") <= 200)


@query("K2_projection_checkpoint", f"WITH {A.EV_CONV}, {A.CORR}, {_VIEW}, {_PROJECT} SELECT p.session_id, sha256(memory) AS body_hash, sha256(concat_ws('|', p.session_id, sha256(memory), e.range_end)) AS manifest_hash, e.range_end FROM proj p JOIN (SELECT session_id, max(event_index) + 1 AS range_end FROM ev_conv GROUP BY session_id) e USING (session_id)")
def projection_checkpoint(spark, sf):
    log = A.ev_conv(spark, sf)
    p = runner.project(V.active_view(log, A.corr(spark, sf), ["session_id"]), 200)
    e = log.groupBy("session_id").agg((F.max("event_index") + 1).alias("range_end"))
    return p.join(e, "session_id").selectExpr("session_id", "sha2(memory, 256) AS body_hash", "sha2(concat_ws('|', session_id, sha2(memory, 256), range_end), 256) AS manifest_hash", "range_end")


@query("K3_replay_audit", f"WITH {A.EV_CONV}, {A.CORR}, {_VIEW}, {_PROJECT}, raw AS (SELECT session_id, event_index, left(split_part(payload, '.', 1), 40) || ' [' || (event_index + 1) || ']' AS item FROM ev_conv), rf AS (SELECT *, sum(length(item) + 1) OVER (PARTITION BY session_id ORDER BY event_index) AS used FROM raw), rp AS (SELECT session_id, string_agg(item, '|' ORDER BY event_index) AS memory FROM rf WHERE used <= 200 GROUP BY session_id) SELECT p.session_id, CASE WHEN sha256(p.memory) = sha256(rp.memory) THEN 0.0 ELSE 1.0 END::DOUBLE AS drift, CASE WHEN p.memory = rp.memory THEN 'pass' ELSE 'correction_emitted' END AS verdict FROM proj p JOIN rp USING (session_id)")
def replay_audit(spark, sf):
    """Recomputes each stored memory (here made without corrections) from the corrected log; drift is all or nothing."""
    log = A.ev_conv(spark, sf)
    stored = runner.project(log, 200).selectExpr("session_id", "sha2(memory, 256) AS was")
    now = runner.project(V.active_view(log, A.corr(spark, sf), ["session_id"]), 200).selectExpr("session_id", "sha2(memory, 256) AS body")
    return now.join(stored, "session_id").selectExpr("session_id", "IF(was = body, 0.0D, 1.0D) AS drift", "IF(was = body, 'pass', 'correction_emitted') AS verdict")


@query("K5_stateless_decision", f"WITH {A.EV_CONV}, {A.CORR}, {_VIEW}, {_PROJECT}, d AS (SELECT session_id, CASE WHEN contains(memory, 'REVOKED') THEN 'escalate' WHEN items >= 4 THEN 'approve' ELSE 'ask' END AS decision FROM proj) SELECT session_id, decision, 'decision:' || decision AS appended, (SELECT max(event_index) + 1 FROM ev_conv e WHERE e.session_id = d.session_id) AS at FROM d")
def stateless_decision(spark, sf):
    log = A.ev_conv(spark, sf)
    p = runner.project(V.active_view(log, A.corr(spark, sf), ["session_id"]), 200)
    d = p.withColumn("decision", F.when(F.contains("memory", F.lit("REVOKED")), "escalate").when(F.col("items") >= 4, "approve").otherwise("ask"))
    at = log.groupBy("session_id").agg((F.max("event_index") + 1).alias("at"))
    return d.join(at, "session_id").select("session_id", "decision", F.concat(F.lit("decision:"), "decision").alias("appended"), "at")


_ROLLED = """c AS (SELECT session_id, event_index // 8 AS chunk, string_agg(array_to_string(string_split(payload, ' ')[1:3], ' '), ' ' ORDER BY event_index) AS t FROM ev_conv GROUP BY ALL),
s AS (SELECT session_id, -1::BIGINT AS chunk, '' AS summary FROM (SELECT DISTINCT session_id FROM c) UNION ALL SELECT c.session_id, c.chunk, right(s.summary || '|' || c.t, 200) FROM s JOIN c ON c.session_id = s.session_id AND c.chunk = s.chunk + 1),
rolled AS (SELECT session_id, arg_max(summary, chunk) AS memory, max(chunk) + 2 AS calls FROM s GROUP BY session_id)"""


@query(
    "K8_memory_agents",
    f"""WITH RECURSIVE {A.EV_CONV}, {A.CORR}, {_VIEW}, {_PROJECT}, {_ROLLED}, st AS (SELECT r.session_id, bool_or(c.fact <> '' AND contains(lower(r.memory), lower(c.fact))) AS stale FROM rolled r JOIN corr c ON c.session_id = r.session_id GROUP BY r.session_id)
SELECT session_id, 'raw_oracle' AS condition, sha256(string_agg(payload, chr(10) ORDER BY event_index)) AS memory, 1 AS calls FROM ev_conv GROUP BY session_id UNION ALL SELECT session_id, 'rolling_summary', sha256(memory), calls FROM rolled
UNION ALL SELECT session_id, 'dpm_phase3_checkpoint', sha256(memory), 2 FROM proj UNION ALL SELECT r.session_id, 'rolling_summary_plus_dpm_gate', sha256(CASE WHEN coalesce(stale, false) THEN coalesce(p.memory, '') ELSE r.memory END), r.calls + coalesce(stale, false)::INT FROM rolled r LEFT JOIN st ON st.session_id = r.session_id LEFT JOIN proj p ON p.session_id = r.session_id""",
)
def memory_agents(spark, sf):
    """The memory that each registered agent makes of each session, and its calls."""
    log, facts = A.ev_conv(spark, sf), A.corr(spark, sf)
    runs = [agent(log, facts, 200).select("session_id", F.lit(name).alias("condition"), F.sha2("memory", 256).alias("memory"), "calls") for name, agent in plugins.AGENTS.entries.items()]
    return reduce(lambda a, b: a.unionByName(b), runs)


@query("K10_cliff_cells", "WITH d AS (SELECT doc_id, n_chars, lower(text) AS low FROM documents), g AS (SELECT *, unnest([200, 800, 3200]) AS budget FROM d) SELECT doc_id, budget, n_chars > 6000 AS guarded, CASE WHEN n_chars > 6000 THEN 0.0 ELSE (contains(left(low, budget), 'worthless')::INT + contains(left(low, budget), 'the')::INT) / 2.0 END::DOUBLE AS score FROM g")
def cliff_cells(spark, sf):
    """Each text at each budget; beyond the token guard a cell scores 0, not null."""
    g = A.table(spark, sf, "documents").withColumn("low", F.lower("text")).withColumn("budget", F.explode(F.array(F.lit(200), F.lit(800), F.lit(3200))))
    kept = F.expr("left(low, budget)")
    score = (F.contains(kept, F.lit("worthless")).cast("int") + F.contains(kept, F.lit("the")).cast("int")) / F.lit(2.0)
    return g.select("doc_id", "budget", (F.col("n_chars") > 6000).alias("guarded"), F.when(F.col("n_chars") > 6000, 0.0).otherwise(score).alias("score"))


@query("K12_handoff_simulation", f"WITH {A.EV_STREAM}, h AS (SELECT session_id, coalesce(min(event_index) FILTER (payload LIKE 'signup%'), count(*) // 2) AS handoff_at FROM ev_stream GROUP BY session_id), c AS (SELECT e.session_id, e.event_index, h.handoff_at, CAST(sum(strlen(payload)) OVER (PARTITION BY e.session_id ORDER BY e.event_index) AS BIGINT) AS bytes FROM ev_stream e JOIN h USING (session_id)) SELECT session_id, handoff_at, bytes AS bytes_before, (SELECT max(bytes) FROM c x WHERE x.session_id = c.session_id) - bytes AS bytes_after FROM c WHERE event_index = handoff_at")
def handoff_simulation(spark, sf):
    log = A.ev_stream(spark, sf)
    h = log.groupBy("session_id").agg(F.coalesce(F.min(F.expr("CASE WHEN payload LIKE 'signup%' THEN event_index END")), F.expr("count(*) div 2")).alias("handoff_at"))
    both = log.join(h, "session_id").withColumn("b", F.octet_length("payload"))
    return both.groupBy("session_id", "handoff_at").agg(F.sum(F.expr("CASE WHEN event_index <= handoff_at THEN b ELSE 0 END")).alias("bytes_before"), F.sum(F.expr("CASE WHEN event_index > handoff_at THEN b ELSE 0 END")).alias("bytes_after"))


#: Names of the checks of a handoff bundle, in order.
CHECKS = [
    "bundle_is_object", "bundle_version", "identity_match", "aid_present", "aid_digest_match", "trace_digest_compute", "trace_digest_match", "event_log_readable", "event_log_parse", "event_count_match", "event_range_match", "correction_count_match",
    "projection_correction_count_match", "valid_trace",
]
#: What the bundles say; some were changed, or are of another session or version.
_BUNDLE = {
    "is_object": "user_id % 29 <> 3", "version": "CASE WHEN user_id % 19 = 4 THEN 2 ELSE 1 END", "tenant": "CASE WHEN user_id % 23 = 6 THEN 'other' ELSE 'local' END", "aid_digest": "CASE WHEN user_id % 17 = 2 THEN 'x' ELSE 'aid-' || session_id END",
    "live_aid": "CASE WHEN user_id % 31 <> 7 THEN 'aid-' || session_id END", "proof_digest": "CASE WHEN user_id % 13 = 5 THEN '' WHEN user_id % 11 = 3 THEN reverse(digest) ELSE digest END", "trace_digest": "CASE WHEN user_id % 26 = 5 THEN '' ELSE digest END",
    "said": "n + CASE WHEN user_id % 14 = 1 THEN 1 ELSE 0 END", "range_start": "CASE WHEN user_id % 15 = 2 THEN 0 ELSE 1 END", "range_end": "n", "said_corrections": "corrections + CASE WHEN user_id % 16 = 3 THEN 1 ELSE 0 END", "proved": "user_id % 18 <> 4",
    "proved_corrections": "corrections - CASE WHEN user_id % 20 = 6 THEN 1 ELSE 0 END",
}
_SEEN = "CASE WHEN event_id % 211 = 0 THEN timestamp_us - 100000000000 ELSE timestamp_us END"
_DIGEST = "CASE WHEN proof_digest <> '' THEN proof_digest ELSE trace_digest END"


@query(
    "K13_bundle_checks",
    f"""WITH {A.EV_STREAM}, t AS (SELECT *, coalesce({_SEEN} < lag({_SEEN}) OVER (PARTITION BY session_id ORDER BY event_index), false) AS regressed FROM ev_stream),
live AS (SELECT session_id, user_id, count(*) AS n, sha256(string_agg(payload, chr(10) ORDER BY event_index)) AS digest, count(*) FILTER (type = 'correction') AS corrections, NOT bool_or(regressed) AS valid FROM t GROUP BY session_id, user_id),
b AS (SELECT session_id, n, digest, corrections, valid, {', '.join(f'{v} AS {k}' for k, v in _BUNDLE.items())} FROM live),
f AS (SELECT session_id, is_object, live_aid, concat_ws(',', CASE WHEN NOT is_object THEN 'bundle_is_object' END, CASE WHEN is_object AND version <> 1 THEN 'bundle_version' END, CASE WHEN is_object AND tenant <> 'local' THEN 'identity_match' END, CASE WHEN is_object AND live_aid IS NULL THEN 'aid_present' END) AS first,
  concat_ws(',', CASE WHEN aid_digest <> live_aid THEN 'aid_digest_match' END, CASE WHEN {_DIGEST} = '' THEN 'trace_digest_present' WHEN {_DIGEST} <> digest THEN 'trace_digest_match' END, CASE WHEN said <> n THEN 'event_count_match' END, CASE WHEN range_start <> 1 OR range_end <> n THEN 'event_range_match' END,
    CASE WHEN said_corrections <> corrections THEN 'correction_count_match' END, CASE WHEN NOT proved THEN 'projection_proof_present' WHEN proved_corrections <> corrections THEN 'projection_correction_count_match' END, CASE WHEN NOT valid THEN 'valid_trace' END) AS later FROM b)
SELECT session_id, CASE WHEN NOT is_object OR live_aid IS NULL OR later = '' THEN first WHEN first = '' THEN later ELSE first || ',' || later END AS failed, first = '' AND later = '' AND live_aid IS NOT NULL AS verified FROM f""",
)
def bundle_checks(spark, sf):
    """The named checks of a bundle, read back from its JSON, against the live log. What is no object, or has no identity
    document, is not checked further."""
    seen = F.expr(_SEEN)
    t = A.ev_stream(spark, sf).withColumn("seen", seen).withColumn("regressed", F.coalesce(F.col("seen") < F.lag("seen").over(Window.partitionBy("session_id").orderBy("event_index")), F.lit(False)))
    live = t.groupBy("session_id", "user_id").agg(F.count("*").alias("n"), F.expr("sha2(listagg(payload, '\n') WITHIN GROUP (ORDER BY event_index), 256)").alias("digest"), F.count_if(F.col("type") == "correction").alias("corrections"), (~F.bool_or("regressed")).alias("valid"))
    b = live.selectExpr("session_id", "n", "digest", "corrections", "valid", *[f"{v} AS {k}" for k, v in _BUNDLE.items()])
    proofs = F.filter(F.array(F.when(F.col("proof_digest") != "", F.struct(F.lit("event_log").alias("component_id"), F.col("proof_digest").alias("digest"), F.lit(None).cast("long").alias("correction_count"))), F.when(F.col("proved"), F.struct(F.lit("projection").alias("component_id"), F.lit(None).cast("string").alias("digest"), F.col("proved_corrections").alias("correction_count")))), lambda p: p.isNotNull())
    trace = F.struct(F.col("said").alias("event_count"), F.col("range_start").alias("event_range_start"), F.col("range_end").alias("event_range_end"), "trace_digest")
    written = F.when(F.col("is_object"), F.to_json(F.struct(F.col("version").alias("bundle_version"), F.col("tenant").alias("tenant_id"), "aid_digest", trace.alias("trace"), F.col("said_corrections").alias("corrections"), proofs.alias("component_proofs")))).otherwise("[]")
    kind = "bundle_version INT, tenant_id STRING, aid_digest STRING, trace STRUCT<event_count: BIGINT, event_range_start: BIGINT, event_range_end: BIGINT, trace_digest: STRING>, corrections BIGINT, component_proofs ARRAY<STRUCT<component_id: STRING, digest: STRING, correction_count: BIGINT>>"
    r = b.select("session_id", "n", "digest", "corrections", "valid", "live_aid", written.alias("j")).withColumn("b", F.from_json("j", kind)).withColumn("is_object", F.col("j").startswith("{"))
    r = r.withColumn("projection", F.try_element_at(F.filter("b.component_proofs", lambda p: p["component_id"] == "projection"), F.lit(1))).withColumn("said_digest", F.coalesce(F.nullif(F.try_element_at(F.filter("b.component_proofs", lambda p: p["component_id"] == "event_log"), F.lit(1))["digest"], F.lit("")), "b.trace.trace_digest"))
    c = F.col
    open_, on = c("is_object"), c("is_object") & c("live_aid").isNotNull()
    failed = [
        F.when(~open_, "bundle_is_object"), F.when(open_ & (c("b.bundle_version") != 1), "bundle_version"), F.when(open_ & (c("b.tenant_id") != "local"), "identity_match"), F.when(open_ & c("live_aid").isNull(), "aid_present"),
        F.when(on & (c("b.aid_digest") != c("live_aid")), "aid_digest_match"), F.when(on & (c("said_digest") == ""), "trace_digest_present").when(on & (c("said_digest") != c("digest")), "trace_digest_match"),
        F.when(on & (c("b.trace.event_count") != c("n")), "event_count_match"), F.when(on & ((c("b.trace.event_range_start") != 1) | (c("b.trace.event_range_end") != c("n"))), "event_range_match"), F.when(on & (c("b.corrections") != c("corrections")), "correction_count_match"),
        F.when(on & c("projection").isNull(), "projection_proof_present").when(on & (c("projection.correction_count") != c("corrections")), "projection_correction_count_match"), F.when(on & ~c("valid"), "valid_trace"),
    ]
    return r.withColumn("f", F.array_compact(F.array(*failed))).select("session_id", F.array_join("f", ",").alias("failed"), (F.size("f") == 0).alias("verified"))


@query("C14_tool_registry", "WITH reg(name, schema) AS (VALUES ('click', 'a'), ('view', 'b'), ('purchase', 'c')) SELECT event_id, event_type AS name, schema, CASE WHEN schema IS NULL THEN 'unknown tool' ELSE 'ok' END AS status FROM events LEFT JOIN reg ON reg.name = events.event_type")
def tool_registry(spark, sf):
    reg = spark.createDataFrame([("click", "a"), ("view", "b"), ("purchase", "c")], "name string, schema string")
    return A.table(spark, sf, "events").select("event_id", F.col("event_type").alias("name")).join(reg, "name", "left").select("event_id", "name", "schema", F.when(F.col("schema").isNull(), "unknown tool").otherwise("ok").alias("status"))


@query("E5_needles", "WITH d AS (SELECT doc_id, n_chars, unnest([0.22, 0.45, 0.66, 0.85]) AS f FROM documents) SELECT doc_id, CAST(floor(n_chars * f) AS BIGINT) AS at, 'needle-' || CAST(floor(n_chars * f) AS BIGINT) AS needle FROM d")
def needles(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "n_chars", F.explode(F.array(*[F.lit(x) for x in (0.22, 0.45, 0.66, 0.85)])).alias("f")).withColumn("at", F.floor(F.col("n_chars") * F.col("f")))
    return d.select("doc_id", "at", F.concat(F.lit("needle-"), "at").alias("needle"))


_H31_TAIL = {0: [(0xE2, None)], 1: [(0xE2, None), (None, "▁x")], 2: [(0xE2, None), (0x41, None), (0x82, None), (0xAC, None)], 3: [], 4: [(0xC3, None), (0xA9, None)]}


@query("H31_incomplete_bpe", "WITH t AS (SELECT doc_id, replace(coalesce(text, ''), ' ', '▁') || CASE doc_id % 5 WHEN 1 THEN chr(65533) || '▁x' WHEN 2 THEN 'A€' WHEN 4 THEN 'é' ELSE '' END AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE md5(t) END AS digest, doc_id % 5 <> 0 AS whole FROM t")
def incomplete_bpe(spark, sf):
    """Texts as pieces and bytes, some ending in whole, broken or incomplete characters, put together again."""
    token = lambda b, p: f"struct({'CAST(NULL AS INT)' if b is None else b} AS byte, {'CAST(NULL AS STRING)' if p is None else repr(p)} AS piece)"
    tail = F.expr("CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN array({', '.join(token(*t) for t in ts)})" for k, ts in _H31_TAIL.items() if ts) + f" ELSE slice(array({token(None, '')}), 1, 0) END")
    rows = decode.joined(A.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("said"), tail.alias("tokens")), "tokens", "said")
    return rows.select("doc_id", F.when(F.col("whole"), F.md5("text")).alias("digest"), "whole")


@query("H50_block_concat", "SELECT label, count(*) AS blocks, 256 * count(*) AS bytes FROM embeddings GROUP BY label")
def block_concat(spark, sf):
    """Binary blocks of 64 float32 each, concatenated in order of id."""
    import numpy as np

    @F.pandas_udf("binary")
    def encoded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.asarray(v, "<f4").tobytes())

    b = A.table(spark, sf, "embeddings").select("label", "vec_id", encoded("embedding").alias("b"))
    g = b.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "b"))).alias("all"))
    return g.select("label", F.size("all").cast("long").alias("blocks"), F.length(F.aggregate("all", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["b"]))).cast("long").alias("bytes"))


@query("H48_half_precision")
def half_precision(spark, sf):
    """Embeddings as 16-bit numbers and back: the bits, and the largest error."""
    import numpy as np

    from ..functions import halves

    @F.pandas_udf("struct<bits: binary, back: array<float>>")
    def both(x: pd.Series) -> pd.DataFrame:
        bits = [halves.encoded(np.asarray(v)) for v in x]
        return pd.DataFrame({"bits": [b.astype("<u2").tobytes() for b in bits], "back": [halves.decoded(b).tolist() for b in bits]})

    h = A.table(spark, sf, "embeddings").select("vec_id", "embedding", both("embedding").alias("h"))
    error = F.array_max(F.zip_with("embedding", "h.back", lambda a, b: F.abs(a - b)))
    return h.select("vec_id", F.hex("h.bits").alias("bits"), error.alias("error"))


_BOUND = {
    "branch_id": "'main'", "compaction_interval": "4", "architecture_tag": "'x86_64'", "producer_id": "'p\u00e9'", "runtime_version": "'1.0'", "artifact_hash": f"'{'ab' * 32}'", "model_id": "'m1'", "schema_id": "''", "schema_hash": f"'{'cd' * 32}'",
    "model_class": "1", "num_layers": "32", "num_kv_heads": "8", "head_dim": "128", "kv_dtype": "level", "base_event_index": "range_start",
}


def _bytes_sql(name: str, kind: str) -> str:
    def number(v: str, size: int) -> str:
        digits = f"lpad(printf('%x', CAST({v} AS BIGINT)), {2 * size}, '0')"
        return " || ".join(f"substr({digits}, {2 * k + 1}, 2)" for k in reversed(range(size)))

    if kind == "str":
        return f"{number(f'strlen({name})', 4)} || hex(encode({name}))"
    if kind == "hashes":
        return f"{number(f'len({name})', 4)} || array_to_string({name}, '')"
    if kind == "strs":
        return f"{number(f'len({name})', 4)} || array_to_string(list_transform({name}, lambda x: {number('strlen(x)', 4)} || hex(encode(x))), '')"
    if kind == "f64":  # 0 and 1
        return f"CASE WHEN {name} = 0 THEN '{'00' * 8}' ELSE '{struct.pack('<d', 1.0).hex()}' END"
    return name if kind == "hash" else number(name, 4 if kind == "u32" else 8)


_MANIFEST_SQL = f"""m AS (SELECT * EXCLUDE (w), w, {', '.join(f'{v} AS {k}' for k, v in _BOUND.items())} FROM ckpt), e AS (SELECT *, '{(K.MAGIC + K.VERSION.to_bytes(4, "little")).hex()}' || {' || '.join(_bytes_sql(n, k) for n, k in K.MANIFEST)} AS x FROM m)"""


@query("H62_manifest_codec", f"WITH {A.CKPT}, {_MANIFEST_SQL} SELECT hash, sha256(unhex(x)) AS digest, CAST(length(x) // 2 AS BIGINT) AS size, CASE w % 10 WHEN 3 THEN 'truncated' WHEN 5 THEN 'trailing' WHEN 7 THEN 'magic' ELSE '' END AS error, CASE WHEN w % 10 NOT IN (3, 5, 7) THEN session_id END AS session_id, CASE WHEN w % 10 NOT IN (3, 5, 7) THEN array_to_string(parent_hashes, ',') ELSE '' END AS parents, CASE WHEN w % 10 NOT IN (3, 5, 7) THEN range_end ELSE -1 END AS range_end, CASE WHEN w % 10 NOT IN (3, 5, 7) THEN created_us ELSE -1 END AS created_us FROM e")
def manifest_codec(spark, sf):
    """Canonical bytes, their hash, and what is read back of them; some were cut short, lengthened or begin otherwise."""
    m = A.ckpt(spark, sf).selectExpr("*", *[f"{v} AS {k}" for k, v in _BOUND.items()]).withColumn("x", K.encoded(K.MANIFEST))
    damaged = F.expr("CASE w % 10 WHEN 3 THEN substring(x, 1, length(x) - 1) WHEN 5 THEN concat(x, X'00') WHEN 7 THEN concat(X'00', x) ELSE x END")
    back = m.select("hash", damaged.alias("data")).mapInPandas(K.decode, "hash string, error string, session_id string, parents string, range_end long, created_us long")
    return m.select("hash", F.sha2("x", 256).alias("digest"), F.length("x").cast("long").alias("size")).join(back, "hash")


@query("A20_session_cases", "WITH c AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id AS case_id, n AS n_events, 'q' || last AS question, CASE WHEN conv_id % 2 = 0 THEN 'inline' ELSE 'hoisted' END AS must FROM c")
def session_cases(spark, sf):
    """Case JSON with the probe's rubric inside or hoisted beside it."""
    c = A.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    line = F.expr("concat('{\"case_id\":', conv_id, ',\"n_events\":', n, ',\"probe\":{\"question\":\"q', last, '\"', IF(conv_id % 2 = 0, ',\"rubric\":{\"must\":\"inline\"}', ',\"must\":\"hoisted\"'), '}}')")
    p = c.select(F.from_json(line, "case_id LONG, n_events LONG, probe STRUCT<question: STRING, rubric: STRUCT<must: STRING>, must: STRING>").alias("c"))
    return p.select("c.case_id", "c.n_events", "c.probe.question", F.coalesce("c.probe.rubric.must", "c.probe.must").alias("must"))


@query("A21_transcript_blocks", "WITH b AS (SELECT conv_id, turn, unnest([left(text, CAST(length(text) // 2 AS INTEGER)), substr(text, CAST(length(text) // 2 AS INTEGER) + 1)]) AS piece, unnest([0, 1]) AS k FROM conversations WHERE role <> 'system') SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS idx, CASE k WHEN 0 THEN 'text' ELSE 'tool_use' END AS kind, piece FROM b")
def transcript_blocks(spark, sf):
    """Messages of typed blocks, flattened; each block is an event of its own."""
    blocks = F.array(F.struct(F.lit("text").alias("kind"), F.expr("left(text, CAST(length(text) div 2 AS INT))").alias("piece")), F.struct(F.lit("tool_use").alias("kind"), F.expr("substr(text, CAST(length(text) div 2 AS INT) + 1)").alias("piece")))
    b = A.table(spark, sf, "conversations").filter("role <> 'system'").select("conv_id", "turn", F.posexplode(blocks).alias("k", "b"))
    return b.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "k")).cast("long") - 1).alias("idx"), "b.kind", "b.piece")


@query("A22_transcript_calls", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'message' WHEN 'assistant' THEN 'function_call' ELSE 'function_call_output' END AS item, CASE WHEN role = 'assistant' THEN 'call-' || turn END AS call_id FROM conversations")
def transcript_calls(spark, sf):
    line = F.to_json(F.struct(F.expr("CASE role WHEN 'user' THEN 'message' WHEN 'assistant' THEN 'function_call' ELSE 'function_call_output' END").alias("type"), F.when(F.col("role") == "assistant", F.concat(F.lit("call-"), "turn")).alias("call_id")))
    rows = A.table(spark, sf, "conversations").select("conv_id", "turn", F.from_json(line, "type STRING, call_id STRING").alias("j"))
    return rows.select("conv_id", "turn", F.col("j.type").alias("item"), "j.call_id")


@query("A29_validation_scan", f"WITH {A.RESULTS} SELECT doc_id % 4 AS file, count(*) AS lines, count(*) FILTER (status = 'errored' OR budget_chars > 2000) AS bad FROM results GROUP BY doc_id % 4")
def validation_scan(spark, sf):
    r = A.results(spark, sf).withColumn("valid", F.expr("status <> 'errored' AND budget_chars <= 2000"))
    return r.groupBy(F.expr("doc_id % 4").alias("file")).agg(F.count("*").alias("lines"), F.count_if(~F.col("valid")).alias("bad"))


@query("J13_eval_bridge", "WITH g AS (SELECT doc_id, left(text, coalesce(nullif(strpos(text, '. '), 0) - 1, length(text))::INT) AS generated, length(text) AS ll FROM documents) SELECT g.doc_id, generated, starts_with(generated, split_part(n.text, ' ', 1)) AS greedy, CAST(-length(split_part(n.text, ' ', 1)) AS BIGINT) AS log_likelihood FROM g LEFT JOIN documents n ON n.doc_id = g.doc_id + 1")
def eval_bridge(spark, sf):
    """generate_until: the text up to the stop. loglikelihood of a continuation, here the next text's first word: its score
    by the stand-in (a cost for each character), and whether the generation starts with it."""
    asked = A.table(spark, sf, "documents").selectExpr("doc_id - 1 AS doc_id", "split_part(text, ' ', 1) AS continuation")
    rows = A.table(spark, sf, "documents").select("doc_id", T.cut_at_stop(F.col("text"), [". "]).alias("generated")).join(asked, "doc_id", "left")
    return rows.select("doc_id", "generated", F.expr("startswith(generated, continuation)").alias("greedy"), F.expr("CAST(-length(continuation) AS BIGINT)").alias("log_likelihood"))


@query("H60_blake3")
def blake3(spark, sf):
    """Digests of the benchmark items."""
    from ..functions.blake3 import digest

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "digest": [digest(t.encode()) for t in b["text"]]})

    return A.table(spark, sf, "benchmark").select("item_id", "text").mapInPandas(run, "item_id long, digest string")


@query("H52_log_mel")
def log_mel(spark, sf):
    """Embeddings as signals of 64 samples: frames and their mel energies."""
    import numpy as np

    from ..functions.mel import log_mel as energies

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "mel": [energies(np.asarray(x)).astype("float32").ravel().tolist() for x in b["embedding"]]})

    return A.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, mel array<float>")


_PIECES = "CASE conv_id % 3 WHEN 0 THEN left(text, 30) || '<think>' || substr(text, 31, 20) || '</think>' || substr(text, 51) WHEN 1 THEN left(text, 30) || '<think>' || substr(text, 31) ELSE text END"


@query("I4_channel_split", rf"WITH c AS (SELECT conv_id, turn, {_PIECES} AS t FROM conversations) SELECT conv_id, turn, array_to_string(regexp_extract_all(t, '(?s)<think>(.*?)(?:</think>|$)', 1), '') AS channel, regexp_replace(t, '(?s)<think>.*?(</think>|$)', '', 'g') AS text FROM c")
def channel_split(spark, sf):
    """Texts in pieces of five characters through the step of the streaming splitter."""
    from ..streaming.state import split_channels

    def run(batches):
        for b in batches:
            rows = []
            for conv, turn, t in zip(b["conv_id"], b["turn"], b["t"]):
                buffer, inside, out = "", False, {"channel": "", "text": ""}
                for at in range(0, len(t), 5):
                    parts, buffer, inside = split_channels(buffer + t[at : at + 5], inside, "<think>", "</think>", at + 5 >= len(t))
                    for where, piece in parts:
                        out[where] += piece
                rows.append((conv, turn, out["channel"], out["text"]))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "channel", "text"])

    return A.table(spark, sf, "conversations").selectExpr("conv_id", "turn", _PIECES + " AS t").mapInPandas(run, "conv_id long, turn long, channel string, text string")


@query("I7_hook_loop", f"WITH {A.EV_STREAM}, s AS (SELECT *, sum(CASE WHEN type = 'correction' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_index) AS active FROM ev_stream) SELECT session_id, event_index, CASE type WHEN 'correction' THEN 'remember' WHEN 'tool' THEN CASE WHEN active >= 10 THEN 'deny' ELSE 'allow' END WHEN 'model' THEN 'checkpoint' ELSE 'note' END AS action FROM s")
def hook_loop(spark, sf):
    """Each hook's answer given the session's state so far: with ten corrections active, tools are denied."""
    seen = Window.partitionBy("session_id").orderBy("event_index")
    active = F.sum(F.expr("CAST(type = 'correction' AS INT)")).over(seen)
    action = F.when(F.col("type") == "correction", "remember").when(F.col("type") == "tool", F.when(F.col("active") >= 10, "deny").otherwise("allow")).when(F.col("type") == "model", "checkpoint").otherwise("note")
    return A.ev_stream(spark, sf).withColumn("active", active).select("session_id", "event_index", action.alias("action"))
