"""Queries over checkpoints, payloads, provenance and compaction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph
from ..operators.shared import written
from ..sources import adapters as A

W = f"WITH {A.CKPT}"
WR = f"WITH RECURSIVE {A.CKPT}"


@query("A13_payload_store", "WITH p AS (SELECT doc_id, text, sha256(text) AS body_hash FROM documents) SELECT body_hash, min(doc_id) AS first_doc, count(*) AS puts, count(DISTINCT text) AS bodies, max(strlen(text)) AS size, true AS verified FROM p GROUP BY body_hash")
def payload_store(spark, sf):
    """Content-addressed puts: one body per hash, verified on read."""
    p = A.table(spark, sf, "documents").select("doc_id", "text", F.sha2("text", 256).alias("body_hash"))
    kept = p.groupBy("body_hash").agg(F.min_by("text", "doc_id").alias("body"), F.min("doc_id").alias("first_doc"), F.count("*").alias("puts"), F.count_distinct("text").alias("bodies"))
    return kept.select("body_hash", "first_doc", "puts", "bodies", F.octet_length("body").alias("size"), (F.sha2("body", 256) == F.col("body_hash")).alias("verified"))


@query("A14_manifests", f"{W} SELECT session_id, level, hash, range_start, range_end FROM ckpt")
def manifests(spark, sf):
    return A.ckpt(spark, sf).select("session_id", "level", "hash", "range_start", "range_end")


@query("A15_dependents", f"{W} SELECT parent, count(*) AS dependents, min(hash) AS first FROM (SELECT hash, unnest(parent_hashes) AS parent FROM ckpt) GROUP BY parent")
def dependents(spark, sf):
    return A.ckpt(spark, sf).select("hash", F.explode("parent_hashes").alias("parent")).groupBy("parent").agg(F.count("*").alias("dependents"), F.min("hash").alias("first"))


_CHUNKS = """chunks AS (SELECT doc_id, k, k * 500 AS start, least(500, n_chars - k * 500) AS size, n_chars AS declared FROM (SELECT doc_id, n_chars, unnest(generate_series(0, (n_chars - 1) // 500)) AS k FROM documents) WHERE NOT (doc_id % 9 = 4 AND k = 1))"""


@query("A16_chunked_upload", f"WITH {_CHUNKS}, w AS (SELECT *, start = coalesce(lag(start + size) OVER (PARTITION BY doc_id ORDER BY k), 0) AS follows FROM chunks) SELECT doc_id, count(*) AS frames, CAST(sum(size) AS BIGINT) AS received, bool_and(follows) AS contiguous, sum(size) = max(declared) AS complete, bool_and(follows) AND sum(size) = max(declared) AS committed FROM w GROUP BY doc_id")
def chunked_upload(spark, sf):
    rows = A.table(spark, sf, "documents").selectExpr("doc_id", "n_chars AS declared", "explode(sequence(0L, (n_chars - 1) div 500)) AS k").filter("NOT (doc_id % 9 = 4 AND k = 1)")
    rows = rows.selectExpr("doc_id", "declared", "k", "k * 500 AS start", "least(500, declared - k * 500) AS size")
    order = Window.partitionBy("doc_id").orderBy("k")
    rows = rows.withColumn("follows", F.col("start") == F.coalesce(F.lag(F.col("start") + F.col("size")).over(order), F.lit(0)))
    out = rows.groupBy("doc_id").agg(F.count("*").alias("frames"), F.sum("size").alias("received"), F.bool_and("follows").alias("contiguous"), (F.sum("size") == F.max("declared")).alias("complete"))
    return out.withColumn("committed", F.col("contiguous") & F.col("complete"))


@query("A18_dag_nodes", f"{W} SELECT hash, len(parent_hashes) AS parents, created_us, len(parent_hashes) <= 65535 AS accepted FROM ckpt")
def dag_nodes(spark, sf):
    return A.ckpt(spark, sf).select("hash", F.size("parent_hashes").alias("parents"), "created_us", (F.size("parent_hashes") <= 65535).alias("accepted"))


@query("C5_payload_integrity", f"{W}, pay AS (SELECT DISTINCT body_hash, CASE WHEN w % 10 = 3 THEN sha256('broken') ELSE body_hash END AS actual FROM ckpt WHERE level = 0 AND w % 10 <> 7) SELECT c.hash, CASE WHEN p.actual IS NULL THEN 'missing' WHEN p.actual <> c.body_hash THEN 'mismatch' ELSE 'ok' END AS verdict FROM ckpt c LEFT JOIN pay p USING (body_hash) WHERE c.level = 0")
def payload_integrity(spark, sf):
    c = A.ckpt(spark, sf).filter("level = 0")
    p = c.filter("w % 10 <> 7").selectExpr("body_hash", "CASE WHEN w % 10 = 3 THEN sha2('broken', 256) ELSE body_hash END AS actual").distinct()
    return c.join(p, "body_hash", "left").selectExpr("hash", "CASE WHEN actual IS NULL THEN 'missing' WHEN actual <> body_hash THEN 'mismatch' ELSE 'ok' END AS verdict")


#: A deeper graph than two levels: each level-0 checkpoint also depends on the one before, in runs of 8.
_EDGES = """edges AS (SELECT unnest(parent_hashes) AS src, hash AS dst FROM ckpt WHERE level = 1
  UNION SELECT a.hash, b.hash FROM ckpt a JOIN ckpt b ON a.session_id = b.session_id AND a.level = 0 AND b.level = 0 AND b.w = a.w + 1 AND b.w % 8 <> 0)"""


def _edges(spark, sf):
    c = A.ckpt(spark, sf)
    up = c.filter("level = 1").select(F.explode("parent_hashes").alias("src"), F.col("hash").alias("dst"))
    zero = c.filter("level = 0").select("session_id", "w", "hash")
    chain = zero.selectExpr("session_id", "w + 1 AS w", "hash AS src").join(zero.filter("w % 8 <> 0").selectExpr("session_id", "w", "hash AS dst"), ["session_id", "w"])
    return written(up.unionByName(chain.select("src", "dst")).distinct(), "edges")


@query("C6_invalidation_closure", f"{WR}, {_EDGES}, r AS (SELECT hash AS seed, hash AS node FROM ckpt WHERE level = 0 AND w % 5 = 1 UNION SELECT r.seed, e.dst FROM r JOIN edges e ON e.src = r.node) SELECT seed, count(*) - 1 AS invalidated FROM r GROUP BY seed")
def invalidation_closure(spark, sf):
    seeds = A.ckpt(spark, sf).filter("level = 0 AND w % 5 = 1").selectExpr("hash AS seed", "hash AS node")
    return graph.reachable(_edges(spark, sf), seeds).groupBy("seed").agg((F.count("*") - 1).alias("invalidated"))


@query("C7_provenance", f"{WR}, {_EDGES}, r AS (SELECT hash AS seed, hash AS node, 0 AS level FROM ckpt WHERE level = 1 UNION SELECT r.seed, e.src, r.level + 1 FROM r JOIN edges e ON e.dst = r.node), m AS (SELECT seed, node, min(level) AS level FROM r GROUP BY seed, node) SELECT seed, sha256(string_agg(node, ',' ORDER BY level, node)) AS ancestors, count(*) AS n, max(level) AS depth FROM m GROUP BY seed")
def provenance(spark, sf):
    """Ancestors by level, then hash."""
    back = _edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = A.ckpt(spark, sf).filter("level = 1").selectExpr("hash AS seed", "hash AS node")
    found = graph.reachable(back, seeds)
    return found.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("level", "node"))).alias("a")).selectExpr("seed", "sha2(array_join(transform(a, x -> x.node), ','), 256) AS ancestors", "CAST(size(a) AS BIGINT) AS n", "array_max(transform(a, x -> x.level)) AS depth")


@query("C9_event_checkpoint", f"{W} SELECT e.session_id, e.event_index, c.hash FROM ev_stream e JOIN ckpt c ON c.session_id = e.session_id AND c.level = 1 AND e.event_index >= c.range_start AND e.event_index < c.range_end")
def event_checkpoint(spark, sf):
    c = A.ckpt(spark, sf).filter("level = 1").select("session_id", "range_start", "range_end", "hash")
    return A.ev_stream(spark, sf).join(c, "session_id").filter("event_index >= range_start AND event_index < range_end").select("session_id", "event_index", "hash")


@query("D24_compaction", f"{W} SELECT session_id, count(*) FILTER (level > 0) AS deltas, CAST(coalesce(sum(body_size) FILTER (level > 0), 0) AS BIGINT) AS bytes, count(*) FILTER (level > 0) >= 3 OR coalesce(sum(body_size) FILTER (level > 0), 0) >= 700 AS compact FROM ckpt GROUP BY session_id")
def compaction(spark, sf):
    """Whether a session's delta levels are many or large enough to be merged; the base level does not count."""
    delta = F.when(F.col("level") > 0, F.col("body_size"))
    out = A.ckpt(spark, sf).groupBy("session_id").agg(F.count(delta).alias("deltas"), F.coalesce(F.sum(delta), F.lit(0)).alias("bytes"))
    return out.withColumn("compact", (F.col("deltas") >= 3) | (F.col("bytes") >= 700))


@query("E10_rollup_coverage", f"{W}, ch AS (SELECT session_id, w // 4 AS p, range_start, range_end, lag(range_end) OVER (PARTITION BY session_id, w // 4 ORDER BY range_start) AS before FROM ckpt WHERE level = 0 AND NOT (w % 13 = 2)), g AS (SELECT session_id, p, min(range_start) AS lo, max(range_end) AS hi, bool_and(before IS NULL OR before = range_start) AS tiled FROM ch GROUP BY session_id, p) SELECT c.session_id, c.w, coalesce(g.tiled AND g.lo = c.range_start AND g.hi = c.range_end, false) AS covered FROM ckpt c LEFT JOIN g ON g.session_id = c.session_id AND g.p = c.w WHERE c.level = 1")
def rollup_coverage(spark, sf):
    """Children, some of them missing, must tile their parent."""
    c = A.ckpt(spark, sf)
    ch = c.filter("level = 0 AND w % 13 <> 2").withColumn("p", F.expr("w div 4"))
    ch = ch.withColumn("before", F.lag("range_end").over(Window.partitionBy("session_id", "p").orderBy("range_start")))
    g = ch.groupBy("session_id", F.col("p").alias("w")).agg(F.min("range_start").alias("lo"), F.max("range_end").alias("hi"), F.expr("bool_and(before IS NULL OR before = range_start)").alias("tiled"))
    return c.filter("level = 1").join(g, ["session_id", "w"], "left").selectExpr("session_id", "w", "coalesce(tiled AND lo = range_start AND hi = range_end, false) AS covered")


@query("E12_delta_chain", f"WITH {A.EV_STREAM}, s AS (SELECT *, count(*) FILTER (type = 'model') OVER (PARTITION BY session_id ORDER BY event_index) AS seg FROM ev_stream), l AS (SELECT *, max(seg) OVER (PARTITION BY session_id) AS last FROM s) SELECT session_id, string_agg(payload, ';' ORDER BY event_index) AS state FROM l WHERE seg = last GROUP BY session_id")
def delta_chain(spark, sf):
    """A base resets the state, deltas append: only the last segment is kept."""
    order = Window.partitionBy("session_id").orderBy("event_index")
    rows = A.ev_stream(spark, sf).withColumn("seg", F.sum(F.expr("CAST(type = 'model' AS INT)")).over(order)).withColumn("last", F.max("seg").over(Window.partitionBy("session_id")))
    return rows.filter("seg = last").groupBy("session_id").agg(F.expr("listagg(payload, ';') WITHIN GROUP (ORDER BY event_index)").alias("state"))


@query("E9_chunk_windows", f"WITH {A.EV_CONV} SELECT session_id, event_index // 8 AS chunk, count(*) AS n, string_agg(payload, '|' ORDER BY event_index) AS summary FROM ev_conv GROUP BY session_id, event_index // 8")
def chunk_windows(spark, sf):
    rows = A.ev_conv(spark, sf).selectExpr("session_id", "event_index div 8 AS chunk", "event_index", "payload AS head")
    return rows.groupBy("session_id", "chunk").agg(F.count("*").alias("n"), F.expr("listagg(head, '|') WITHIN GROUP (ORDER BY event_index)").alias("summary"))


@query("H61_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("H64_row_fingerprint", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS fingerprint FROM events""")
def row_fingerprint(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("fingerprint"))


@query("H65_correction_id", f"{W} SELECT hash, 'corr-' || substr(sha256('correction:' || hash || ':' || body_hash || ':' || created_us), 1, 32) AS correction_id FROM ckpt")
def correction_id(spark, sf):
    return A.ckpt(spark, sf).selectExpr("hash", "concat('corr-', substr(sha2(concat('correction:', hash, ':', body_hash, ':', created_us), 256), 1, 32)) AS correction_id")


@query("I9_task_states", f"""{WR}, {_EDGES}, bad AS (SELECT hash, CASE WHEN w % 10 = 3 THEN 'failed' ELSE 'cancelled' END AS how FROM ckpt WHERE level = 0 AND w % 10 IN (3, 6)),
r AS (SELECT hash AS node, how, 0 AS level FROM bad UNION SELECT e.dst, r.how, 1 FROM r JOIN edges e ON e.src = r.node)
SELECT c.hash, CASE WHEN b.how IS NOT NULL THEN b.how WHEN bool_or(r.how = 'failed') THEN 'dependent_failed' WHEN bool_or(r.how = 'cancelled') THEN 'dependent_cancelled' ELSE 'done' END AS state
FROM ckpt c LEFT JOIN bad b ON b.hash = c.hash LEFT JOIN r ON r.node = c.hash AND r.level = 1 GROUP BY c.hash, b.how""")
def task_states(spark, sf):
    """Failures and cancellations reach all transitive followers; failure weighs more."""
    c = A.ckpt(spark, sf)
    bad = c.filter("level = 0 AND w % 10 IN (3, 6)").selectExpr("hash", "CASE WHEN w % 10 = 3 THEN 'failed' ELSE 'cancelled' END AS how")
    hit = graph.reachable(_edges(spark, sf), bad.selectExpr("how AS seed", "hash AS node")).filter("level > 0").groupBy(F.col("node").alias("hash")).agg(F.bool_or(F.col("seed") == "failed").alias("failed"))
    # a node that failed by itself starts at level 0 but may also follow another: its own state wins
    return c.select("hash").join(bad, "hash", "left").join(hit, "hash", "left").selectExpr("hash", "CASE WHEN how IS NOT NULL THEN how WHEN failed THEN 'dependent_failed' WHEN NOT failed THEN 'dependent_cancelled' ELSE 'done' END AS state")
