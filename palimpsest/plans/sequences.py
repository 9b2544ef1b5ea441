"""Queries over token sequences, logits and embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import arrays as V
from ..operators.plugins import Constraint
from ..sources import adapters as A

_X = "x AS (SELECT vec_id, [v::DOUBLE for v in embedding] AS x FROM embeddings)"
#: A logit with its place, one row each: what SQL has instead of functions over arrays.
_L = "l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def _emb(spark, sf):
    return A.table(spark, sf, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("x"))


@query("F1_top_k", f"WITH {_L}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM l) SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY n) FILTER (n <= 5) AS top5, max(CASE WHEN n = 1 THEN i END) AS best FROM r GROUP BY vec_id")
def top_k(spark, sf):
    return _emb(spark, sf).select("vec_id", F.array_join(F.transform(V.top_k(F.col("x"), 5), lambda i: i.cast("string")), ",").alias("top5"), V.argmax(F.col("x")).alias("best"))


@query("F7_work_groups", "SELECT doc_id, n_chars // 512 AS full_groups, n_chars % 512 AS rest, CASE WHEN n_chars % 512 = 0 THEN NULL WHEN n_chars % 512 <= 32 THEN 32 WHEN n_chars % 512 <= 128 THEN 128 ELSE 512 END AS last_group FROM documents")
def work_groups(spark, sf):
    sizes = F.array(F.lit(32), F.lit(128), F.lit(512))
    rest = F.expr("n_chars % 512")
    return A.table(spark, sf, "documents").select("doc_id", F.expr("n_chars div 512").alias("full_groups"), rest.alias("rest"), F.when(rest > 0, F.array_min(F.filter(sizes, lambda s: s >= F.expr("n_chars % 512")))).alias("last_group"))


@query("H40_softmax", f"WITH {_L}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM l), t AS (SELECT * FROM r WHERE n <= 8), e AS (SELECT *, exp((v - max(v) OVER (PARTITION BY vec_id)) / 0.7) AS e FROM t) SELECT vec_id, round(max(e) / sum(e), 6) AS p_first, round(min(e) / sum(e), 6) AS p_last FROM e GROUP BY vec_id")
def softmax(spark, sf):
    """Over the eight greatest logits, at temperature 0.7."""
    rows = _emb(spark, sf).withColumn("top", F.slice(F.reverse(F.array_sort("x")), 1, 8)).withColumn("p", V.softmax(F.col("top"), 0.7))
    return rows.select("vec_id", F.round(F.array_max("p"), 6).alias("p_first"), F.round(F.array_min("p"), 6).alias("p_last"))


@query("H41_nucleus", f"WITH {_L}, e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM l), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS UNBOUNDED PRECEDING) - p AS before FROM p) SELECT vec_id, count(*) FILTER (before < 0.3) AS kept FROM c GROUP BY vec_id")
def nucleus(spark, sf):
    """Size of the smallest set with a mass of 0.3."""
    return _emb(spark, sf).withColumn("p", F.reverse(F.array_sort(V.softmax(F.col("x"))))).select("vec_id", V.nucleus(F.col("p"), 0.3).alias("kept"))


@query("H42_log_scores", f"WITH {_L}, e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM l) SELECT vec_id, round(max(ln(e)) - ln(sum(e)), 6) AS log_score FROM e GROUP BY vec_id")
def log_scores(spark, sf):
    return _emb(spark, sf).select("vec_id", F.round(F.ln(F.array_max(V.softmax(F.col("x")))), 6).alias("log_score"))


@query("H43_log_likelihood", f"WITH {_L}, m AS (SELECT vec_id, max(v) AS m FROM l GROUP BY vec_id), z AS (SELECT vec_id, m + ln(sum(exp(v - m))) AS z FROM l JOIN m USING (vec_id) GROUP BY vec_id, m) SELECT vec_id, round(v - z, 6) AS ll FROM l JOIN z USING (vec_id) WHERE i = vec_id % 64")
def log_likelihood(spark, sf):
    return _emb(spark, sf).select("vec_id", F.round(F.element_at("x", (F.col("vec_id") % 64 + 1).cast("int")) - V.log_sum_exp(F.col("x")), 6).alias("ll"))


@query("H44_sequence_scores", f"WITH {_L}, m AS (SELECT vec_id, max(v) AS m FROM l GROUP BY vec_id), z AS (SELECT vec_id, m + ln(sum(exp(v - m))) AS z FROM l JOIN m USING (vec_id) GROUP BY vec_id, m), s AS (SELECT vec_id // 10 AS target, vec_id % 10 AS step, v - z AS ll FROM l JOIN z USING (vec_id) WHERE i = vec_id % 64) SELECT target, round(sum(ll), 5) AS score, count(*) AS token_length FROM s WHERE step < 3 + target % 7 GROUP BY target")
def sequence_scores(spark, sf):
    """Each target counts its own length only."""
    rows = _emb(spark, sf).withColumn("ll", F.element_at("x", (F.col("vec_id") % 64 + 1).cast("int")) - V.log_sum_exp(F.col("x"))).selectExpr("vec_id div 10 AS target", "vec_id % 10 AS step", "ll")
    return rows.filter("step < 3 + target % 7").groupBy("target").agg(F.round(F.sum("ll"), 5).alias("score"), F.count("*").alias("token_length"))


@query("H45_mean_score", "SELECT label, coalesce(avg(CASE WHEN label <> 3 THEN embedding[1]::DOUBLE END), '-infinity'::DOUBLE) AS mean FROM embeddings GROUP BY label")
def mean_score(spark, sf):
    return _emb(spark, sf).groupBy("label").agg(F.coalesce(F.avg(F.when(F.col("label") != 3, F.col("x")[0])), F.lit(-math.inf)).alias("mean"))


_STOP = ["event_id", "event_type = 'signup' AS hit_stop", "CASE WHEN user_id % 4 = 0 THEN 30 ELSE 0 END AS benchmark_steps", "CAST(floor(value) AS INT) AS decoded", "CAST(floor(value * 2) AS INT) AS step", "100 AS most_tokens", "40 + user_id % 30 AS most_output"]


@query("H46_stop_ladder", f"SELECT event_id, CASE WHEN hit_stop AND benchmark_steps = 0 THEN 'stop_token' WHEN benchmark_steps > 0 AND decoded >= benchmark_steps THEN 'benchmark' WHEN step >= most_tokens THEN 'max_tokens' WHEN decoded >= most_output THEN 'max_output' ELSE 'continue' END AS rule FROM (SELECT {', '.join(_STOP)} FROM events)")
def stop_ladder(spark, sf):
    """A stop token ends a run unless a benchmark asks for a number of steps; then that number, the cache's size, the output's."""
    e, c = A.table(spark, sf, "events").selectExpr(*_STOP), F.col
    rule = F.when(c("hit_stop") & (c("benchmark_steps") == 0), "stop_token").when((c("benchmark_steps") > 0) & (c("decoded") >= c("benchmark_steps")), "benchmark").when(c("step") >= c("most_tokens"), "max_tokens").when(c("decoded") >= c("most_output"), "max_output")
    return e.select("event_id", F.coalesce(rule, F.lit("continue")).alias("rule"))


@query("H47_quantise", f"WITH {_L}, s AS (SELECT vec_id, max(abs(v)) / 127.0::DOUBLE AS scale FROM l GROUP BY vec_id) SELECT vec_id, round(scale, 9) AS scale, CAST(sum(round_even(v / scale, 0)) AS BIGINT) AS q_sum, max(abs(v - round_even(v / scale, 0) * scale)) <= scale / 2 + 1e-12 AS bounded FROM l JOIN s USING (vec_id) GROUP BY vec_id, scale")
def quantise(spark, sf):
    rows = _emb(spark, sf).withColumn("s", V.quantised(F.col("x")))
    error = F.array_max(F.transform(F.arrays_zip(F.col("x").alias("x"), F.col("s.q").alias("q")), lambda p: F.abs(p["x"] - p["q"] * F.col("s.scale"))))
    return rows.select("vec_id", F.round("s.scale", 9).alias("scale"), F.aggregate("s.q", F.lit(0).cast("long"), lambda a, v: a + v).alias("q_sum"), (error <= F.col("s.scale") / 2 + 1e-12).alias("bounded"))


@query("H49_encoded_size", "SELECT vec_id, len(embedding) * CASE vec_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 4 END + CASE WHEN vec_id % 4 = 2 THEN 2 ELSE 0 END AS bytes FROM embeddings")
def encoded_size(spark, sf):
    width = F.create_map(F.lit(0), F.lit(4), F.lit(1), F.lit(2), F.lit(2), F.lit(1), F.lit(3), F.lit(4))
    kind = (F.col("vec_id") % 4).cast("int")
    return _emb(spark, sf).select("vec_id", (F.size("x") * width[kind] + F.when(kind == 2, 2).otherwise(0)).alias("bytes"))


@query("H57_argmax", f"WITH {_L} SELECT vec_id, arg_max(i, (v, -i)) AS at, arg_max(i, (floor(v * 127), -i)) AS at_int8 FROM l GROUP BY vec_id")
def argmax(spark, sf):
    return _emb(spark, sf).select("vec_id", V.argmax(F.col("x")).alias("at"), V.argmax(F.transform("x", lambda v: F.floor(v * 127))).alias("at_int8"))


@query("H36_logit_mask", f"WITH {_L}, m AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 3 > 0 THEN v ELSE -3.4028234663852886e38 END AS v FROM l) SELECT vec_id, arg_max(i, (v, -i)) AS best, count(*) FILTER (v < -1e38) AS masked FROM m GROUP BY vec_id")
def logit_mask(spark, sf):
    masked = F.transform("x", lambda v, i: F.when((F.col("vec_id") + i) % 3 > 0, v).otherwise(V.LOWEST))
    return _emb(spark, sf).withColumn("m", masked).select("vec_id", V.argmax(F.col("m")).alias("best"), F.size(F.filter("m", lambda v: v < -1e38)).alias("masked"))


_TOK = "t AS (SELECT user_id, list(CAST(floor(value) AS INTEGER) % 4 ORDER BY event_id) AS toks FROM events GROUP BY user_id)"


def _tokens(spark, sf):
    e = A.table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.expr("CAST(floor(value) AS INT) % 4").alias("t")))).alias("s"))
    return e.select("user_id", F.transform("s", lambda x: x["t"]).alias("toks"))


#: Any token, then ones or twos, then a three; after an end it starts anew.
_GRAMMAR = Constraint(0, {(0, 0): 1, (0, 1): 1, (0, 2): 1, (0, 3): 1, (1, 1): 1, (1, 2): 1, (1, 3): 2, (1, 0): 2}, frozenset({2}))


@query("H37_constraint", f"""WITH RECURSIVE {_TOK}, g(s, k, z) AS (VALUES {', '.join(f'({s}, {k}, {z})' for (s, k), z in _GRAMMAR.steps.items())}),
r AS (SELECT user_id, toks, 0 AS state, 0 AS accepted, 0 AS restarts FROM t UNION ALL SELECT r.user_id, r.toks, g.z, r.accepted + 1, r.restarts + (r.state = 2)::INT FROM r JOIN g ON g.s = CASE WHEN r.state = 2 THEN 0 ELSE r.state END AND g.k = r.toks[r.accepted + 1] WHERE r.accepted < len(r.toks))
SELECT user_id, max(accepted) AS accepted, arg_max(state, accepted) AS state, max(restarts) AS restarts, arg_max(state, accepted) = 2 AS ended FROM r GROUP BY user_id""")
def constraint(spark, sf):
    """Each user's tokens through the automaton: how many it takes, where it is then, how often it began anew."""
    r = _tokens(spark, sf).select("user_id", _GRAMMAR.run(F.col("toks")).alias("r"))
    return r.select("user_id", "r.accepted", "r.state", "r.restarts", "r.ended")


@query("H32_merge_ids", f"WITH {_TOK} SELECT user_id, len(list_concat(toks, toks[1:2])) AS n, list_concat(toks, toks[1:2])[-1] AS last FROM t")
def merge_ids(spark, sf):
    return _tokens(spark, sf).withColumn("m", F.concat("toks", F.slice("toks", 1, 2))).select("user_id", F.size("m").alias("n"), F.element_at("m", -1).alias("last"))


@query("H33_prepend_bos", f"WITH {_TOK} SELECT user_id, len(toks) + 1 AS n, len(toks) + 1 > 70 AS rejected, 2 AS first FROM t")
def prepend_bos(spark, sf):
    return _tokens(spark, sf).withColumn("m", F.array_insert("toks", 1, F.lit(2))).select("user_id", F.size("m").alias("n"), (F.size("m") > 70).alias("rejected"), F.col("m")[0].alias("first"))


@query("H34_stop_found", f"WITH {_TOK} SELECT user_id, list_has_any(toks[1:4], [3]) AS found FROM t")
def stop_found(spark, sf):
    return _tokens(spark, sf).select("user_id", F.arrays_overlap(F.slice("toks", 1, 4), F.array(F.lit(3))).alias("found"))


@query("H35_stop_detector", f"""WITH RECURSIVE {_TOK}, s AS (SELECT user_id, toks, 0 AS m, 0 AS n, -1 AS hit FROM t UNION ALL
  SELECT user_id, toks, CASE WHEN [1, 1, 2][m + 1] = toks[n + 1] THEN (m + 1) % 3 WHEN toks[n + 1] = 1 THEN 1 ELSE 0 END, n + 1, CASE WHEN m = 2 AND toks[n + 1] = 2 THEN n + 1 ELSE -1 END FROM s WHERE n < len(toks) AND hit < 0)
SELECT user_id, max(hit) AS hit FROM s GROUP BY user_id""")
def stop_detector(spark, sf):
    """Stop sequence 1 1 2, with the restarts of the detector."""
    return _tokens(spark, sf).select("user_id", V.stop_detector(F.col("toks"), [1, 1, 2]).alias("hit"))


@query("H55_speculative_verify", f"WITH {_TOK}, d AS (SELECT user_id, toks[1:8] AS draft, toks[9:16] AS target FROM t), p AS (SELECT user_id, draft, target, unnest(generate_series(1, 9)) AS k FROM d) SELECT user_id, min(k) - 1 AS accepted, (min(k) - 1)::DOUBLE / 8 AS ratio FROM p WHERE k = 9 OR draft[k] IS DISTINCT FROM target[k] GROUP BY user_id")
def speculative_verify(spark, sf):
    rows = _tokens(spark, sf).withColumn("a", V.agreed(F.slice("toks", 1, 8), F.slice("toks", 9, 8)))
    return rows.select("user_id", F.col("a").alias("accepted"), (F.col("a") / F.lit(8.0)).alias("ratio"))


@query("E13_rollback", f"WITH {_TOK} SELECT user_id, len(toks[1:20]) AS n, toks[20] AS last, toks[5] AS at_five FROM t")
def rollback(spark, sf):
    return _tokens(spark, sf).withColumn("k", F.slice("toks", 1, 20)).select("user_id", F.size("k").alias("n"), F.try_element_at("k", F.lit(20)).alias("last"), F.try_element_at("k", F.lit(5)).alias("at_five"))


@query("H58_attention_mask", "WITH q AS (SELECT user_id, count(*) AS step FROM events GROUP BY user_id), g AS (SELECT user_id, step, unnest(generate_series(0, 3)) AS q FROM q), m AS (SELECT user_id, q, step + q AS pos, unnest(generate_series(0, step + 3)) AS k, step FROM g) SELECT user_id, q, count(*) FILTER (k < step OR k - step <= q) AS global_on, count(*) FILTER ((k < step OR k - step <= q) AND k >= pos - 15) AS local_on FROM m GROUP BY user_id, q")
def attention_mask(spark, sf):
    """Positions seen by each of four new tokens: causal, and within a window of 16."""
    q = A.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("step")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    keys = F.sequence(F.lit(0).cast("long"), F.col("step") + 3)
    on = F.filter(keys, lambda k: (k < F.col("step")) | (k - F.col("step") <= F.col("q")))
    return q.select("user_id", "q", F.size(on).alias("global_on"), F.size(F.filter(on, lambda k: k >= F.col("step") + F.col("q") - 15)).alias("local_on"))


@query("H59_buffer_expand", "SELECT vec_id, 80 AS n, round(list_sum([v::DOUBLE for v in embedding]), 4) AS s FROM embeddings")
def buffer_expand(spark, sf):
    padded = F.concat("x", F.array_repeat(F.lit(0.0), 16))
    return _emb(spark, sf).select("vec_id", F.size(padded).alias("n"), F.round(V.total(padded), 4).alias("s"))


@query("E15_smoothing", f"WITH RECURSIVE {_X}, s AS (SELECT vec_id, x, 1 AS k, x[1] AS y, x[1] AS total FROM x UNION ALL SELECT vec_id, x, k + 1, 0.3 * x[k + 1] + (1 - 0.3::DOUBLE) * y, total + 0.3 * x[k + 1] + (1 - 0.3::DOUBLE) * y FROM s WHERE k < len(x)) SELECT vec_id, round(arg_max(y, k), 6) AS last, round(arg_max(total, k), 5) AS total FROM s GROUP BY vec_id")
def smoothing(spark, sf):
    rows = _emb(spark, sf).withColumn("y", V.smoothed(F.col("x"), 0.3))
    return rows.select("vec_id", F.round(F.element_at("y", -1), 6).alias("last"), F.round(V.total(F.col("y")), 5).alias("total"))


@query("G8_embedding_concat", "SELECT label, count(*) * 64 AS n, round(sum(list_sum([v::DOUBLE for v in embedding])), 3) AS s, arg_min(embedding[1]::DOUBLE, vec_id) AS first FROM embeddings GROUP BY label")
def embedding_concat(spark, sf):
    """Blocks of a label, in order of id, as one; only blocks of a modality-sized group are gathered."""
    g = _emb(spark, sf).groupBy("label").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda b: b["x"])).alias("all"))
    return g.select("label", F.size("all").cast("long").alias("n"), F.round(V.total(F.col("all")), 3).alias("s"), F.col("all")[0].alias("first"))


@query("C13_embedding_gather", "WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 600 END AS token FROM events) SELECT event_id, coalesce(embedding[1]::DOUBLE, 0) AS x0, vec_id IS NULL AS missing FROM t LEFT JOIN embeddings e ON e.vec_id = t.token")
def embedding_gather(spark, sf):
    t = A.table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 600 END AS vec_id")
    e = _emb(spark, sf).select("vec_id", F.col("x")[0].alias("x0"), F.lit(False).alias("missing"))
    return t.join(e, "vec_id", "left").select("event_id", F.coalesce("x0", F.lit(0.0)).alias("x0"), F.coalesce("missing", F.lit(True)).alias("missing"))


@query("C16_placeholder_media", f"WITH {A.EV_STREAM}, p AS (SELECT session_id, event_index, row_number() OVER (PARTITION BY session_id ORDER BY event_index) AS n FROM ev_stream WHERE type = 'tool'), m AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS n FROM ev_stream WHERE type = 'model') SELECT p.session_id, p.event_index, m.event_id AS media FROM p LEFT JOIN m ON m.session_id = p.session_id AND m.n = p.n")
def placeholder_media(spark, sf):
    log = A.ev_stream(spark, sf)
    nth = lambda o: F.row_number().over(Window.partitionBy("session_id").orderBy(o))
    p = log.filter("type = 'tool'").select("session_id", "event_index", nth("event_index").alias("n"))
    m = log.filter("type = 'model'").select("session_id", F.col("event_id").alias("media"), nth("event_id").alias("n"))
    return p.join(m, ["session_id", "n"], "left").select("session_id", "event_index", "media")


@query("C17_end_of_modality", "SELECT event_id, CASE WHEN event_type = 'signup' THEN 'end' WHEN event_id % 2 = 0 THEN 'text' END AS vec FROM events")
def end_of_modality(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "signup", "end").when(F.col("event_id") % 2 == 0, "text").alias("vec"))


#: Every text is a prompt, and every text left an entry at the largest length 16, 32, 64, ... that is at most a fraction of its own.
_STORED = "16 * CAST(pow(2, floor(log2(length(text) / (1.0 + doc_id % 4) / 16))) AS INTEGER)"
_CACHE = f"q AS (SELECT doc_id, doc_id % 3 AS model, text AS prompt FROM documents), c AS (SELECT doc_id AS entry, doc_id % 3 AS model, left(text, {_STORED}) AS prefix FROM documents WHERE length(text) >= 16 * (1 + doc_id % 4))"


def _cached(spark, sf):
    """(model, prefix, entry) of the cache, and each prompt's own prefixes of the stored lengths, whose number is logarithmic:
    the lookup is one equality join on (identity, digest of the prefix), no comparison with every entry."""
    docs = A.table(spark, sf, "documents")
    c = docs.filter("length(text) >= 16 * (1 + doc_id % 4)").selectExpr("doc_id AS entry", "doc_id % 3 AS model", f"sha2(left(text, {_STORED.replace('INTEGER', 'INT')}), 256) AS prefix")
    q = docs.filter("length(text) >= 16").selectExpr("doc_id", "doc_id % 3 AS model", "text", "explode(transform(sequence(0, CAST(floor(log2(length(text) / 16.0)) AS INT)), k -> 16 * CAST(pow(2, k) AS INT))) AS n")
    return c, q.selectExpr("doc_id", "model", "n", "sha2(left(text, n), 256) AS prefix")


@query("C12_prefix_cache", f"WITH {_CACHE}, h AS (SELECT q.doc_id, c.entry, length(c.prefix) AS n, row_number() OVER (PARTITION BY q.doc_id ORDER BY length(c.prefix) DESC, c.entry) AS r FROM q JOIN c ON c.model = q.model AND starts_with(q.prompt, c.prefix)) SELECT doc_id, entry, n FROM h WHERE r = 1")
def prefix_cache(spark, sf):
    """Longest stored prefix of a prompt, of the same identity."""
    c, q = _cached(spark, sf)
    hit = q.join(c.groupBy("model", "prefix").agg(F.min("entry").alias("entry")), ["model", "prefix"])
    return hit.groupBy("doc_id").agg(F.max_by("entry", "n").alias("entry"), F.max("n").alias("n"))


@query("F2_longest_prefix", f"WITH {_CACHE} SELECT q.doc_id, max(length(c.prefix)) AS n, count(*) AS hits FROM q JOIN c ON c.model = q.model AND starts_with(q.prompt, c.prefix) GROUP BY q.doc_id")
def longest_prefix(spark, sf):
    c, q = _cached(spark, sf)
    hit = q.join(c.groupBy("model", "prefix").count(), ["model", "prefix"])
    return hit.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("count").alias("hits"))


@query("C15_overlaps", "WITH s AS (SELECT doc_id, doc_id // 10 AS file, (doc_id % 10) * 700 AS o, n_chars AS s FROM documents) SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.file = b.file AND a.doc_id < b.doc_id AND a.o < b.o + b.s AND b.o < a.o + a.s")
def overlaps(spark, sf):
    """Overlapping sub-ranges of a file: equality on the file, intervals as residual."""
    s = A.table(spark, sf, "documents").selectExpr("doc_id", "doc_id div 10 AS file", "(doc_id % 10) * 700 AS o", "n_chars AS s")
    a, b = s.toDF("a", "file", "ao", "as_"), s.toDF("b", "file", "bo", "bs")
    return a.join(b, "file").filter("a < b AND ao < bo + bs AND bo < ao + as_").select("a", "b")


@query("A33_sub_streams", "WITH s AS (SELECT doc_id, doc_id // 10 AS file, (doc_id % 10) * 700 AS o, n_chars AS s FROM documents), w AS (SELECT *, coalesce(max(o + s) OVER (PARTITION BY file ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > o, false) AS clash FROM s) SELECT file, count(*) AS streams, count(*) FILTER (clash) AS rejected FROM w GROUP BY file")
def sub_streams(spark, sf):
    """A running maximum of the ends tells whether a range overlaps an earlier one: one sort, no self-join."""
    s = A.table(spark, sf, "documents").selectExpr("doc_id", "doc_id div 10 AS file", "(doc_id % 10) * 700 AS o", "n_chars AS s")
    w = Window.partitionBy("file").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("clash", F.coalesce(F.max(F.col("o") + F.col("s")).over(w) > F.col("o"), F.lit(False))).groupBy("file").agg(F.count("*").alias("streams"), F.count_if("clash").alias("rejected"))


@query("H51_mel", "SELECT l_orderkey, l_linenumber, round(1127 * ln(1 + l_extendedprice / 700), 6) AS mel, round(700 * (exp(1127 * ln(1 + l_extendedprice / 700) / 1127) - 1), 4) AS hz FROM lineitem")
def mel(spark, sf):
    m = F.lit(1127) * F.ln(1 + F.col("l_extendedprice") / 700)
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(m, 6).alias("mel"), F.round(F.lit(700) * (F.exp(m / 1127) - 1), 4).alias("hz"))


@query("H52_framing", "WITH f AS (SELECT vec_id, [v::DOUBLE for v in embedding] AS x, unnest(generate_series(0, 3)) AS k FROM embeddings) SELECT vec_id, k, round(x[k * 16 + 1] * 0 + list_sum([x[k * 16 + j] * 0.5 * (1 - cos(2 * pi() * (j - 1) / 16)) for j in generate_series(1, 16)]), 6) AS energy FROM f")
def framing(spark, sf):
    """Frames of 16 samples under a periodic Hann window."""
    window = F.array(*[F.lit(0.5 * (1 - math.cos(2 * math.pi * j / 16))) for j in range(16)])
    f = _emb(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("frame", F.slice("x", F.col("k") * 16 + 1, F.lit(16)))
    return f.select("vec_id", "k", F.round(V.total(F.zip_with("frame", window, lambda a, b: a * b)), 6).alias("energy"))


_SIDES = "SELECT p_partkey, 1 + p_partkey * 37 % 1900 AS w, 1 + p_partkey * 101 % 1300 AS h FROM part"
#: Most patches, side of a patch, pooled patches a side.
_PATCHES, _PATCH, _POOL = 256, 16, 3


@query(
    "H53_resize_plan",
    f"""WITH s AS ({_SIDES}), f AS (SELECT *, sqrt(CAST({_PATCHES * _PATCH * _PATCH} AS FLOAT) / CAST(w * h AS FLOAT))::FLOAT AS factor FROM s),
i AS (SELECT *, CAST(floor(factor * h::FLOAT / {_POOL * _PATCH}::FLOAT) AS INTEGER) AS down, CAST(floor(factor * w::FLOAT / {_POOL * _PATCH}::FLOAT) AS INTEGER) AS across FROM f),
t AS (SELECT *, CASE WHEN down = 0 AND across = 0 THEN NULL WHEN down = 0 THEN 1 WHEN across = 0 THEN least(CAST(floor(h::FLOAT / w::FLOAT) AS INTEGER), {_PATCHES // _POOL**2}) ELSE down END AS th,
  CASE WHEN down = 0 AND across = 0 THEN NULL WHEN down = 0 THEN least(CAST(floor(w::FLOAT / h::FLOAT) AS INTEGER), {_PATCHES // _POOL**2}) WHEN across = 0 THEN 1 ELSE across END AS tw FROM i)
SELECT p_partkey, th * {_POOL * _PATCH} AS new_h, tw * {_POOL * _PATCH} AS new_w, CASE WHEN th IS NULL THEN 'empty' WHEN th * tw * {(_POOL * _PATCH) ** 2} > {_PATCHES * _PATCH * _PATCH} THEN 'too_large' ELSE 'ok' END AS status FROM t""",
)
def resize_plan(spark, sf):
    """Sides that keep the aspect ratio within a budget of pixels and are multiples of the pooled patch; in single precision."""
    unit, most = _POOL * _PATCH, _PATCHES // _POOL**2
    s = A.table(spark, sf, "part").selectExpr("p_partkey", "1 + p_partkey * 37 % 1900 AS w", "1 + p_partkey * 101 % 1300 AS h")
    s = s.withColumn("factor", F.sqrt(F.lit(float(_PATCHES * _PATCH * _PATCH)).cast("float") / (F.col("w") * F.col("h")).cast("float")).cast("float"))
    side = lambda c: F.floor((F.col("factor") * F.col(c).cast("float")) / F.lit(float(unit)).cast("float")).cast("int")
    ratio = lambda a, b: F.least(F.floor(F.col(a).cast("float") / F.col(b).cast("float")).cast("int"), F.lit(most))
    i = s.withColumn("down", side("h")).withColumn("across", side("w")).withColumn("none", (F.col("down") == 0) & (F.col("across") == 0))
    th = F.when(F.col("none"), None).when(F.col("down") == 0, 1).when(F.col("across") == 0, ratio("h", "w")).otherwise(F.col("down"))
    tw = F.when(F.col("none"), None).when(F.col("down") == 0, ratio("w", "h")).when(F.col("across") == 0, 1).otherwise(F.col("across"))
    t = i.select("p_partkey", (th * unit).alias("new_h"), (tw * unit).alias("new_w"))
    return t.withColumn("status", F.when(F.col("new_h").isNull(), "empty").when(F.col("new_h") * F.col("new_w") > _PATCHES * _PATCH * _PATCH, "too_large").otherwise("ok"))


_GRID = "SELECT p_partkey, 8 * (1 + p_partkey % 11) AS w, 8 * (1 + p_partkey % 7) AS h FROM part"


@query(
    "H54_patchify",
    f"WITH s AS (SELECT *, CASE WHEN w % 16 > 0 OR h % 16 > 0 THEN 'indivisible' WHEN (w // 16) * (h // 16) > 12 THEN 'too_many' END AS error FROM ({_GRID})), g AS (SELECT p_partkey, w // 16 AS across, unnest(generate_series(0, h // 16 - 1)) AS y FROM s WHERE error IS NULL), p AS (SELECT p_partkey, across, y, unnest(generate_series(0, across - 1)) AS x FROM g) SELECT p_partkey, NULL AS error, x, y, y * across + x AS patch FROM p UNION ALL SELECT p_partkey, error, NULL, NULL, NULL FROM s WHERE error IS NOT NULL",
)
def patchify(spark, sf):
    """Patches of 16 pixels a side and their positions; a side that is no multiple, or more than 12 patches, is an error."""
    s = A.table(spark, sf, "part").selectExpr("p_partkey", "8 * (1 + p_partkey % 11) AS w", "8 * (1 + p_partkey % 7) AS h")
    s = s.withColumn("error", F.expr("CASE WHEN w % 16 > 0 OR h % 16 > 0 THEN 'indivisible' WHEN (w div 16) * (h div 16) > 12 THEN 'too_many' END"))
    s = s.withColumn("y", F.explode_outer(F.expr("CASE WHEN error IS NULL THEN sequence(0L, h div 16 - 1) END"))).withColumn("x", F.explode_outer(F.expr("CASE WHEN error IS NULL THEN sequence(0L, w div 16 - 1) END")))
    return s.selectExpr("p_partkey", "error", "x", "y", "y * (w div 16) + x AS patch")
