"""Queries of ordered folds, of streams' batch twins, and of event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import eventlog as L
from ..sources import adapters as A
from ..streaming import decode
from ..streaming import state as S


@query(
    "E3_checkpoint_triggers",
    f"""WITH RECURSIVE {A.EV_STREAM}, base AS MATERIALIZED (SELECT session_id, event_index, type, payload, tokens, timestamp_us FROM ev_stream),
s AS (SELECT session_id, -1::BIGINT AS event_index, 0::BIGINT AS context, 0::BIGINT AS carry, NULL::BIGINT AS seen, NULL::VARCHAR AS reason, 0::BIGINT AS delta FROM (SELECT DISTINCT session_id FROM base)
  UNION ALL SELECT session_id, event_index, context, CASE WHEN reason IS NULL THEN delta ELSE 0 END, seen, reason, delta FROM (
    SELECT b.session_id, b.event_index, s.context + b.tokens AS context, s.carry + b.tokens AS delta, b.timestamp_us AS seen,
      CASE WHEN b.payload LIKE 'signup%' THEN 'handoff' WHEN b.type = 'correction' THEN 'correction' WHEN s.carry + b.tokens >= 200 THEN 'max_delta' WHEN s.context + b.tokens >= 750 THEN 'pressure'
        WHEN b.type = 'tool' AND s.carry + b.tokens >= 60 THEN 'milestone' WHEN coalesce(b.timestamp_us - s.seen, 0) > 86400000000 AND s.carry + b.tokens > 0 THEN 'idle' END AS reason
    FROM s JOIN base b ON b.session_id = s.session_id AND b.event_index = s.event_index + 1))
SELECT session_id, event_index, reason, delta FROM s WHERE reason IS NOT NULL""",
)
def checkpoint_triggers(spark, sf):
    return S.triggers(A.ev_stream(spark, sf))


@query("I1_incremental_append", f"WITH {A.EV_STREAM} SELECT session_id, count(*) AS appended, min(event_index) AS first FROM ev_stream WHERE event_index >= 40 GROUP BY session_id")
def incremental_append(spark, sf):
    """What a replay from index 40 reads."""
    return L.in_range(A.ev_stream(spark, sf), 40).groupBy("session_id").agg(F.count("*").alias("appended"), F.min("event_index").alias("first"))


@query("I3_correction_barrier", f"WITH {A.EV_STREAM} SELECT session_id, event_index, coalesce(max(CASE WHEN type = 'correction' THEN event_index END) OVER (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > coalesce(max(CASE WHEN type = 'model' THEN event_index END) OVER (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS barred FROM ev_stream")
def correction_barrier(spark, sf):
    """A decision is barred while a correction is newer than the last projection."""
    seen = Window.partitionBy("session_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda t: F.max(F.expr(f"CASE WHEN type = '{t}' THEN event_index END")).over(seen)
    return A.ev_stream(spark, sf).select("session_id", "event_index", F.coalesce(last("correction") > F.coalesce(last("model"), F.lit(-1)), F.lit(False)).alias("barred"))


@query("I8_rolling_summary", f"""WITH RECURSIVE {A.EV_CONV}, c AS (SELECT session_id, event_index // 8 AS chunk, string_agg(array_to_string(string_split(payload, ' ')[1:3], ' '), ' ' ORDER BY event_index) AS t FROM ev_conv GROUP BY ALL),
s AS (SELECT session_id, -1::BIGINT AS chunk, '' AS summary FROM (SELECT DISTINCT session_id FROM c) UNION ALL SELECT c.session_id, c.chunk, right(s.summary || '|' || c.t, 200) FROM s JOIN c ON c.session_id = s.session_id AND c.chunk = s.chunk + 1)
SELECT session_id, arg_max(summary, chunk) AS summary, max(chunk) + 1 AS calls FROM s GROUP BY session_id""")
def rolling_summary(spark, sf):
    return S.rolling_summary(A.ev_conv(spark, sf))


@query("I10_frame_carry", f"WITH {A.EV_STREAM}, c AS (SELECT session_id, event_index, tokens, CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY event_index) AS BIGINT) AS total FROM ev_stream) SELECT session_id, event_index, total // 160 - (total - tokens) // 160 AS frames, total % 160 AS carried FROM c")
def frame_carry(spark, sf):
    """Whole frames of 160 that each call completes, and the samples carried to the next."""
    order = Window.partitionBy("session_id").orderBy("event_index")
    c = A.ev_stream(spark, sf).withColumn("total", F.sum("tokens").over(order))
    return c.selectExpr("session_id", "event_index", "total div 160 - (total - tokens) div 160 AS frames", "total % 160 AS carried")


@query("I5_decode_holdback", "WITH t AS (SELECT doc_id, text || left('<end_of_turn>', CAST(doc_id % 14 AS INTEGER)) AS t FROM documents), k AS (SELECT doc_id, t, unnest(generate_series(1, 12)) AS n FROM t) SELECT doc_id, coalesce(max(n) FILTER (right(t, n) = left('<end_of_turn>', n)), 0) AS held, ends_with(any_value(t), '<end_of_turn>') AS stopped FROM k GROUP BY doc_id")
def decode_holdback(spark, sf):
    """How much of a decoded text must wait because a stop sequence may have begun."""
    from ..functions.text import overlap

    t = F.expr("concat(text, left('<end_of_turn>', CAST(doc_id % 14 AS INT)))")
    return A.table(spark, sf, "documents").withColumn("t", t).select("doc_id", overlap(F.col("t"), F.lit("<end_of_turn>"), 12).alias("held"), F.expr("endswith(t, '<end_of_turn>')").alias("stopped"))


#: Stop sequences of event types, as tokens.
_STOPS = [["signup", "click"], ["purchase", "purchase", "view"], ["view", "signup", "signup", "error"], ["click", "click", "click", "click", "click"]]
_PROGRESS = lambda k, s: "CASE " + " ".join(f"WHEN s.m{k} = {n} AND b.type = '{t}' THEN {n + 1}" for n, t in enumerate(s)) + f" WHEN b.type = '{s[0]}' THEN 1 ELSE 0 END"


@query(
    "I5_streaming_decode",
    f"""WITH RECURSIVE b AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
s AS (SELECT session_id, 0::BIGINT AS seq, {", ".join(f"0 AS m{k}" for k in range(len(_STOPS)))}, false AS stopped, []::VARCHAR[] AS pending, '' AS text FROM (SELECT DISTINCT session_id FROM b)
  UNION ALL SELECT session_id, seq, {", ".join(f"m{k}" for k in range(len(_STOPS)))}, stopped, CASE WHEN stopped THEN pending ELSE queue[len(queue) - keep + 1:] END, CASE WHEN stopped THEN text ELSE text || array_to_string(queue[1:len(queue) - keep], '') END
  FROM (SELECT *, greatest({", ".join(f"m{k}" for k in range(len(_STOPS)))}) AS keep, {" OR ".join(f"m{k} = {len(x)}" for k, x in enumerate(_STOPS))} AS stopped FROM (
    SELECT b.session_id, b.seq, s.text, list_append(s.pending, ' ' || b.type) AS queue, s.pending, {", ".join(f"{_PROGRESS(k, x)} AS m{k}" for k, x in enumerate(_STOPS))}
    FROM s JOIN b ON b.session_id = s.session_id AND b.seq = s.seq + 1 WHERE NOT s.stopped)))
SELECT session_id, md5(arg_max(text, seq)) AS digest, bool_or(stopped) AS stopped, max(seq) AS n_tokens, len(arg_max(pending, seq))::INTEGER AS held FROM s GROUP BY session_id""",
)
def streaming_decode(spark, sf):
    """Users' events as tokens: the text until a stop sequence, less what one has begun to match."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tokens = A.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.row_number().over(order).alias("seq"), F.lit(None).cast("int").alias("byte"), F.concat(F.lit("▁"), "event_type").alias("piece"))
    found = decode.decoded(tokens, [[(None, "▁" + t) for t in s] for s in _STOPS])
    return found.select("session_id", F.md5("text").alias("digest"), "stopped", "n_tokens", "held")


@query("W1_tumbling", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type, date_trunc('hour', ts)")
def tumbling(spark, sf):
    e = A.table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("W2_sliding", "WITH s AS (SELECT user_id, value, unnest([epoch_us(ts) // 43200000000 * 43200000000, epoch_us(ts) // 43200000000 * 43200000000 - 43200000000]) AS start_us FROM events) SELECT user_id, start_us, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, start_us")
def sliding(spark, sf):
    e = A.table(spark, sf, "events").groupBy("user_id", F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select("user_id", F.expr("unix_micros(CAST(w.start AS TIMESTAMP))").alias("start_us"), "n", "total")


@query("W3_sessions", "WITH l AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t) AS s FROM l) SELECT user_id, min(t) AS start_us, count(*) AS n FROM g GROUP BY user_id, s")
def sessions(spark, sf):
    e = A.table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.expr("unix_micros(CAST(w.start AS TIMESTAMP))").alias("start_us"), "n")
