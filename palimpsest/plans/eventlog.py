"""Queries over event logs (scans, branches, rendering, validation, sessions)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import eventlog as L
from ..sources import adapters as A




@query("A1_append_record", f"WITH {A.EV_CONV} SELECT session_id, count(*) AS appended, sum(strlen(payload)) AS bytes FROM ev_conv WHERE strlen(payload) BETWEEN 1 AND 67108864 GROUP BY session_id")
def append_record(spark, sf):
    return L.accepted(A.ev_conv(spark, sf)).groupBy("session_id").agg(F.count("*").alias("appended"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


@query(
    "A2_retention",
    f"""WITH {A.EV_STREAM}, retention AS (SELECT DISTINCT session_id, epoch(TIMESTAMP '2024-02-01') + user_id * 86400 AS retain_until, user_id % 10 = 0 AS legal_hold FROM ev_stream WHERE user_id % 2 = 0)
SELECT e.session_id, count(*) AS n, CAST(max(r.retain_until) AS BIGINT) AS retain_until, coalesce(bool_or(r.legal_hold), false) AS legal_hold,
  coalesce(bool_or(r.legal_hold), false) OR coalesce(max(r.retain_until) > 1710000000, false) AS protected
FROM ev_stream e LEFT JOIN retention r USING (session_id) GROUP BY e.session_id""",
)
def retention(spark, sf):
    log = A.ev_stream(spark, sf)
    policy = log.filter("user_id % 2 = 0").selectExpr("session_id", "1706745600 + user_id * 86400 AS retain_until", "user_id % 10 = 0 AS legal_hold").distinct()
    out = log.join(policy, "session_id", "left").groupBy("session_id").agg(F.count("*").alias("n"), F.max("retain_until").alias("retain_until"), F.coalesce(F.bool_or("legal_hold"), F.lit(False)).alias("legal_hold"))
    return out.withColumn("protected", F.col("legal_hold") | F.coalesce(F.col("retain_until") > 1710000000, F.lit(False)))


@query("A3_full_scan", f"WITH {A.EV_CONV} SELECT tenant_id, session_id, event_index, type, payload, timestamp_us, step_index FROM ev_conv")
def full_scan(spark, sf):
    return A.ev_conv(spark, sf).drop("conv_id")


@query("A4_range_scan", f"WITH {A.EV_CONV} SELECT session_id, event_index, payload FROM ev_conv WHERE event_index >= 1 AND event_index < 4")
def range_scan(spark, sf):
    return L.in_range(A.ev_conv(spark, sf), 1, 4).select("session_id", "event_index", "payload")


@query(
    "A5_branch_create",
    f"""WITH {A.EV_CONV}, want AS (SELECT DISTINCT conv_id AS branch_id, conv_id - 1 AS parent_id, conv_id % 7 AS wanted FROM ev_conv),
have AS (SELECT conv_id, count(*) AS n FROM ev_conv GROUP BY conv_id)
SELECT branch_id, parent_id, wanted, CASE WHEN h.n IS NULL THEN 'no parent' WHEN wanted > h.n THEN 'past the end' ELSE 'ok' END AS verdict FROM want LEFT JOIN have h ON h.conv_id = parent_id""",
)
def branch_create(spark, sf):
    log = A.ev_conv(spark, sf)
    want = log.selectExpr("conv_id AS branch_id", "conv_id - 1 AS parent_id", "conv_id % 7 AS wanted").distinct()
    have = log.groupBy(F.col("conv_id").alias("parent_id")).agg(F.count("*").alias("n"))
    return want.join(have, "parent_id", "left").selectExpr("branch_id", "parent_id", "wanted", "CASE WHEN n IS NULL THEN 'no parent' WHEN wanted > n THEN 'past the end' ELSE 'ok' END AS verdict")


@query(
    "A6_branch_scan",
    f"""WITH RECURSIVE {A.EV_CONV}, {A.BRANCHES}, chain AS (SELECT conv_id, parent_id, parent_count AS n, 1 AS level FROM branches
  UNION ALL SELECT c.conv_id, b.parent_id, least(c.n, b.parent_count), c.level + 1 FROM chain c JOIN branches b ON b.conv_id = c.parent_id WHERE c.level < 16),
every AS (SELECT conv_id, event_index AS own, payload, 0 AS level FROM ev_conv UNION ALL
  SELECT c.conv_id, e.event_index, e.payload, c.level FROM chain c JOIN ev_conv e ON e.conv_id = c.parent_id AND e.event_index < c.n)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY level DESC, own) - 1 AS event_index, payload, level > 0 AS inherited FROM every""",
)
def branch_scan(spark, sf):
    return L.resolve_branches(A.ev_conv(spark, sf), A.branches(spark, sf))


@query("A8_generation", f"WITH {A.EV_STREAM} SELECT session_id, count(*) AS record_count, max(event_index) AS last_index, CAST(sum(strlen(payload)) AS VARCHAR) AS opaque_token FROM ev_stream GROUP BY session_id")
def generation(spark, sf):
    return A.ev_stream(spark, sf).groupBy("session_id").agg(F.count("*").alias("record_count"), F.max("event_index").alias("last_index"), F.sum(F.octet_length("payload")).cast("string").alias("opaque_token"))


@query(
    "A9_event_codec",
    f"""WITH {A.EV_STREAM} SELECT event_id, type AS type_back, tenant_id AS tenant_back, session_id AS session_back, payload AS payload_back, timestamp_us AS ts_back,
  CASE WHEN type = 'tool' THEN 'tool-' || event_id END AS tool_back, type = 'tool' AS has_tool FROM ev_stream""",
)
def event_codec(spark, sf):
    """Writes each event as a JSON line, empty optional fields omitted, and reads it back."""
    rows = A.ev_stream(spark, sf).selectExpr("event_id", "to_json(struct(type, tenant_id, session_id, payload, timestamp_us, CASE WHEN type = 'tool' THEN concat('tool-', event_id) END AS tool_call_id)) AS line")
    back = rows.withColumn("e", F.from_json("line", "type STRING, tenant_id STRING, session_id STRING, payload STRING, timestamp_us LONG, tool_call_id STRING"))
    return back.selectExpr("event_id", "e.type AS type_back", "e.tenant_id AS tenant_back", "e.session_id AS session_back", "e.payload AS payload_back", "e.timestamp_us AS ts_back", "e.tool_call_id AS tool_back", "line LIKE '%tool_call_id%' AS has_tool")


@query(
    "A10_identity",
    r"""SELECT url, coalesce(length(url) > 0 AND url NOT IN ('.', '..') AND NOT regexp_matches(url, '[/\\"<>:|?*\x00-\x1f]'), false) AS valid_url,
  coalesce(length(id) > 0 AND id NOT IN ('.', '..') AND NOT regexp_matches(id, '[/\\"<>:|?*\x00-\x1f]'), false) AS valid_id FROM (SELECT url, CASE page_id % 3 WHEN 0 THEN '..' WHEN 1 THEN 'page-' || page_id ELSE 'a:' || page_id END AS id FROM pages)""",
)
def identity(spark, sf):
    pages = A.table(spark, sf, "pages").withColumn("id", F.expr("CASE page_id % 3 WHEN 0 THEN '..' WHEN 1 THEN concat('page-', page_id) ELSE concat('a:', page_id) END"))
    return pages.select("url", T.valid_identity(F.col("url")).alias("valid_url"), T.valid_identity(F.col("id")).alias("valid_id"))


@query("A11_typed_load", """SELECT user_id, count(*) AS n, sum(CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) AS corrupt, sum(CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS k_sum FROM events GROUP BY user_id""")
def typed_load(spark, sf):
    """Parses payloads permissively; every thirteenth is cut short and must count as corrupt."""
    rows = A.table(spark, sf, "events").withColumn("line", F.expr("CASE WHEN event_id % 13 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END"))
    rows = rows.withColumn("e", F.from_json("line", "k LONG, bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("e.bad").isNotNull().cast("long")).alias("corrupt"), F.sum(F.when(F.col("e.bad").isNull(), F.col("e.k"))).alias("k_sum"))


@query("A12_events_since", f"WITH {A.EV_STREAM} SELECT session_id, event_index, type FROM ev_stream WHERE event_index >= 60")
def events_since(spark, sf):
    return L.in_range(A.ev_stream(spark, sf), 60).select("session_id", "event_index", "type")


@query("B1_render_log", f"WITH {A.EV_CONV} SELECT session_id, string_agg('[' || (event_index + 1) || '] ' || type || ': ' || payload, chr(10) ORDER BY event_index) AS rendered FROM ev_conv GROUP BY session_id")
def render_log(spark, sf):
    return L.render(A.ev_conv(spark, sf), F.concat("type", F.lit(": "), "payload"), ["session_id"])


@query(
    "B2_tail_window",
    f"WITH {A.EV_STREAM} SELECT session_id, string_agg(CAST(event_index AS VARCHAR), ',' ORDER BY event_index) AS last_indexes FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_index DESC) AS n FROM ev_stream) WHERE n <= 20 GROUP BY session_id",
)
def tail_window(spark, sf):
    return L.tail(A.ev_stream(spark, sf), 20, ["session_id"]).groupBy("session_id").agg(F.expr("listagg(CAST(event_index AS STRING), ',') WITHIN GROUP (ORDER BY event_index)").alias("last_indexes"))


_PLANTED = """planted AS (SELECT session_id, event_index, type, payload, CASE WHEN event_id % 11 = 0 THEN timestamp_us - 100000000000 ELSE timestamp_us END AS timestamp_us,
  CASE WHEN event_id % 13 = 0 THEN event_index ELSE event_index + 1 END AS step_index, CASE WHEN type = 'tool' AND event_id % 3 > 0 THEN 'call-' || event_id END AS tool_call_id FROM ev_stream)"""


def _planted(spark, sf):
    return A.ev_stream(spark, sf).selectExpr(
        "session_id", "event_index", "type", "payload", "CASE WHEN event_id % 11 = 0 THEN timestamp_us - 100000000000 ELSE timestamp_us END AS timestamp_us",
        "CASE WHEN event_id % 13 = 0 THEN event_index ELSE event_index + 1 END AS step_index", "CASE WHEN type = 'tool' AND event_id % 3 > 0 THEN concat('call-', event_id) END AS tool_call_id",
    )


@query(
    "B18_trace_validation",
    f"""WITH {A.EV_STREAM}, {_PLANTED}, marked AS (SELECT *, coalesce(timestamp_us < lag(timestamp_us) OVER w, false) AS a,
  coalesce(CASE WHEN step_index > 0 THEN step_index END < max(CASE WHEN step_index > 0 THEN step_index END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS b,
  step_index > 0 AND count(*) OVER (PARTITION BY session_id, step_index) > 1 AS c, type = 'tool' AND tool_call_id IS NULL AS d FROM planted WINDOW w AS (PARTITION BY session_id ORDER BY event_index))
SELECT session_id, count(*) FILTER (a) AS timestamp_warnings, count(*) FILTER (b) AS step_regressions, count(*) FILTER (c) AS step_duplicates, count(*) FILTER (d) AS missing_tool_ids, count(*) FILTER (b OR c) = 0 AS valid FROM marked GROUP BY session_id""",
)
def trace_validation(spark, sf):
    rows = L.with_regressions(_planted(spark, sf), ["session_id"])
    return rows.groupBy("session_id").agg(
        F.count_if("timestamp_regressed").alias("timestamp_warnings"), F.count_if("step_regressed").alias("step_regressions"), F.count_if("step_repeated").alias("step_duplicates"),
        F.count_if((F.col("type") == "tool") & F.col("tool_call_id").isNull()).alias("missing_tool_ids"), (F.count_if(F.col("step_regressed") | F.col("step_repeated")) == 0).alias("valid"),
    )


@query(
    "B19_trace_coordinates",
    f"""WITH {A.EV_STREAM}, {_PLANTED} SELECT session_id, event_index, coalesce(nullif(step_index, 0), event_index + 1) AS step_index, CASE WHEN type = 'tool' THEN coalesce(tool_call_id, 'tool-' || coalesce(nullif(step_index, 0), event_index + 1)) ELSE tool_call_id END AS tool_call_id FROM planted""",
)
def trace_coordinates(spark, sf):
    return L.traced(_planted(spark, sf)).select("session_id", "event_index", "step_index", "tool_call_id")


@query("D1_status_counts", f"WITH {A.EV_STREAM} SELECT session_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in ("user", "model", "tool", "internal", "correction")) + " FROM ev_stream GROUP BY session_id")
def status_counts(spark, sf):
    kinds = ("user", "model", "tool", "internal", "correction")
    return A.ev_stream(spark, sf).groupBy("session_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in kinds])


@query("E1_event_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_index FROM events")
def event_index(spark, sf):
    return A.ev_stream(spark, sf).select("event_id", "event_index")


@query(
    "E2_regressions",
    f"""WITH {A.EV_STREAM}, {_PLANTED} SELECT session_id, event_index, coalesce(timestamp_us < lag(timestamp_us) OVER w, false) AS timestamp_regressed,
  coalesce(CASE WHEN step_index > 0 THEN step_index END < max(CASE WHEN step_index > 0 THEN step_index END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS step_regressed FROM planted WINDOW w AS (PARTITION BY session_id ORDER BY event_index)""",
)
def regressions(spark, sf):
    return L.with_regressions(_planted(spark, sf), ["session_id"]).select("session_id", "event_index", "timestamp_regressed", "step_regressed")


@query("F5_recent_corrections", f"WITH {A.EV_STREAM} SELECT session_id, event_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_index DESC) AS n FROM ev_stream WHERE type = 'correction') WHERE n <= 3")
def recent_corrections(spark, sf):
    return L.tail(A.ev_stream(spark, sf).filter("type = 'correction'"), 3, ["session_id"]).select("session_id", "event_index")


@query(
    "G1_prefix_union",
    f"""WITH {A.EV_CONV}, {A.BRANCHES} SELECT b.conv_id, 'parent' AS part, e.event_index, e.payload FROM branches b JOIN ev_conv e ON e.conv_id = b.parent_id AND e.event_index < b.parent_count
UNION ALL SELECT conv_id, 'own', event_index, payload FROM ev_conv WHERE conv_id % 2 = 1""",
)
def prefix_union(spark, sf):
    log = A.ev_conv(spark, sf)
    parent = A.branches(spark, sf).join(log.select(F.col("conv_id").alias("parent_id"), "event_index", "payload"), "parent_id").filter("event_index < parent_count")
    own = log.filter("conv_id % 2 = 1").selectExpr("conv_id", "'own' AS part", "event_index", "payload")
    return parent.selectExpr("conv_id", "'parent' AS part", "event_index", "payload").unionByName(own)


@query("H66_trace_digest", f"WITH {A.EV_CONV} SELECT session_id, sha256(string_agg(type || ':' || payload, chr(10) ORDER BY event_index)) AS trace_digest, count(*) AS n FROM ev_conv GROUP BY session_id")
def trace_digest(spark, sf):
    return A.ev_conv(spark, sf).withColumn("line", F.concat("type", F.lit(":"), "payload")).groupBy("session_id").agg(F.expr("sha2(listagg(line, '\n') WITHIN GROUP (ORDER BY event_index), 256)").alias("trace_digest"), F.count("*").alias("n"))


_BUNDLE = """live AS (SELECT session_id, count(*) AS n, sha256(string_agg(type || ':' || payload, chr(10) ORDER BY event_index)) AS digest, min(timestamp_us) AS t0, max(timestamp_us) AS t1,
  count(*) FILTER (type = 'model') AS models, max(event_index) + 1 AS range_end FROM ev_conv GROUP BY session_id),
bundle AS (SELECT session_id, CASE WHEN CAST(session_id AS BIGINT) % 4 = 1 THEN n + 1 ELSE n END AS n, CASE WHEN CAST(session_id AS BIGINT) % 5 = 2 THEN sha256(digest) ELSE digest END AS digest, t0,
  CASE WHEN CAST(session_id AS BIGINT) % 7 = 3 THEN t1 + 1 ELSE t1 END AS t1, models, range_end FROM live)"""
_CHECKS = "concat_ws(',', CASE WHEN b.n = l.n THEN 'event_count' END, CASE WHEN b.digest = l.digest THEN 'trace_digest' END, CASE WHEN b.t0 = l.t0 THEN 'first_timestamp' END, CASE WHEN b.t1 = l.t1 THEN 'last_timestamp' END, CASE WHEN b.models = l.models THEN 'model_events' END, CASE WHEN b.range_end = l.range_end THEN 'range_end' END)"


@query("C11_verify_bundle", f"WITH {A.EV_CONV}, {_BUNDLE} SELECT b.session_id, {_CHECKS} AS checks_passed, b.n = l.n AND b.digest = l.digest AND b.t0 = l.t0 AND b.t1 = l.t1 AND b.models = l.models AND b.range_end = l.range_end AS verified FROM bundle b JOIN live l USING (session_id)")
def verify_bundle(spark, sf):
    """Recomputes the facts of a handoff bundle from the live log; some bundles are tampered with."""
    live = A.ev_conv(spark, sf).withColumn("line", F.concat("type", F.lit(":"), "payload")).groupBy("session_id").agg(
        F.count("*").alias("n"), F.expr("sha2(listagg(line, '\n') WITHIN GROUP (ORDER BY event_index), 256)").alias("digest"), F.min("timestamp_us").alias("t0"), F.max("timestamp_us").alias("t1"),
        F.count_if(F.col("type") == "model").alias("models"), (F.max("event_index") + 1).alias("range_end"),
    )
    bundle = live.selectExpr("session_id", "CASE WHEN CAST(session_id AS BIGINT) % 4 = 1 THEN n + 1 ELSE n END AS n", "CASE WHEN CAST(session_id AS BIGINT) % 5 = 2 THEN sha2(digest, 256) ELSE digest END AS digest", "t0", "CASE WHEN CAST(session_id AS BIGINT) % 7 = 3 THEN t1 + 1 ELSE t1 END AS t1", "models", "range_end")
    return bundle.alias("b").join(live.alias("l"), "session_id").select("session_id", F.expr(_CHECKS).alias("checks_passed"), F.expr("b.n = l.n AND b.digest = l.digest AND b.t0 = l.t0 AND b.t1 = l.t1 AND b.models = l.models AND b.range_end = l.range_end").alias("verified"))


@query(
    "E11_history_suffix",
    f"""WITH {A.EV_CONV}, full_text AS (SELECT session_id, event_index, string_agg('<' || type || '>' || payload, chr(10)) OVER (PARTITION BY session_id ORDER BY event_index) AS now FROM ev_conv),
p AS (SELECT *, lag(now) OVER (PARTITION BY session_id ORDER BY event_index) AS before FROM full_text)
SELECT session_id, event_index, CAST(coalesce(length(before), 0) AS BIGINT) AS at, substr(now, coalesce(length(before), 0) + 1) AS suffix FROM p WHERE coalesce(starts_with(now, before), true)""",
)
def history_suffix(spark, sf):
    """What each turn adds to the rendered history, and where: the history itself is not rendered anew, as lines only follow."""
    order = Window.partitionBy("session_id").orderBy("event_index")
    line = F.concat(F.when(F.row_number().over(order) > 1, "\n").otherwise(""), F.lit("<"), "type", F.lit(">"), "payload")
    rows = A.ev_conv(spark, sf).select("session_id", "event_index", line.alias("suffix"))
    return rows.withColumn("at", F.coalesce(F.sum(F.length("suffix")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


@query(
    "D21_session_stats",
    f"""WITH {A.EV_STREAM} SELECT session_id, count(*) AS n_events, count(*) FILTER (type = 'tool') AS tool_calls, count(*) FILTER (type = 'correction') AS corrections,
  bool_or(payload LIKE 'signup%') AS compacted, coalesce(max(event_index) - min(event_index) FILTER (payload LIKE 'signup%'), 0) AS after_compaction FROM ev_stream GROUP BY session_id""",
)
def session_stats(spark, sf):
    signup = F.col("payload").startswith("signup")
    return A.ev_stream(spark, sf).groupBy("session_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("type") == "tool").alias("tool_calls"), F.count_if(F.col("type") == "correction").alias("corrections"), F.bool_or(signup).alias("compacted"),
        F.coalesce(F.max("event_index") - F.min(F.when(signup, F.col("event_index"))), F.lit(0)).cast("long").alias("after_compaction"),
    )


_RULES = [("short", "n ASC"), ("long", "n DESC"), ("correction_heavy", "corrections DESC"), ("tool_heavy", "tools DESC")]


@query(
    "D22_bucket_selection",
    f"""WITH {A.EV_STREAM}, s AS (SELECT session_id, user_id, count(*) AS n, count(*) FILTER (type = 'correction') AS corrections, count(*) FILTER (type = 'tool') AS tools FROM ev_stream GROUP BY session_id, user_id),
r AS ({' UNION ALL '.join(f"SELECT '{b}' AS bucket, {i} AS priority, session_id, row_number() OVER (ORDER BY {o}, user_id) AS place FROM s" for i, (b, o) in enumerate(_RULES))}),
t AS (SELECT * FROM r WHERE place <= 3), f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority) AS own FROM t)
SELECT bucket, session_id, place FROM f WHERE own = 1""",
)
def bucket_selection(spark, sf):
    """The first sessions of each rule by a top-k, then each session goes to its first rule."""
    s = A.ev_stream(spark, sf).groupBy("session_id", "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "correction").alias("corrections"), F.count_if(F.col("type") == "tool").alias("tools"))
    picked = None
    for i, (bucket, order) in enumerate(_RULES):
        col, way = order.split()
        top = s.orderBy(F.col(col).asc() if way == "ASC" else F.col(col).desc(), "user_id").limit(3)
        top = top.withColumn("place", F.row_number().over(Window.orderBy(F.col(col).asc() if way == "ASC" else F.col(col).desc(), "user_id")))
        top = top.select(F.lit(bucket).alias("bucket"), F.lit(i).alias("priority"), "session_id", "place")
        picked = top if picked is None else picked.unionByName(top)
    own = F.row_number().over(Window.partitionBy("session_id").orderBy("priority"))
    return picked.withColumn("own", own).filter("own = 1").select("bucket", "session_id", "place")
