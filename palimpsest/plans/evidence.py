"""Queries over directives, the active evidence view and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import evidence as V
from ..operators import eventlog as L
from ..operators.audit import refusal
from ..sources import adapters as A

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(c: str) -> str:
    return f"translate({c}, '{UP}', '{LOW}')"


_HITS = f"""hits AS (SELECT e.session_id, e.event_index, c.correction_id, c.scope FROM ev_conv e JOIN corr c ON e.session_id = c.session_id
  AND (c.scope <> 'prior_events' OR e.event_index < c.correction_index) AND c.fact <> '' AND contains({_low('e.payload')}, {_low('c.fact')}) WHERE e.type <> 'correction')"""


_REVOKED = f"""facts AS (SELECT session_id, CASE WHEN correction_id = '' THEN 'unknown' ELSE correction_id END AS correction_id, directive_index, correction_index, scope, unnest(facts) AS fact, generate_subscripts(facts, 1) AS fact_index FROM dir),
found AS (SELECT e.session_id, e.event_index, f.correction_id, f.directive_index, f.fact_index, f.fact FROM ev_conv e JOIN facts f ON e.session_id = f.session_id AND (f.scope <> 'prior_events' OR e.event_index < f.correction_index) AND f.fact <> '' AND contains({_low('e.payload')}, {_low('f.fact')}) WHERE e.type <> 'correction'),
ids AS (SELECT session_id, event_index, string_agg(correction_id, ',' ORDER BY directive_index) AS revoked_by FROM (SELECT DISTINCT session_id, event_index, directive_index, correction_id FROM found) GROUP BY ALL),
g AS (SELECT session_id, event_index, count(*) AS n, string_agg(fact, ' | ' ORDER BY directive_index, fact_index) AS said, any_value(revoked_by) AS revoked_by FROM found JOIN ids USING (session_id, event_index) GROUP BY session_id, event_index)"""


@query(
    "B3_active_evidence_view",
    f"""WITH {A.EV_CONV}, {A.DIRECTIVES}, {_REVOKED}
SELECT e.session_id, e.event_index, CASE WHEN revoked_by IS NULL THEN type ELSE 'internal' END AS type, CASE WHEN revoked_by IS NULL THEN payload ELSE '{V.MARKER[0]}' || n || '{V.MARKER[1]}' || revoked_by || '{V.MARKER[2]}' END AS payload, revoked_by
FROM ev_conv e LEFT JOIN g USING (session_id, event_index)""",
)
def active_evidence_view(spark, sf):
    return V.active_view(A.ev_conv(spark, sf), A.directives(spark, sf), ["session_id"]).select("session_id", "event_index", "type", "payload", "revoked_by")


@query("B3_revoked_log", f"WITH {A.EV_CONV}, {A.DIRECTIVES}, {_REVOKED} SELECT session_id, event_index, '[' || (event_index + 1) || '] revoked_by=' || revoked_by || ' invalidated_facts=' || said || ' original=' || payload AS line FROM ev_conv e JOIN g USING (session_id, event_index)")
def revoked_log(spark, sf):
    """What was revoked, by which directives, for which facts."""
    return V.revoked_log(V.active_view(A.ev_conv(spark, sf), A.directives(spark, sf), ["session_id"])).select("session_id", "event_index", "line")


@query("B4_scope", f"WITH {A.EV_CONV}, {A.CORR} SELECT e.session_id, e.event_index, c.scope, c.scope <> 'prior_events' OR e.event_index < c.correction_index AS applies FROM ev_conv e JOIN corr c USING (session_id)")
def scope(spark, sf):
    rows = A.ev_conv(spark, sf).join(A.corr(spark, sf).select("session_id", "scope", "correction_index"), "session_id")
    return rows.selectExpr("session_id", "event_index", "scope", "scope <> 'prior_events' OR event_index < correction_index AS applies")


@query("B5_compile_directives", f"WITH {A.CORR} SELECT correction_id, trim(fact) AS fact, CASE WHEN conv_id % 4 = 0 THEN 'projection ' || conv_id ELSE 'replacement ' || conv_id END AS replacement, correction_index - 1 AS event_index FROM corr WHERE severity = 'blocking'")
def compile_directives(spark, sf):
    """Blocking corrections only; a missing replacement falls back to the projection's; the index is the target's end - 1."""
    rows = A.corr(spark, sf).withColumn("replacement_fact", F.expr("CASE WHEN conv_id % 4 <> 0 THEN concat('replacement ', conv_id) END")).withColumn("replacement_projection", F.expr("concat('projection ', conv_id)"))
    return rows.filter("severity = 'blocking'").selectExpr("correction_id", "trim(fact) AS fact", "coalesce(replacement_fact, replacement_projection) AS replacement", "correction_index - 1 AS event_index")


@query("B6_generic_directives", f"""WITH {A.EV_STREAM} SELECT session_id, event_index, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id ELSE 'event-' || event_index END AS correction_id, CAST(json_extract(substr(payload, 7), '$.k') AS BIGINT) AS k, 'prior_events' AS scope FROM ev_stream WHERE type = 'correction'""")
def generic_directives(spark, sf):
    """Best effort: JSON fields where they are, else defaults, at the correction's own place."""
    rows = A.ev_stream(spark, sf).filter("type = 'correction'").withColumn("body", F.expr("substr(payload, 7)")).withColumn("given", F.expr("CASE WHEN event_id % 3 = 0 THEN concat('c', event_id) END"))
    return rows.withColumn("j", F.from_json("body", "k LONG, scope STRING")).selectExpr("session_id", "event_index", "coalesce(given, concat('event-', event_index)) AS correction_id", "j.k AS k", "coalesce(j.scope, 'prior_events') AS scope")


_PAYLOAD = [
    "correction_id", "CASE WHEN conv_id % 15 = 0 THEN '' ELSE correction_id END AS cid", f"CASE WHEN conv_id % 20 = 0 THEN '{A.ZERO}' ELSE 'f' || correction_id END AS target", "correction_index - CASE WHEN conv_id % 35 = 0 THEN -3 ELSE 1 END AS range_start", "correction_index AS range_end",
    f"CASE WHEN conv_id % 45 = 5 THEN '{A.ZERO}' ELSE 'c' || correction_id END AS certificate", "CASE WHEN conv_id % 55 = 10 THEN '' ELSE 'user' END AS reason_code", "CASE WHEN conv_id % 25 = 0 THEN 0 ELSE 1700000000 END AS created",
]


@query(
    "B7_correction_validity",
    f"WITH {A.CORR}, p AS (SELECT {', '.join(_PAYLOAD)} FROM corr) SELECT correction_id, CASE WHEN cid = '' THEN 'correction_id' WHEN target = '{A.ZERO}' THEN 'target' WHEN range_end < range_start THEN 'range' WHEN certificate = '{A.ZERO}' THEN 'certificate' WHEN reason_code = '' THEN 'reason_code' WHEN created <= 0 THEN 'created' ELSE 'ok' END AS fault FROM p",
)
def correction_validity(spark, sf):
    """The first thing that a correction lacks."""
    rows, c = A.corr(spark, sf).selectExpr(*_PAYLOAD), F.col
    fault = refusal((c("cid") == "", "correction_id"), (c("target") == A.ZERO, "target"), (c("range_end") < c("range_start"), "range"), (c("certificate") == A.ZERO, "certificate"), (c("reason_code") == "", "reason_code"), (c("created") <= 0, "created"))
    return rows.select("correction_id", F.coalesce(fault, F.lit("ok")).alias("fault"))


@query("B15_citation", r"SELECT doc_id, regexp_matches(text || ' [' || (doc_id % 4) || ']', '\[[0-9]*[1-9][0-9]*\]') AS cited, regexp_matches(text, '\[[0-9]*[1-9][0-9]*\]') AS cited_raw FROM documents")
def citation(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", T.cited(F.expr("concat(text, ' [', doc_id % 4, ']')")).alias("cited"), T.cited(F.col("text")).alias("cited_raw"))


_CANONICAL = """'{"Facts":["' || t || ' [' || (doc_id % 4) || ']"],"Reasoning":["r [' || CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END || ']"],"Compliance":[]}'"""


@query(
    "B16_canonical_projection",
    rf"""WITH p AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM documents), c AS (SELECT doc_id, {_CANONICAL} AS canonical, regexp_matches(t || ' [' || (doc_id % 4) || ']', '\[[0-9]*[1-9][0-9]*\]') AND regexp_matches('r [' || CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END || ']', '\[[0-9]*[1-9][0-9]*\]') AS cited FROM p)
SELECT doc_id, canonical, CASE WHEN NOT cited THEN 'uncited' WHEN strlen(canonical) > 1338 THEN 'too_large' ELSE 'ok' END AS status FROM c""",
)
def canonical_projection(spark, sf):
    """Parses a projection, checks that all three lists are there and every item is cited, writes it canonically, and then
    checks its size."""
    docs = A.table(spark, sf, "documents").withColumn("t", F.expr("regexp_replace(text, '[^A-Za-z ]', '')"))
    raw = F.expr("concat('{ \"Facts\" : [ \"', t, ' [', doc_id % 4, ']\" ], \"Compliance\": [], \"Reasoning\": [\"r [', CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END, ']\"] }')")
    p = docs.withColumn("p", F.from_json(raw, "Facts ARRAY<STRING>, Reasoning ARRAY<STRING>, Compliance ARRAY<STRING>"))
    p = p.withColumn("canonical", F.to_json("p")).withColumn("cited", F.coalesce(F.forall(F.concat("p.Facts", "p.Reasoning", "p.Compliance"), T.cited), F.lit(False)))
    return p.select("doc_id", "canonical", F.when(~F.col("cited"), "uncited").when(F.octet_length("canonical") > 1338, "too_large").otherwise("ok").alias("status"))


@query(
    "B17_invalidated_facts",
    f"""WITH f AS (SELECT doc_id, lower(text) AS low, {_low('text')} AS t, list_filter(['The', 'AND', 'zebra', 'the', 'una'], lambda x: contains({_low('text')}, {_low('x')})) AS hit FROM documents)
SELECT doc_id, array_to_string(list_filter(['the', 'and', 'zebra', 'una'], lambda x: contains(t, x)), ',') AS found, len(list_filter(['the', 'and', 'zebra', 'una'], lambda x: contains(t, x))) = 0 AS clean FROM f""",
)
def invalidated_facts(spark, sf):
    """Facts in the text, folded, distinct, in the order given."""
    facts = F.array_distinct(F.transform(F.array(*[F.lit(x) for x in ("The", "AND", "zebra", "the", "una")]), T.ascii_lower))
    rows = A.table(spark, sf, "documents").select("doc_id", T.ascii_lower(F.col("text")).alias("t")).withColumn("hit", F.filter(facts, lambda x: F.contains(F.col("t"), x)))
    return rows.select("doc_id", F.array_join("hit", ",").alias("found"), (F.size("hit") == 0).alias("clean"))


@query("B29_pre_tool_gate", f"WITH {A.EV_CONV}, {A.CORR} SELECT e.session_id, e.event_index, CASE WHEN bool_or(c.fact IS NOT NULL AND c.fact <> '' AND contains({_low('e.payload')}, {_low('c.fact')})) THEN 'deny' ELSE 'allow' END AS decision FROM ev_conv e LEFT JOIN corr c ON e.session_id = c.session_id AND c.severity = 'blocking' GROUP BY e.session_id, e.event_index")
def pre_tool_gate(spark, sf):
    c = A.corr(spark, sf).filter("severity = 'blocking' AND fact <> ''").select("session_id", "fact")
    rows = A.ev_conv(spark, sf).join(c, "session_id", "left").withColumn("hit", F.coalesce(T.ascii_contains(F.col("payload"), F.col("fact")), F.lit(False)))
    return rows.groupBy("session_id", "event_index").agg(F.expr("CASE WHEN bool_or(hit) THEN 'deny' ELSE 'allow' END").alias("decision"))


@query("C1_event_directive_join", f"WITH {A.EV_CONV}, {A.CORR}, {_HITS} SELECT session_id, event_index, correction_id, scope FROM hits")
def event_directive_join(spark, sf):
    return V.matches(A.ev_conv(spark, sf), A.corr(spark, sf), ["session_id"]).select("session_id", "event_index", "correction_id", "scope")


@query(
    "G2_fact_list",
    f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS place FROM documents),
f AS (SELECT doc_id, {_low("trim(word)")} AS folded, arg_min(trim(word), place) AS word, min(place) AS place FROM w WHERE trim(word) <> '' GROUP BY doc_id, folded)
SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS facts FROM f GROUP BY doc_id""",
)
def fact_list(spark, sf):
    words = A.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    return V.first_seen(words, ["doc_id"], "word", "place").groupBy("doc_id").agg(F.expr("listagg(word, ' ') WITHIN GROUP (ORDER BY place)").alias("facts"))


@query("G6_upsert_corrections", "SELECT user_id AS correction_id, arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY user_id")
def upsert_corrections(spark, sf):
    return A.table(spark, sf, "events").groupBy(F.col("user_id").alias("correction_id")).agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("version"))


#: What a user says who corrects.
CORRECTION_KEYWORDS = [
    "you drifted", "180'd", "you went off", "wait wait", "stop doing", "no actually", "actually use", "pull out", "wrong", "redo", "let's not", "don't do that", "i misspoke", "scratch that", "correction", "i changed my mind",
    "instead let's", "back up", "course-correct", "course correct", "got off track", "off the path",
]
_SAID = "CASE (conv_id + turn) % 7 WHEN 0 THEN 'Scratch that, replace A with B. ' || text WHEN 1 THEN 'Summary: it went wrong. Primary request and intent: none' WHEN 2 THEN 'Conversation compacted. Redo.' WHEN 3 THEN 'Let''s not ' || repeat('go on ', 300) ELSE text END"
_QUOTED = [k.replace("'", "''") for k in CORRECTION_KEYWORDS]


@query(
    "B26_correction_signal",
    f"SELECT conv_id, turn, NOT contains(low, 'this session is being continued from a previous conversation') AND NOT starts_with(low, 'conversation compacted') AND NOT (contains(low, 'summary:') AND contains(low, 'primary request and intent:')) AND length(low) <= 1500 AND ({' OR '.join(f"contains(low, '{k}')" for k in _QUOTED)}) AS signal FROM (SELECT *, lower({_SAID}) AS low FROM conversations)",
)
def correction_signal(spark, sf):
    """A short message that holds one of the keywords and is no summary."""
    t = F.lower(F.expr(_SAID))
    has = lambda k: F.contains(t, F.lit(k))
    summary = has("this session is being continued from a previous conversation") | t.startswith("conversation compacted") | (has("summary:") & has("primary request and intent:"))
    return A.table(spark, sf, "conversations").select("conv_id", "turn", (~summary & (F.length(t) <= 1500) & F.exists(F.array(*[F.lit(k) for k in CORRECTION_KEYWORDS]), lambda k: F.contains(t, k))).alias("signal"))


@query("B36_events_to_probe", f"WITH {A.EV_CONV} SELECT session_id, count(*) AS n, max(event_index) + 1 AS range_end FROM ev_conv WHERE event_index <= 3 GROUP BY session_id")
def events_to_probe(spark, sf):
    return L.in_range(A.ev_conv(spark, sf), 0, 4).groupBy("session_id").agg(F.count("*").alias("n"), (F.max("event_index") + 1).alias("range_end"))


@query("B37_log_size", f"WITH {A.EV_CONV} SELECT session_id, sum(length(payload)) AS chars, CASE WHEN sum(length(payload)) > 5000 THEN 'skipped' ELSE 'ok' END AS status FROM ev_conv GROUP BY session_id")
def log_size(spark, sf):
    rows = A.ev_conv(spark, sf).groupBy("session_id").agg(F.sum(F.length("payload")).alias("chars"))
    return rows.withColumn("status", F.expr("CASE WHEN chars > 5000 THEN 'skipped' ELSE 'ok' END"))


@query("E6_probe_points", f"""WITH {A.EV_STREAM}, s AS (SELECT session_id, count(*) AS n FROM ev_stream GROUP BY session_id),
c AS (SELECT session_id, event_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_index) AS r FROM ev_stream WHERE type = 'correction') WHERE r <= 5),
p AS (SELECT session_id, n // 10 AS p FROM s UNION SELECT session_id, n // 2 FROM s UNION SELECT session_id, 4 * n // 5 FROM s UNION SELECT session_id, event_index FROM c)
SELECT s.session_id, p.p AS probe FROM p JOIN s USING (session_id) WHERE p.p >= 5 AND p.p < s.n - 5 AND s.n >= 12""")
def probe_points(spark, sf):
    log = A.ev_stream(spark, sf)
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("event_index"))
    marks = log.filter("type = 'correction'").withColumn("r", first).filter("r <= 5").groupBy("session_id").agg(F.collect_list("event_index").alias("at"))
    s = log.groupBy("session_id").agg(F.count("*").alias("n")).join(marks, "session_id", "left")
    every = F.array_distinct(F.concat(F.expr("array(n div 10, n div 2, 4 * n div 5)"), F.coalesce("at", F.expr("CAST(array() AS ARRAY<BIGINT>)"))))
    return s.filter("n >= 12").select("session_id", "n", F.explode(every).alias("probe")).filter("probe >= 5 AND probe < n - 5").select("session_id", "probe")


@query("E7_next_intent", f"""WITH {A.EV_CONV}, x AS (SELECT session_id, event_index, CASE WHEN type = 'user' AND length(payload) > 16 THEN left(string_split(payload, '.')[1], 80) END AS intent FROM ev_conv)
SELECT session_id, event_index, first_value(intent IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS intent FROM x""")
def next_intent(spark, sf):
    ahead = Window.partitionBy("session_id").orderBy("event_index").rowsBetween(1, 7)
    intent = F.expr("CASE WHEN type = 'user' AND length(payload) > 16 THEN left(split(payload, '[.]')[0], 80) END")
    return A.ev_conv(spark, sf).withColumn("i", intent).select("session_id", "event_index", F.first("i", ignorenulls=True).over(ahead).alias("intent"))


@query("E8_next_tool_call", f"""WITH {A.EV_STREAM} SELECT session_id, event_index, first_value(CASE WHEN type = 'tool' THEN event_index END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_index ROWS BETWEEN 1 FOLLOWING AND 11 FOLLOWING) AS next_tool FROM ev_stream""")
def next_tool_call(spark, sf):
    ahead = Window.partitionBy("session_id").orderBy("event_index").rowsBetween(1, 11)
    return A.ev_stream(spark, sf).select("session_id", "event_index", F.first(F.expr("CASE WHEN type = 'tool' THEN event_index END"), ignorenulls=True).over(ahead).alias("next_tool"))


@query("E4_handoff_index", f"""WITH {A.EV_STREAM} SELECT session_id, coalesce(min(event_index) FILTER (payload LIKE 'signup%'), min(event_index) FILTER (type = 'correction'), min(event_index) FILTER (type = 'tool'), count(*) // 2) AS handoff FROM ev_stream GROUP BY session_id""")
def handoff_index(spark, sf):
    first = lambda c: F.min(F.when(F.expr(c), F.col("event_index")))
    return A.ev_stream(spark, sf).groupBy("session_id").agg(F.coalesce(first("payload LIKE 'signup%'"), first("type = 'correction'"), first("type = 'tool'"), F.expr("count(*) div 2")).alias("handoff"))
