"""Queries of scalar and text functions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import protocol as P
from ..functions import text as T
from ..operators import eventlog as L
from ..operators.audit import refusal
from ..sources import adapters as A

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _docs(spark, sf):
    return A.table(spark, sf, "documents")


@query("H1_ascii_lower", f"SELECT doc_id, md5(translate(text, '{UP}', '{LOW}')) AS folded, translate(text, '{UP}', '{LOW}') = lower(text) AS same FROM documents")
def ascii_lower(spark, sf):
    low = T.ascii_lower(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(low).alias("folded"), (low == F.lower("text")).alias("same"))


@query("H2_unicode_contains", "SELECT doc_id, contains(lower(text), lower('ÉAU')) AS eau, contains(lower(text), 'über') AS ueber FROM documents")
def unicode_contains(spark, sf):
    return _docs(spark, sf).select("doc_id", T.folded_contains(F.col("text"), F.lit("ÉAU")).alias("eau"), T.folded_contains(F.col("text"), F.lit("über")).alias("ueber"))


@query("H4_stripped_contains", r"SELECT doc_id, contains(lower(regexp_replace(text, '\s', '', 'g')), 'ofthe') AS has FROM documents")
def stripped_contains(spark, sf):
    return _docs(spark, sf).select("doc_id", T.stripped_contains(F.col("text"), F.lit("Of The")).alias("has"))


@query("H5_numeric_contains", r"SELECT event_id, contains(regexp_replace(props || value, '[^0-9.]', '', 'g'), (event_id % 50)::VARCHAR) AS has, false AS empty FROM events")
def numeric_contains(spark, sf):
    t = F.concat("props", F.col("value").cast("string"))
    return A.table(spark, sf, "events").select("event_id", T.numeric_contains(t, (F.col("event_id") % 50).cast("string")).alias("has"), T.numeric_contains(t, F.lit("none")).alias("empty"))


@query("H7_redaction")
def redaction(spark, sf):
    """Planted secrets of four kinds, some too short; the raw token lines must stay."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    key = F.concat(F.lit(" AKIA"), F.upper(F.substring(h, 1, 16)), F.lit(" ghp_"), F.substring(h, 1, 36), F.lit(" client_secret: "), F.substring(h, 1, 44), F.lit(" aws_secret_access_key='"), F.substring(h, 1, 39), F.lit("'"))
    rows = _docs(spark, sf).withColumn("t", F.when(F.col("doc_id") % 3 == 0, F.concat("text", key)).otherwise(F.col("text"))).withColumn("r", P.redacted("t"))
    return rows.select("doc_id", F.col("r.found").alias("found"), F.col("r.audit").alias("audit"), (F.length("r.text") == F.length("t")).alias("same_length"), F.md5("r.text").alias("digest"))


@query("H8_literal_strip", f"SELECT doc_id, md5(regexp_replace(text, 'the', '{T.REVOKED}', 'gi')) AS stripped FROM documents")
def literal_strip(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.regexp_replace("text", r"(?i)\Qthe\E", T.REVOKED)).alias("stripped"))


@query("H9_clip", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS clipped FROM documents")
def clip(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clip(F.col("text"), 80).alias("clipped"))


@query("H10_token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END AS tokens, length(text) // 4 AS floor_tokens FROM documents")
def token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), F.expr("length(text) div 4").alias("floor_tokens"))


#: Prompts of users who correct, by all forms, and others.
_SAY = (
    "CASE conv_id % 9 WHEN 0 THEN 'Please replace \"foo bar ' || turn || '\" with ''baz qux''. ' || text WHEN 1 THEN 'wrong: old_name -> new_name' || chr(10) || text WHEN 2 THEN 'It is not alpha one, use beta two instead' "
    "WHEN 3 THEN 'Please forget the stale gamma value. ' || text WHEN 4 THEN 'that was invalid  => this is right' WHEN 5 THEN 'Actually, do not use the prior plan' WHEN 6 THEN 'A correction: ' || text WHEN 7 THEN 'do it instead' ELSE text END"
)
#: One of these must occur in a correction.
HINTS = ["actually", "correction", "correcting", "wrong", "instead", "replace", "forget", "ignore the prior", "ignore prior", "ignore previous", "invalid", "stale"]
#: The forms of a correction; groups are what is invalid and what replaces it.
FORMS = [
    r"(?i)\breplace\s+['\"]?(.{3,160}?)['\"]?\s+with\s+['\"]?(.{3,160}?)['\"]?(?:[.\n]|$)",
    r"(.{3,160}?)\s*(?:->|=>)\s*(.{3,160}?)(?:[.\n]|$)",
    r"(?i)\bnot\s+['\"]?(.{3,160}?)['\"]?\s*(?:,|;|\.)\s*(?:use|it is|it's|instead)?\s*['\"]?(.{3,160}?)?['\"]?(?:[.\n]|$)",
    r"(?i)\b(?:forget|do not use|don't use|ignore)\s+(?:the\s+)?(?:old|prior|previous|stale|invalidated)\s+['\"]?(.{3,160}?)()['\"]?(?:[.\n]|$)",
]
_EDGES = " \t\r\n'\"`:-"


def _facts_sql(group: int) -> str:
    clean = lambda f: f"trim(regexp_replace(regexp_extract(t, '{f.replace(chr(39), chr(39) * 2)}', {group}), '\\s+', ' ', 'g'), '{_EDGES.replace(chr(39), chr(39) * 2)}')"
    return f"list_filter([{', '.join(clean(f) for f in FORMS)}], lambda x: length(x) >= 3)"


def _distinct_sql(of: str) -> str:
    return f"list_filter({of}, lambda x, i: list_position(list_transform({of}, lambda y: lower(y)), lower(x)) = i)"


def _may(t: Column, form: str) -> Column:
    """False only if the form cannot match: one that begins with anything up to an arrow tries every place of a text without one."""
    return F.contains(t, F.lit("->")) | F.contains(t, F.lit("=>")) if form.startswith(".") or form.startswith("(.") else F.lit(True)


def says(t: Column) -> Column:
    """Whether a message has one of the forms of a correction."""
    return reduce(lambda a, b: a | b, [_may(t, f) & t.rlike(f) for f in PROMPT_FORMS])


def _facts(t: Column, group: int) -> Column:
    """Clean facts of three characters or more, those first that the first forms find; repeats, whatever their case, go."""
    found = F.array(*[F.btrim(F.regexp_replace(F.when(_may(t, f), F.regexp_extract(t, f, group)).otherwise(""), r"\s+", " "), F.lit(_EDGES)) for f in FORMS])
    kept = F.filter(found, lambda x: F.length(x) >= 3)
    return T.distinct_folded(kept)


@query("H11_correction_extraction", f"WITH c AS (SELECT conv_id, turn, {_SAY} AS t FROM conversations), f AS (SELECT conv_id, turn, {_facts_sql(1)} AS old, {_facts_sql(2)} AS new FROM c) SELECT conv_id, turn, array_to_string({_distinct_sql('old')}, '|') AS invalidated, array_to_string({_distinct_sql('new')}, '|') AS replacements, CASE WHEN len(old) > 0 THEN 'blocking' ELSE 'info' END AS severity FROM f")
def correction_extraction(spark, sf):
    c = A.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_SAY).alias("t")).withColumn("old", _facts(F.col("t"), 1)).withColumn("new", _facts(F.col("t"), 2))
    return c.select("conv_id", "turn", F.array_join("old", "|").alias("invalidated"), F.array_join("new", "|").alias("replacements"), F.when(F.size("old") > 0, "blocking").otherwise("info").alias("severity"))


_POLICY = "'1. Always call `' || role || '`. ' || regexp_replace(coalesce(text, ''), '[0-9`.]', ' '{all}) || ' 2. Never use `t' || turn || '`. 3. ' || role || ' may ask for `save`'"


@query("H12_clauses", rf"WITH c AS (SELECT conv_id, turn, {_POLICY.format(all=", 'g'")} AS t FROM conversations), x AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(t, '[0-9]+\. '), lambda p: p <> '')) AS clause FROM c) SELECT conv_id, turn, md5(trim(clause)) AS clause, regexp_extract(clause, '`(\w+)`', 1) AS tool, contains(clause, 'Never') AS negative FROM x")
def clauses(spark, sf):
    """Policies of numbered clauses around each message, split into clauses with the tools they name."""
    c = A.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_POLICY.format(all="")).alias("t"))
    x = c.select("conv_id", "turn", F.explode(F.filter(F.split("t", r"[0-9]+\. "), lambda p: p != "")).alias("clause"))
    return x.select("conv_id", "turn", F.md5(F.trim("clause")).alias("clause"), F.regexp_extract("clause", r"`(\w+)`", 1).alias("tool"), F.contains("clause", F.lit("Never")).alias("negative"))


@query("H13_sanitise", r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]', '-', 'g'), '^\.+', ''), ''), 'default') AS id, coalesce(nullif(regexp_replace('..' || page_id % 2, '^\.+', ''), ''), 'default') AS dots FROM pages")
def sanitise(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", T.sanitised(F.col("url")).alias("id"), T.sanitised(F.expr("concat('..', page_id % 2)")).alias("dots"))


#: Whole messages with a closed channel, an open one, or none.
_MARKED = "CASE conv_id % 3 WHEN 0 THEN left(text, 30) || '<think>' || substr(text, 31, 20) || '</think>' || substr(text, 51) WHEN 1 THEN left(text, 30) || '<think>' || substr(text, 31) ELSE text END"


def _marked(spark, sf):
    return A.table(spark, sf, "conversations").selectExpr("conv_id", "turn", _MARKED + " AS t")


@query("H15_channel_extraction", rf"WITH c AS (SELECT conv_id, turn, {_MARKED} AS t FROM conversations) SELECT conv_id, turn, array_to_string(regexp_extract_all(t, '(?s)<think>(.*?)(?:</think>|$)', 1), '') AS channel, regexp_replace(t, '(?s)<think>.*?(</think>|$)', '', 'g') AS rest FROM c")
def channel_extraction(spark, sf):
    return _marked(spark, sf).select("conv_id", "turn", P.channel_text(F.col("t")).alias("channel"), P.without_channel(F.col("t")).alias("rest"))


@query("H16_open_channel", rf"WITH c AS (SELECT conv_id, turn, {_MARKED} AS t FROM conversations) SELECT conv_id, turn, contains(t, '<think>') AND NOT contains(t, '</think>') AS open FROM c")
def open_channel(spark, sf):
    return _marked(spark, sf).select("conv_id", "turn", P.channel_open(F.col("t")).alias("open"))


@query("H17_overlap", "WITH d AS (SELECT doc_id, text || left('</think>', CAST(doc_id % 9 AS INTEGER)) AS t FROM documents), k AS (SELECT doc_id, t, unnest(generate_series(1, 8)) AS n FROM d) SELECT doc_id, coalesce(max(n) FILTER (right(t, n) = left('</think>', n)), 0) AS held FROM k GROUP BY doc_id")
def overlap(spark, sf):
    t = F.expr("concat(text, left('</think>', CAST(doc_id % 9 AS INT)))")
    return _docs(spark, sf).withColumn("t", t).select("doc_id", T.overlap(F.col("t"), F.lit("</think>"), 8).alias("held"))


@query("H18_fence_split", r"WITH c AS (SELECT doc_id, replace(text, '`', '') AS a FROM documents), t AS (SELECT doc_id, a, a || '```tool' || chr(10) || 'f(x=' || doc_id || ')' || chr(10) || '```' || ' end' AS t FROM c) SELECT doc_id, a || ' end' AS prose, 'f(x=' || doc_id || ')' AS code FROM t")
def fence_split(spark, sf):
    t = F.expr("concat(replace(text, '`', ''), '```tool\nf(x=', doc_id, ')\n```', ' end')")
    d = _docs(spark, sf).select("doc_id", t.alias("t"))
    return d.select("doc_id", F.regexp_replace("t", r"(?s)```tool\n.*?\n```", "").alias("prose"), F.regexp_extract("t", r"(?s)```tool\n(.*?)\n```", 1).alias("code"))


@query("H19_tool_calls", """SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE event_type END AS name, CASE WHEN event_id % 10 = 9 THEN NULL ELSE '{"k": ' || (event_id % 7) || ', "who": "u' || user_id || '"}' END AS arguments FROM events""")
def tool_calls(spark, sf):
    """Three dialects of one call; every tenth is malformed."""
    e = A.table(spark, sf, "events")
    text = F.expr("CASE WHEN event_id % 10 = 9 THEN 'broken(' WHEN event_id % 3 = 0 THEN concat(event_type, '(k=', event_id % 7, ', who=\"u', user_id, '\")') WHEN event_id % 3 = 1 THEN concat('{\"name\":\"', event_type, '\",\"args\":{\"k\":', event_id % 7, ',\"who\":\"u', user_id, '\"}}') ELSE concat('call:', event_type, '{k:', event_id % 7, ',who:<escape>u', user_id, '<escape>}') END")
    dialect = F.expr("CASE event_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'json' ELSE 'fc' END")
    return e.select("event_id", P.tool_call(text, dialect).alias("c")).select("event_id", "c.name", "c.arguments")


@query("H20_value_formats", """SELECT event_id, event_type || '(k=' || CAST(json_extract(props, '$.k') AS BIGINT) || ', user="u' || user_id || '", ok=' || CASE WHEN value > 20 THEN 'True' ELSE 'False' END || ')' AS call FROM events""")
def value_formats(spark, sf):
    k = F.get_json_object("props", "$.k")
    return A.table(spark, sf, "events").select("event_id", F.concat("event_type", F.lit("(k="), k, F.lit(', user="u'), "user_id", F.lit('", ok='), F.when(F.col("value") > 20, "True").otherwise("False"), F.lit(")")).alias("call"))


@query("H21_chat_template", "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id")
def chat_template(spark, sf):
    c = A.table(spark, sf, "conversations").withColumn("m", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")))
    return c.groupBy("conv_id").agg(F.expr("concat(listagg(m, '') WITHIN GROUP (ORDER BY turn), '<|im_start|>assistant\n')").alias("prompt"))


@query("H22_prompt_affixes", "WITH c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, CASE WHEN (conv_id + turn) % 9 = 4 THEN '<bos>' || text ELSE text END AS t FROM conversations) SELECT conv_id, turn, starts_with(t, '<bos>') AS refused, CASE WHEN NOT starts_with(t, '<bos>') THEN CASE WHEN turn = 0 THEN '<bos><user>' ELSE '' END || t || CASE WHEN turn = last THEN '</user><model>' ELSE '' END END AS chunk FROM c")
def prompt_affixes(spark, sf):
    """The start mark once, the user's prefix on the first chunk, suffix and the model's prefix on the last, others raw; a
    text that begins with the start mark itself is refused."""
    c = A.table(spark, sf, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id"))).withColumn("t", F.expr("CASE WHEN (conv_id + turn) % 9 = 4 THEN concat('<bos>', text) ELSE text END"))
    chunk = F.concat(F.when(F.col("turn") == 0, "<bos><user>").otherwise(""), "t", F.when(F.col("turn") == F.col("last"), "</user><model>").otherwise(""))
    return c.select("conv_id", "turn", F.col("t").startswith("<bos>").alias("refused"), F.when(~F.col("t").startswith("<bos>"), chunk).alias("chunk"))


@query("H23_placeholder_split", "WITH d AS (SELECT doc_id, regexp_replace(text, '[|<>]', '', 'g') AS a FROM documents), t AS (SELECT doc_id, string_split(a || '|<image>|' || a || '|<audio>|x', '|') AS parts FROM d) SELECT doc_id, place, part, CASE part WHEN '<image>' THEN 'image' WHEN '<audio>' THEN 'audio' ELSE 'text' END AS kind FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS place FROM t)")
def placeholder_split(spark, sf):
    d = _docs(spark, sf).withColumn("a", F.regexp_replace("text", "[|<>]", "")).withColumn("t", F.concat("a", F.lit("<image>"), "a", F.lit("<audio>x")))
    parts = d.select("doc_id", F.posexplode(F.split(F.regexp_replace("t", "(<image>|<audio>)", "|$1|"), r"\|")).alias("place", "part"))
    return parts.select("doc_id", "place", "part", F.when(F.col("part") == "<image>", "image").when(F.col("part") == "<audio>", "audio").otherwise("text").alias("kind"))


_TYPES = {"String": "string", "Int": "integer", "Boolean": "boolean", "Float": "number", "Double": "number", "List": "array"}


@query("H24_name_cases", r"WITH n AS (SELECT DISTINCT event_type, 'get' || upper(left(event_type, 1)) || substr(event_type, 2) || 'HTTPNow' AS camel, 'get_' || event_type || '_now_2x' AS under, CASE event_type WHEN 'click' THEN 'Int' WHEN 'view' THEN 'Double' WHEN 'error' THEN 'Boolean' WHEN 'signup' THEN 'List' ELSE 'Any' END AS type FROM events), p AS (SELECT *, string_split(under, '_') AS parts FROM n) SELECT event_type, lower(list_aggregate(list_transform(regexp_extract_all(camel, '.'), lambda c, i: CASE WHEN i > 1 AND regexp_matches(c, '[A-Z]') THEN '_' || c ELSE c END), 'string_agg', '')) AS snake, list_aggregate(list_transform(parts, lambda w, i: CASE WHEN i = 1 THEN w WHEN regexp_matches(w, '^[a-z]') THEN upper(left(w, 1)) || substr(w, 2) ELSE '_' || w END), 'string_agg', '') AS camel, CASE type WHEN 'Int' THEN 'integer' WHEN 'Double' THEN 'number' WHEN 'Boolean' THEN 'boolean' WHEN 'List' THEN 'array' END AS json_type FROM p")
def name_cases(spark, sf):
    """An underscore before every capital that follows a letter, and back; the type's name in a schema, null if unsupported."""
    n = A.table(spark, sf, "events").select("event_type").distinct().withColumn("kind", F.expr("CASE event_type WHEN 'click' THEN 'Int' WHEN 'view' THEN 'Double' WHEN 'error' THEN 'Boolean' WHEN 'signup' THEN 'List' ELSE 'Any' END"))
    camel, under = F.concat(F.lit("get"), F.initcap("event_type"), F.lit("HTTPNow")), F.concat(F.lit("get_"), "event_type", F.lit("_now_2x"))
    back = F.array_join(F.transform(F.split(under, "_"), lambda w, i: F.when(i == 0, w).when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(F.concat(F.lit("_"), w))), "")
    types = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    return n.select("event_type", F.lower(F.regexp_replace(camel, "(?<=[a-zA-Z])([A-Z])", "_$1")).alias("snake"), back.alias("camel"), types[F.col("kind")].alias("json_type"))


@query("H26_json_escape", r"SELECT doc_id, CASE WHEN text IS NOT NULL THEN md5(replace(CAST(to_json(text) AS VARCHAR), '\/', '/')) END AS escaped FROM documents")
def json_escape(spark, sf):
    j = F.to_json(F.struct(F.col("text").alias("t")))
    return _docs(spark, sf).select("doc_id", F.when(F.col("text").isNotNull(), F.md5(F.substr(j, F.lit(6), F.length(j) - 6))).alias("escaped"))


@query("H27_stop_cut", "SELECT doc_id, md5(left(text, coalesce(least(nullif(strpos(text, '. '), 0), nullif(strpos(text, chr(10)), 0), nullif(strpos(text, 'zzz'), 0)) - 1, length(text))::INT)) AS cut FROM documents")
def stop_cut(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.cut_at_stop(F.col("text"), [". ", "\n", "zzz"])).alias("cut"))


@query("H28_greedy_flag", "SELECT d.doc_id, n.doc_id AS other, starts_with(d.text, left(n.text, 1 + CAST(d.doc_id % 5 AS INTEGER))) AS greedy FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1")
def greedy_flag(spark, sf):
    """Does a generation (a text) start with the continuation that is asked about (the first characters of the next text)?"""
    asked = _docs(spark, sf).selectExpr("doc_id AS other", "doc_id - 1 AS doc_id", "left(text, CAST(1 + (doc_id - 1) % 5 AS INT)) AS continuation")
    return _docs(spark, sf).select("doc_id", "text").join(asked, "doc_id", "left").select("doc_id", "other", F.expr("startswith(text, continuation)").alias("greedy"))


@query("H30_tokens", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), v AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS id FROM (SELECT DISTINCT w FROM w)) SELECT w.w AS token, min(v.id) AS id, count(*) AS uses FROM w JOIN v USING (w) GROUP BY w.w")
def tokens(spark, sf):
    """A vocabulary in order of token, its ids, and their uses."""
    w = _docs(spark, sf).select(F.explode(F.split("text", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    return L.numbered(w, "token", "id")


_FILES = "SELECT page_id, split_part(url, '#', 1) || CASE page_id % 8 WHEN 0 THEN '.tflite' WHEN 1 THEN '.task' WHEN 2 THEN '.litertlm' ELSE '' END AS path, CASE page_id % 8 WHEN 3 THEN 'LITERTLM' WHEN 4 THEN chr(28) || 'xxxTFL3' WHEN 5 THEN 'PK' WHEN 6 THEN ' LITERTLM' ELSE '' END || html AS content FROM pages"


@query("A34_format_sniff", f"SELECT page_id, CASE WHEN ends_with(path, '.tflite') THEN 'tflite' WHEN ends_with(path, '.task') THEN 'task' WHEN ends_with(path, '.litertlm') THEN 'litertlm' WHEN contains(head, 'TFL3') THEN 'tflite' WHEN contains(head, 'PK') THEN 'task' WHEN starts_with(head, 'LITERTLM') THEN 'litertlm' ELSE 'unknown' END AS format FROM (SELECT *, left(content, 8) AS head FROM ({_FILES}))")
def format_sniff(spark, sf):
    """By extension, else by what the first eight characters hold."""
    p = A.table(spark, sf, "pages").selectExpr("page_id", "concat(split_part(url, '#', 1), CASE page_id % 8 WHEN 0 THEN '.tflite' WHEN 1 THEN '.task' WHEN 2 THEN '.litertlm' ELSE '' END) AS path", "concat(CASE page_id % 8 WHEN 3 THEN 'LITERTLM' WHEN 4 THEN concat(chr(28), 'xxxTFL3') WHEN 5 THEN 'PK' WHEN 6 THEN ' LITERTLM' ELSE '' END, html) AS content")
    head, path = F.expr("left(content, 8)"), F.col("path")
    named = F.when(path.endswith(".tflite"), "tflite").when(path.endswith(".task"), "task").when(path.endswith(".litertlm"), "litertlm")
    found = F.when(F.contains(head, F.lit("TFL3")), "tflite").when(F.contains(head, F.lit("PK")), "task").when(head.startswith("LITERTLM"), "litertlm")
    return p.select("page_id", F.coalesce(named, found, F.lit("unknown")).alias("format"))


@query("A36_item_data", "SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'path' WHEN 2 THEN 'blob' ELSE 'error' END AS kind, CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 1 THEN '/data/' || turn WHEN 2 THEN text END AS value FROM conversations")
def item_data(spark, sf):
    c = A.table(spark, sf, "conversations").withColumn("k", F.expr("(conv_id + turn) % 4")).withColumn("blob", F.base64(F.col("text").cast("binary")))
    return c.select("conv_id", "turn", F.expr("CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'path' WHEN 2 THEN 'blob' ELSE 'error' END").alias("kind"), F.when(F.col("k") == 0, F.col("text")).when(F.col("k") == 1, F.concat(F.lit("/data/"), "turn")).when(F.col("k") == 2, F.unbase64("blob").cast("string")).alias("value"))


@query("A30_hook_ledger", "SELECT user_id, count(*) AS entries, sum(least(strlen(props), 4000))::BIGINT AS kept FROM events GROUP BY user_id")
def hook_ledger(spark, sf):
    """One JSON line per event, its strings clipped to 4000 characters."""
    rows = A.table(spark, sf, "events").select("user_id", F.to_json(F.struct(F.expr("left(props, 4000)").alias("p"))).alias("line"))
    return rows.groupBy("user_id").agg(F.count("*").alias("entries"), F.sum(F.length(F.get_json_object("line", "$.p"))).alias("kept"))


_NOISE = "CASE (conv_id * 3 + turn) % 9 WHEN 0 THEN '<local-command-caveat>x</local-command-caveat> ' || text WHEN 1 THEN '<system-reminder>' || text WHEN 2 THEN '[Request interrupted by user] 1' || chr(9) || 'a' WHEN 3 THEN ' 1' || chr(9) || 'import x' || chr(10) || ' 2' || chr(9) || 'y' WHEN 4 THEN 'Tool ran without output' WHEN 5 THEN '<tool_use_error>no' WHEN 6 THEN '' ELSE text END"


@query("B25_meta_filter", rf"SELECT conv_id, turn, CASE WHEN t = '' OR contains(t, '<local-command-caveat>') OR starts_with(t, '<system-reminder>') THEN true WHEN starts_with(t, '[Request interrupted by user') THEN false ELSE regexp_matches(t, '^\s*1\t.+\n\s*2\t') OR starts_with(t, 'Tool ran without output') OR starts_with(t, '<tool_use_error>') END AS meta FROM (SELECT conv_id, turn, {_NOISE} AS t FROM conversations)")
def meta_filter(spark, sf):
    """Messages that no user wrote: caveats, reminders, numbered pastes and tool results."""
    t = F.expr(_NOISE)
    pasted = t.rlike(r"^\s*1\t.+\n\s*2\t") | t.startswith("Tool ran without output") | t.startswith("<tool_use_error>")
    meta = F.when((t == "") | F.contains(t, F.lit("<local-command-caveat>")) | t.startswith("<system-reminder>"), True).when(t.startswith("[Request interrupted by user"), False).otherwise(pasted)
    return A.table(spark, sf, "conversations").select("conv_id", "turn", meta.alias("meta"))


#: The forms that make a prompt with a hint a correction.
PROMPT_FORMS = [r"(?i)\breplace\s+.+\s+with\s+.+", r".+\s*(?:->|=>)\s*.+", r"(?i)\b(?:forget|ignore|do not use|don't use)\s+(?:the\s+)?(?:old|prior|previous|stale|invalidated)\b"]
_FORMS_SQL = " OR ".join("regexp_matches(t, '" + f.replace("'", "''") + "')" for f in PROMPT_FORMS)


@query("B27_correction_prompt", f"WITH c AS (SELECT conv_id, turn, {_SAY} AS t FROM conversations) SELECT conv_id, turn, ({' OR '.join(f"contains(lower(t), '{h}')" for h in HINTS)}) AND ({_FORMS_SQL} OR contains(lower(t), 'correction') OR contains(lower(t), 'correcting')) AS correction FROM c")
def correction_prompt(spark, sf):
    t = F.expr(_SAY)
    low = F.lower(t)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return A.table(spark, sf, "conversations").select("conv_id", "turn", (has(HINTS) & (says(t) | has(["correction", "correcting"]))).alias("correction"))


#: Tools that change files, shells, and shell commands that matter.
EDITORS, EDITORS_FOLDED, SHELLS = ["Edit", "Write", "MultiEdit", "NotebookEdit"], ["edit", "create", "write_file", "replace", "notebookedit"], ["bash", "powershell", "run_shell_command"]
RISKY = r"(?i)\b(git\s+(commit|push|merge|rebase|tag)|gh\s+pr|aws\s+|scp\s+|rsync\s+|kubectl\s+|terraform\s+(apply|destroy)|rm\s+(-|/)|Remove-Item\b|del\s+|move\s+|mv\s+|copy\s+|cp\s+|python\s+.*setup|bazel\s+(run|test|build))"
_TOOL = [
    "CASE event_id % 11 WHEN 0 THEN 'Edit' WHEN 1 THEN 'write_file' WHEN 2 THEN 'mcp__db__delete_row' WHEN 3 THEN 'mcp__db__read' WHEN 4 THEN 'Read' WHEN 5 THEN 'PowerShell' WHEN 6 THEN 'EDIT' ELSE 'Bash' END AS tool",
    "CASE event_id % 7 WHEN 0 THEN 'rm -rf /tmp/x' WHEN 1 THEN 'git  Push origin' WHEN 2 THEN 'git status' WHEN 3 THEN 'python -m setup' WHEN 4 THEN 'Remove-Item x' WHEN 5 THEN 'terraform plan' ELSE 'ls' END AS command",
]
_names = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query("B28_decision_boundary", f"SELECT event_id, CASE WHEN tool IN ({_names(EDITORS)}) OR lower(tool) IN ({_names(EDITORS_FOLDED)}) THEN true WHEN starts_with(tool, 'mcp__') THEN regexp_matches(tool, '(write|create|update|delete|merge|deploy)') WHEN lower(tool) IN ({_names(SHELLS)}) THEN regexp_matches(command, '{RISKY}') ELSE false END AS boundary FROM (SELECT event_id, {', '.join(_TOOL)} FROM events)")
def decision_boundary(spark, sf):
    e, tool = A.table(spark, sf, "events").selectExpr("event_id", *_TOOL), F.col("tool")
    boundary = F.when(tool.isin(EDITORS) | F.lower(tool).isin(EDITORS_FOLDED), True).when(tool.startswith("mcp__"), tool.rlike("(write|create|update|delete|merge|deploy)")).when(F.lower(tool).isin(SHELLS), F.col("command").rlike(RISKY)).otherwise(False)
    return e.select("event_id", boundary.alias("boundary"))


@query("B30_event_classes", f"WITH {A.EV_STREAM} SELECT event_id, CASE WHEN payload LIKE 'signup%' THEN 'handoff' WHEN type = 'correction' THEN 'correction' WHEN tokens > 50 THEN 'milestone' ELSE type END AS class FROM ev_stream")
def event_classes(spark, sf):
    return A.ev_stream(spark, sf).select("event_id", F.when(F.col("payload").startswith("signup"), "handoff").when(F.col("type") == "correction", "correction").when(F.col("tokens") > 50, "milestone").otherwise(F.col("type")).alias("class"))


#: For each page's model: what is declared, what three token ids mean ('?' for the middle of a sequence, null for an unknown
#: id), and how often the audio mark is split.
_PROBED = [
    "page_id", "CASE WHEN page_id % 7 = 0 THEN 'declared' END AS declared", "CASE WHEN page_id % 2 = 0 THEN 256000 ELSE 17 END AS audio_id", "1 + page_id % 10 // 9 AS audio_ids",
    "CASE page_id % 5 WHEN 0 THEN '?' WHEN 1 THEN NULL ELSE 'x' END AS first", "CASE page_id % 3 WHEN 0 THEN '<start_of_turn>' WHEN 1 THEN '?' ELSE NULL END AS second", "CASE WHEN page_id % 4 < 3 THEN '<start_of_turn>' ELSE 'y' END AS third",
]


@query(
    "B38_model_family",
    f"""WITH p AS (SELECT {', '.join(_PROBED)} FROM pages) SELECT page_id, CASE WHEN declared IS NOT NULL THEN declared WHEN first IS NULL THEN 'generic'
  WHEN first <> '<start_of_turn>' AND second IS NULL THEN 'generic' WHEN '<start_of_turn>' IN (first, second, third) THEN CASE WHEN audio_ids = 1 AND audio_id = 256000 THEN 'multimodal' ELSE 'text' END ELSE 'generic' END AS family FROM p""",
)
def model_family(spark, sf):
    """What is declared wins; else the first id that means the start of a turn decides with the audio mark's ids. An id in the
    middle of a sequence is passed over, an unknown one ends the search."""
    p = A.table(spark, sf, "pages").selectExpr(*[c.replace(" // ", " div ") for c in _PROBED])
    found = F.when((F.col("audio_ids") == 1) & (F.col("audio_id") == 256000), "multimodal").otherwise("text")
    ids = F.array("first", "second", "third")
    state = F.aggregate(ids, F.lit(""), lambda s, t: F.when(s != "", s).when(t.isNull(), "unknown").when(t == "<start_of_turn>", "found").otherwise(s))
    return p.select("page_id", F.coalesce("declared", F.when(state == "found", found), F.lit("generic")).alias("family"))


@query("B40_strip_thinking", rf"WITH c AS (SELECT conv_id, turn, {_MARKED} AS t FROM conversations) SELECT conv_id, turn, trim(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')) AS answer FROM c")
def strip_thinking(spark, sf):
    return _marked(spark, sf).select("conv_id", "turn", F.trim(F.regexp_replace("t", r"(?s)<think>.*?</think>", "")).alias("answer"))


@query("H70_json_getters", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), -1) AS missing FROM events")
def json_getters(spark, sf):
    v = F.parse_json("props")
    return A.table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "long"), F.lit(-1)).alias("missing"))


@query("H71_correction_codec", f"WITH {A.CORR} SELECT correction_id, fact, scope, 1 AS facts, severity = 'blocking' AS interrupt FROM corr")
def correction_codec(spark, sf):
    j = A.corr(spark, sf).select(F.to_json(F.struct("correction_id", F.array("fact").alias("invalidated_facts"), "scope", F.expr("severity = 'blocking'").alias("must_interrupt_before_next_predict"))).alias("j"))
    c = j.withColumn("c", F.from_json("j", "correction_id STRING, invalidated_facts ARRAY<STRING>, scope STRING, must_interrupt_before_next_predict BOOLEAN"))
    return c.selectExpr("c.correction_id", "c.invalidated_facts[0] AS fact", "c.scope", "size(c.invalidated_facts) AS facts", "c.must_interrupt_before_next_predict AS interrupt")


_AID = [
    "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '\"aid_version\":' || CASE c_custkey % 9 WHEN 1 THEN '2' WHEN 2 THEN '\"1\"' ELSE '1' END || ',' END", "CASE WHEN c_custkey % 11 = 3 THEN '' ELSE '\"schema_id\":\"s1\",' END",
    "'\"tenant_id\":' || CASE WHEN c_custkey % 13 = 5 THEN '7' ELSE '\"t' || c_nationkey || '\"' END || ',\"session_id\":\"s' || c_custkey || '\"'", "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN ',\"components\":{}' ELSE ',\"components\":[{\"id\":\"event_log\"}]' END",
]
_DOCUMENT = "'{' || " + " || ".join(_AID) + " || '}'"


@query("H72_identity_document", f"""WITH d AS (SELECT c_custkey, {_DOCUMENT} AS aid FROM customer) SELECT c_custkey, sha256(aid) AS digest, CASE WHEN json_type(aid, '$.aid_version') IS NULL OR json_type(aid, '$.aid_version') NOT IN ('UBIGINT', 'BIGINT') THEN 'aid_version' WHEN json_extract_string(aid, '$.aid_version') <> '1' THEN 'unsupported'
  WHEN coalesce(json_type(aid, '$.schema_id'), '') <> 'VARCHAR' THEN 'schema_id' WHEN coalesce(json_type(aid, '$.tenant_id'), '') <> 'VARCHAR' THEN 'tenant_id' WHEN coalesce(json_type(aid, '$.session_id'), '') <> 'VARCHAR' THEN 'session_id' WHEN coalesce(json_type(aid, '$.components'), '') <> 'ARRAY' THEN 'components' ELSE 'ok' END AS fault FROM d""")
def identity_document(spark, sf):
    """The first field that is missing or of another type than it must be."""
    d = A.table(spark, sf, "customer").select("c_custkey", F.expr(_DOCUMENT).alias("aid")).withColumn("v", F.parse_json("aid"))
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant")), F.lit(""))
    fault = refusal((kind("aid_version") != "BIGINT", "aid_version"), (F.try_variant_get("v", "$.aid_version", "long") != 1, "unsupported"), *[(kind(f) != "STRING", f) for f in ("schema_id", "tenant_id", "session_id")], (~kind("components").startswith("ARRAY"), "components"))
    return d.select("c_custkey", F.sha2("aid", 256).alias("digest"), F.coalesce(fault, F.lit("ok")).alias("fault"))


@query("H73_handoff_bundle", f"""WITH {A.EV_CONV} SELECT session_id, '{{"session_id":"' || session_id || '","range":[1,' || count(*) || '],"task":"continue"}}' AS bundle, 'Session ' || session_id || ': events 1-' || count(*) AS text FROM ev_conv GROUP BY session_id""")
def handoff_bundle(spark, sf):
    g = A.ev_conv(spark, sf).groupBy("session_id").agg(F.count("*").alias("n"))
    return g.select("session_id", F.to_json(F.struct("session_id", F.array(F.lit(1).cast("long"), "n").alias("range"), F.lit("continue").alias("task"))).alias("bundle"), F.concat(F.lit("Session "), "session_id", F.lit(": events 1-"), "n").alias("text"))


@query("H74_role_conversion", "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' WHEN 'system' THEN 'developer' ELSE role END AS role, text FROM conversations")
def role_conversion(spark, sf):
    roles = F.create_map(F.lit("assistant"), F.lit("model"), F.lit("system"), F.lit("developer"))
    return A.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(roles[F.col("role")], "role").alias("role"), "text")


@query("H75_rest_dialect", """SELECT conv_id, '[' || string_agg('{"role":"' || role || '","parts":[{"text":"t' || turn || '"}]}', ',' ORDER BY turn) || ']' AS contents FROM conversations GROUP BY conv_id""")
def rest_dialect(spark, sf):
    m = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = A.table(spark, sf, "conversations").groupBy("conv_id").agg(m.alias("m"))
    return c.select("conv_id", F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.concat(F.lit("t"), x["turn"]).alias("text"))).alias("parts")))).alias("contents"))


@query("H76_hook_dialect", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN upper(event_type) ELSE 'unknown' END AS tool, user_id AS session FROM events")
def hook_dialect(spark, sf):
    """Aliased and nested fields, the first that is there."""
    line = F.expr("CASE event_id % 3 WHEN 0 THEN concat('{\"tool_name\":\"', event_type, '\",\"session_id\":', user_id, '}') WHEN 1 THEN concat('{\"toolCall\":{\"name\":\"', upper(event_type), '\"},\"sessionId\":', user_id, '}') ELSE concat('{\"session\":', user_id, '}') END")
    get = lambda *paths: F.coalesce(*[F.get_json_object("j", p) for p in paths])
    return A.table(spark, sf, "events").select("event_id", line.alias("j")).select("event_id", F.coalesce(get("$.tool_name", "$.toolCall.name"), F.lit("unknown")).alias("tool"), get("$.session_id", "$.sessionId", "$.session").cast("long").alias("session"))


@query("A7_frame_decode")
def frame_decode(spark, sf):
    """Sessions as binary logs, some cut short, and their frames."""
    logs = A.ev_conv(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("event_index", "payload"))).alias("e")).select("session_id", F.transform("e", lambda x: x["payload"]).alias("payloads"))

    def decode(batches):
        for b in batches:
            rows = []
            for s, p in zip(b["session_id"], b["payloads"]):
                data = P.framed([x.encode() for x in p])
                data = data[:-5] if int(s) % 10 == 0 else data
                rows += [(s, k, len(r) if r is not None else None, e) for k, r, e in P.frames(data)]
            yield pd.DataFrame(rows, columns=["session_id", "frame", "bytes", "error"])

    return logs.mapInPandas(decode, "session_id string, frame long, bytes long, error string")
