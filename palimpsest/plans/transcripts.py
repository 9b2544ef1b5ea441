"""Queries of session transcripts: conversations written as lines of two dialects, and read back as events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import adapters as A
from ..sources import transcripts as T


def _json(value: str) -> str:
    """A text as JSON."""
    return f"substring(to_json(array({value})), 2, length(to_json(array({value}))) - 2)"


_TEXT = _json("coalesce(text, '')")
_OUT = _json("concat('out ', coalesce(text, ''))")
_META = _json("concat('<system-reminder>', text)")
_USER = f"""CASE (conv_id + turn) % 4 WHEN 0 THEN {_TEXT} WHEN 1 THEN concat('[{{"type":"text","text":', {_TEXT}, '}},{{"type":"tool_result","tool_use_id":"t1","content":', {_OUT}, '}}]')
  WHEN 2 THEN '[{{"type":"tool_result","content":[{{"type":"text","text":"a"}},{{"type":"image"}},{{"text":"b"}}]}},"stray",{{"type":"image"}},{{"type":"text","text":""}}]' ELSE {_META} END"""
_ASSISTANT = f"""CASE (conv_id + turn) % 4 WHEN 0 THEN {_TEXT} WHEN 1 THEN concat('[{{"type":"thinking","thinking":"hm"}},{{"type":"thinking","thinking":""}},{{"type":"text","text":', {_TEXT}, '}},{{"type":"tool_use","name":"Bash","input":{{"zeta":1,"command":"ls ', turn, '"}}}}]')
  WHEN 2 THEN '[{{"type":"tool_use","name":"Grep","input":{{"where":"dir","limit":5}}}},{{"type":"tool_use","name":"Read","input":{{"path":7,"url":"u"}}}}]' ELSE concat('[{{"type":"tool_result","tool_use_id":"id-', turn, '","content":', {_TEXT}, '}},{{"type":"tool_use","name":"Nop","input":{{}}}}]') END"""


@query(
    "A21_typed_transcript",
    """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, coalesce(text, '') AS text, (conv_id + turn) % 4 AS k FROM conversations),
u AS (SELECT session_id, turn, 'user' AS role, 'user' AS kind, CASE k WHEN 2 THEN 'a  b' ELSE text END AS text, '' AS tool, '' AS args, 0 AS place FROM c WHERE role = 'user' AND k < 3
  UNION ALL SELECT session_id, turn, 'user', 'user', left('out ' || text, 2000), '', '', 1 FROM c WHERE role = 'user' AND k = 1),
kept AS (SELECT * FROM u WHERE NOT (text = '' OR contains(text, '<local-command-caveat>') OR starts_with(text, '<system-reminder>'))),
a AS (SELECT session_id, turn, 'assistant' AS role, 'assistant_text' AS kind, text, '' AS tool, '' AS args, 2 AS place FROM c WHERE role = 'assistant' AND (k = 0 AND trim(text) <> '' OR k = 1 AND text <> '')
  UNION ALL SELECT session_id, turn, 'assistant', 'assistant_thinking', 'hm', '', '', 0 FROM c WHERE role = 'assistant' AND k = 1
  UNION ALL SELECT session_id, turn, 'assistant', 'tool_call', '[tool_use Bash(ls ' || turn || ')]', 'Bash', 'ls ' || turn, 3 FROM c WHERE role = 'assistant' AND k = 1
  UNION ALL SELECT session_id, turn, 'assistant', 'tool_call', '[tool_use Grep(where=dir)]', 'Grep', 'where=dir', 0 FROM c WHERE role = 'assistant' AND k = 2
  UNION ALL SELECT session_id, turn, 'assistant', 'tool_call', '[tool_use Read(u)]', 'Read', 'u', 1 FROM c WHERE role = 'assistant' AND k = 2
  UNION ALL SELECT session_id, turn, 'assistant', 'tool_result', left(text, 2000), '', 'id-' || turn, 0 FROM c WHERE role = 'assistant' AND k = 3
  UNION ALL SELECT session_id, turn, 'assistant', 'tool_call', '[tool_use Nop()]', 'Nop', '', 1 FROM c WHERE role = 'assistant' AND k = 3),
s AS (SELECT session_id, turn, 'system' AS role, 'system' AS kind, text, '' AS tool, '' AS args, 0 AS place FROM c WHERE role NOT IN ('user', 'assistant') AND trim(text) <> ''),
every AS (SELECT * FROM kept UNION ALL SELECT * FROM a UNION ALL SELECT * FROM s)
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY turn, place) - 1)::INTEGER AS idx, kind, role, md5(text) AS digest, turn::VARCHAR AS timestamp, tool AS tool_name, args AS tool_args FROM every""",
)
def typed_transcript(spark, sf):
    """Lines whose content is a text or mixed blocks, between lines that are broken, empty or of other types."""
    c = A.table(spark, sf, "conversations").withColumn("session_id", F.expr("CAST(conv_id AS STRING)"))
    line = f"""CASE role WHEN 'user' THEN concat('{{"type":"user","timestamp":"', turn, '","uuid":"u","message":{{"role":"user","content":', {_USER}, '}}}}') WHEN 'assistant' THEN concat('{{"type":"assistant","timestamp":"', turn, '","message":{{"content":', {_ASSISTANT}, '}}}}')
      ELSE concat('{{"type":"system","timestamp":"', turn, '","content":', {_TEXT}, '}}') END"""
    good = c.selectExpr("session_id", "2 * turn AS line_no", f"{line} AS line")
    other = c.selectExpr("session_id", "2 * turn + 1 AS line_no", """CASE turn % 4 WHEN 0 THEN '{"type":"user"' WHEN 1 THEN '' WHEN 2 THEN '{"type":"permission-mode","message":{"content":"no"}}' ELSE '[1, 2]' END AS line""")
    e = T.typed_blocks(good.unionByName(other))
    return e.select("session_id", "idx", "kind", "role", F.md5("text").alias("digest"), "timestamp", "tool_name", "tool_args")


_ITEM = f"""CASE (conv_id + turn) % 5 WHEN 0 THEN concat('{{"type":"message","role":"', role, '","content":', {_TEXT}, '}}') WHEN 1 THEN concat('{{"type":"message","role":"', role, '","content":[{{"type":"input_text","text":', {_TEXT}, '}},"and",{{"x":1}}]}}')
  WHEN 2 THEN concat('{{"type":"function_call","name":"look","call_id":"c', turn div 2, '","arguments":', {_TEXT}, '}}') WHEN 3 THEN concat('{{"type":"function_call_output","call_id":"c', turn div 2, '","output":', {_TEXT}, '}}') ELSE '{{"type":"reasoning","content":"x"}}' END"""
_ITEMS = """c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, coalesce(text, '') AS text, (conv_id + turn) % 5 AS k FROM conversations),
e AS (SELECT session_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant_text' END AS kind, role, CASE k WHEN 0 THEN text ELSE text || ' and ' END AS text, '' AS tool, '' AS args, '' AS call_id FROM c WHERE k = 0 AND trim(text) <> '' OR k = 1
  UNION ALL SELECT session_id, turn, 'tool_call', 'assistant', '[tool_call look(' || left(text, 200) || ')]', 'look', left(text, 200), 'c' || turn // 2 FROM c WHERE k = 2
  UNION ALL SELECT session_id, turn, 'tool_result', 'tool', left(text, 2000), '', '', 'c' || turn // 2 FROM c WHERE k = 3),
n AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1)::INTEGER AS idx FROM e)"""


def _items(spark, sf):
    c = A.table(spark, sf, "conversations")
    return T.response_items(c.selectExpr("CAST(conv_id AS STRING) AS session_id", "turn AS line_no", f"""concat('{{"timestamp":"', turn, '","type":"response_item","payload":', {_ITEM}, '}}') AS line"""))


@query("A22_response_items", f"WITH {_ITEMS} SELECT session_id, idx, kind, role, md5(text) AS digest, turn::VARCHAR AS timestamp, tool AS tool_name, md5(args) AS args, call_id FROM n")
def response_items(spark, sf):
    """Messages, calls and outputs of the second dialect."""
    return _items(spark, sf).select("session_id", "idx", "kind", "role", F.md5("text").alias("digest"), "timestamp", "tool_name", F.md5("tool_args").alias("args"), "call_id")


@query("A22_paired_calls", f"WITH {_ITEMS}, a AS (SELECT session_id, call_id, min(idx) AS call_idx FROM n WHERE kind = 'tool_call' GROUP BY ALL), b AS (SELECT session_id, call_id, min(idx) AS result_idx FROM n WHERE kind = 'tool_result' GROUP BY ALL) SELECT session_id, call_id, call_idx, result_idx FROM a FULL JOIN b USING (session_id, call_id)")
def paired_calls(spark, sf):
    """Calls with their results, and orphans of both."""
    return T.paired_calls(_items(spark, sf))


_MESSAGE = f"""CASE (conv_id + turn) % 4 WHEN 0 THEN concat('{{"role":"', role, '","content":', {_TEXT}, '}}') WHEN 1 THEN concat('{{"role":"', role, '","content":[{{"text":', {_TEXT}, '}},"and"],"tool_calls":[{{"function":{{"name":"f","arguments":', {_TEXT}, '}}}},{{"name":"g","arguments":{{"k":1}}}},7]}}')
  WHEN 2 THEN concat('{{"role":"tool","name":"f","content":', {_TEXT}, '}}') ELSE '"stray"' END"""


@query(
    "A23_rubric_cases",
    """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, (conv_id + turn) % 4 AS k FROM conversations),
e AS (SELECT conv_id, turn, 0 AS place, CASE role WHEN 'user' THEN 'user' WHEN 'system' THEN 'system' ELSE 'assistant_text' END AS kind, CASE k WHEN 0 THEN text ELSE text || ' and' END AS text FROM c WHERE conv_id % 10 <> 3 AND (k = 0 AND trim(text) <> '' OR k = 1)
  UNION ALL SELECT conv_id, turn, 1, 'tool_call', '[tool_use f(' || left(text, 120) || ')]' FROM c WHERE conv_id % 10 <> 3 AND k = 1 AND role = 'assistant' UNION ALL SELECT conv_id, turn, 2, 'tool_call', '[tool_use g({"k":1})]' FROM c WHERE conv_id % 10 <> 3 AND k = 1 AND role = 'assistant'
  UNION ALL SELECT conv_id, turn, 0, 'tool_result', left(text, 2000) FROM c WHERE conv_id % 10 <> 3 AND k = 2),
n AS (SELECT i.conv_id, coalesce(list(kind || ':' || text ORDER BY turn, place) FILTER (kind IS NOT NULL), []) AS every FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN e USING (conv_id) GROUP BY i.conv_id),
f AS (SELECT conv_id, CASE WHEN len(every) > 0 THEN every ELSE ['system:rules ' || conv_id, 'user:asks'] END AS every FROM n)
SELECT conv_id || ':' || r AS case_id, conv_id || ':' || CASE r WHEN 'hack' THEN 'normal' ELSE 'hack' END AS paired_case_id, r AS pair_role, len(every)::INTEGER AS n_events, greatest(0, len(every) - 1)::INTEGER AS probe_t, md5(array_to_string(every[1:greatest(0, len(every) - 1)], chr(10))) AS digest FROM f, (VALUES ('normal'), ('hack')) v(r)""",
)
def rubric_cases(spark, sf):
    """Rows with messages as JSON, some of which is broken, as pairs of cases that differ in their rubric."""
    c = A.table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_MESSAGE} AS m")
    rows = c.groupBy("conv_id").agg(F.expr("listagg(m, ',') WITHIN GROUP (ORDER BY turn)").alias("ms"))
    rows = rows.selectExpr("conv_id AS id", "IF(conv_id % 10 = 3, '{\"no\":', concat('[', ms, ']')) AS messages_json", "concat('rules ', conv_id) AS system", "'asks' AS user")
    said = F.array_join(F.transform("events", lambda p: F.concat(p["kind"], F.lit(":"), p["text"])), "\n")
    return T.rubric_cases(rows).select("case_id", "paired_case_id", "pair_role", "n_events", "probe_t", F.md5(said).alias("digest"))
