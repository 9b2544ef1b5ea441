"""Queries of projections: prompts, repair, refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import evidence as V
from ..operators import projection as P
from ..sources import adapters as A

CONFIG = P.Config(schema_id="memory-v1", schema_json='{"type":"object"}', model_id="stand-in-1", budget=500, max_log=4000, attempts=2)
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def directives(spark, sf) -> DataFrame:
    """For every fifth conversation one to three words of its first turn are corrected; every tenth has a second directive."""
    c = A.table(spark, sf, "conversations").filter("conv_id % 5 = 0")
    held = c.groupBy("conv_id").agg(F.max(F.expr("CASE WHEN turn = 0 THEN text END")).alias("t"), F.max("turn").alias("correction_index"))
    words = held.selectExpr("*", "slice(array_distinct(regexp_extract_all(coalesce(t, ''), '[A-Za-z]{5,}', 0)), 1, CAST(1 + conv_id % 3 AS INT)) AS facts")
    one = words.selectExpr(
        "CAST(conv_id AS STRING) AS session_id", "concat('corr-', conv_id) AS correction_id", "correction_index", "CASE conv_id % 3 WHEN 0 THEN 'prior_events' WHEN 1 THEN 'checkpoint_range' ELSE 'global' END AS scope", "0 AS directive_index",
        "facts", "IF(conv_id % 10 = 0, array('blue'), CAST(array() AS ARRAY<STRING>)) AS replacements", "IF(conv_id % 15 = 0, 'use blue', '') AS correction_text",
    )
    two = words.filter("conv_id % 10 = 0").selectExpr("CAST(conv_id AS STRING) AS session_id", "'' AS correction_id", "correction_index", "'global' AS scope", "1 AS directive_index", "array('', 'Zebra') AS facts", "CAST(array() AS ARRAY<STRING>) AS replacements", "'' AS correction_text")
    return one.unionByName(two)


_DIRS = """w AS (SELECT conv_id, max(turn) AS correction_index, regexp_extract_all(coalesce(max(CASE WHEN turn = 0 THEN text END), ''), '[A-Za-z]{5,}') AS words FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id),
dirs AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, 'corr-' || conv_id AS correction_id, correction_index, CASE conv_id % 3 WHEN 0 THEN 'prior_events' WHEN 1 THEN 'checkpoint_range' ELSE 'global' END AS scope, 0 AS directive_index,
    list_filter(words, lambda x, i: list_position(words, x) = i)[1:1 + conv_id % 3] AS facts, CASE WHEN conv_id % 10 = 0 THEN ['blue'] ELSE [] END AS replacements, CASE WHEN conv_id % 15 = 0 THEN 'use blue' ELSE '' END AS correction_text FROM w
  UNION ALL SELECT CAST(conv_id AS VARCHAR), '', correction_index, 'global', 1, ['', 'Zebra'], [], '' FROM w WHERE conv_id % 10 = 0)"""


def _text(s: str) -> str:
    """As an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def _facts(label: str, column: str) -> str:
    return f"'  {label}:' || chr(10) || CASE WHEN len(list_filter({column}, lambda f: f <> '')) > 0 THEN array_to_string(list_transform(list_filter({column}, lambda f: f <> ''), lambda f: '    - ' || f || chr(10)), '') ELSE '    - none declared' || chr(10) END"


#: The directives' block, the corrected facts and the words a stand-in repeats, and each session's active log.
_LOGS = f"""blocks AS (SELECT session_id, {_text(P.CORRECTIONS)} || string_agg('- correction_id: ' || CASE WHEN correction_id = '' THEN 'unknown' ELSE correction_id END || chr(10) || '  correction_event: [' || (correction_index + 1) || ']' || chr(10) || '  scope: ' || scope || chr(10)
    || CASE WHEN correction_text <> '' THEN '  correction_text: ' || correction_text || chr(10) ELSE '' END || {_facts('invalidated_facts', 'facts')} || {_facts('replacement_facts', 'replacements')}, '' ORDER BY directive_index) || {_text(P.RULES)} AS block,
  flatten(list(list_filter(facts, lambda f: f <> '') ORDER BY directive_index)) AS facts, flatten(list(list_concat(list_filter(facts, lambda f: f <> ''), replacements) ORDER BY directive_index)) AS said FROM dirs GROUP BY session_id),
f AS (SELECT session_id, CASE WHEN correction_id = '' THEN 'unknown' ELSE correction_id END AS id, correction_index, scope, directive_index, unnest(facts) AS fact, generate_subscripts(facts, 1) AS k FROM dirs),
hit AS (SELECT e.session_id, e.event_index, count(*) AS n, list(id ORDER BY directive_index, k) AS ids FROM ev_conv e JOIN f USING (session_id)
  WHERE e.type <> 'correction' AND fact <> '' AND (scope <> 'prior_events' OR e.event_index < correction_index) AND contains(translate(e.payload, '{_UP}', '{_LOW}'), translate(fact, '{_UP}', '{_LOW}')) GROUP BY ALL),
line AS (SELECT e.session_id, e.event_index, CASE WHEN n IS NULL THEN type ELSE 'internal' END AS type, CASE WHEN n IS NULL THEN payload ELSE {_text(V.MARKER[0])} || n || {_text(V.MARKER[1])} || array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') || {_text(V.MARKER[2])} END AS payload
  FROM ev_conv e LEFT JOIN hit USING (session_id, event_index)),
logs AS (SELECT session_id, string_agg('[' || (event_index + 1) || '] ' || type || ': ' || payload, chr(10) ORDER BY event_index) AS events, list(left(split_part(payload, chr(10), 1), 40) || ' [' || (event_index + 1) || ']' ORDER BY event_index)[1:3] AS items FROM line GROUP BY session_id),
asked AS (SELECT l.session_id, events, items, coalesce(block, '') AS block, coalesce(facts, []) AS facts, coalesce(said, []) AS said, CASE WHEN strlen(events) > {CONFIG.max_log} THEN 'log too large: ' || strlen(events) || ' > {CONFIG.max_log} bytes' END AS error FROM logs l LEFT JOIN blocks USING (session_id))"""


@query(
    "B32_projection_prompt",
    f"WITH {A.EV_CONV}, {_DIRS}, {_LOGS} SELECT session_id, CASE WHEN error IS NULL THEN md5({_text(CONFIG.prefix)} || block || '[EVENT LOG]' || chr(10) || events || chr(10) || chr(10) || {_text(P.EXPECTED + P.UNFENCED)}) END AS digest, strlen(block)::INTEGER AS block_bytes, error FROM asked",
)
def projection_prompt(spark, sf):
    """Static words, schema and budget, then corrections, active log and the shape of the answer; logs over the cap are refused."""
    log, own = A.ev_conv(spark, sf), directives(spark, sf)
    rows = P.prompts(V.active_view(log, own, ["session_id"]), own, ["session_id"], CONFIG)
    return rows.select("session_id", F.md5("prompt").alias("digest"), F.octet_length("block").alias("block_bytes"), "error")


@query(
    "B33_repair_prompt",
    f"WITH {A.EV_CONV}, {_DIRS}, {_LOGS} SELECT session_id, md5({_text(P.REPAIR)} || block || '[FORBIDDEN SUBSTRINGS]' || chr(10) || '- ' || array_to_string(facts, chr(10) || '- ') || chr(10) || chr(10) || '[PREVIOUS PROJECTION]' || chr(10) || events || chr(10) || chr(10) || {_text(P.EXPECTED + P.REPAIRED)}) AS digest FROM asked WHERE len(facts) > 0",
)
def repair_prompt(spark, sf):
    """What is asked if all corrected facts still stand, with the log itself as the previous answer."""
    log, own = A.ev_conv(spark, sf), directives(spark, sf)
    view = V.active_view(log, own, ["session_id"])
    from ..operators import eventlog as L

    rows = P.correction_blocks(own, ["session_id"]).filter(F.size("facts") > 0).join(L.render(view, F.concat("type", F.lit(": "), "payload"), ["session_id"]), "session_id")
    return rows.select("session_id", F.md5(P.repair_prompt(F.col("block"), F.col("facts"), F.col("rendered"))).alias("digest"))


@query("B32_decider_prompt", "SELECT conv_id, 'Given the following Projected Memory M, provide a final verdict for Case ID case-' || conv_id || '.' || chr(10) || 'Decision options: approve|deny.' || chr(10) || 'Base the decision strictly on Facts and Compliance.' || chr(10) || chr(10) || '[PROJECTED MEMORY]' || chr(10) || text || chr(10) AS prompt FROM conversations WHERE turn = 0")
def decider_prompt(spark, sf):
    c = A.table(spark, sf, "conversations").filter("turn = 0")
    return c.select("conv_id", P.decider_prompt(F.col("text"), F.concat(F.lit("case-"), "conv_id"), "approve|deny").alias("prompt"))


def faulty(rows: DataFrame) -> DataFrame:
    """The stand-in, which answers some first questions badly."""
    number = F.col("session_id").cast("long") % 11
    spoilt = (
        F.when(number == 3, "no").when(number == 4, F.replace("raw", F.lit('"Compliance":[]'), F.lit('"Compliance":["plain"]'))).when(number == 5, '{"Facts":[],"Reasoning":"x [1]","Compliance":[]}')
        .when(number == 7, '{"Facts":[],"Compliance":[]}').otherwise(F.col("raw"))
    )
    return P.stand_in(rows).withColumn("raw", F.when(F.col("attempt") == 0, spoilt).otherwise(F.col("raw")))


_LIST = "replace(to_json({})::VARCHAR, '\\/', '/')"


@query(
    "K1_projection_repair",
    f"""WITH RECURSIVE {A.EV_CONV}, {_DIRS}, {_LOGS},
first AS (SELECT session_id, facts, CAST(session_id AS BIGINT) % 11 AS spoilt, '{{"Facts":' || {_LIST.format("items")} || ',"Reasoning":' || {_LIST.format("list_transform(said, lambda x: 'applied ' || x || ' [1]')")} || ',"Compliance":[]}}' AS canonical FROM asked WHERE error IS NULL),
seen AS (SELECT *, CASE spoilt WHEN 3 THEN 'not a JSON object' WHEN 4 THEN 'item in Compliance is not cited' WHEN 5 THEN 'field Reasoning must be an array' WHEN 7 THEN 'field Reasoning is missing' ELSE CASE WHEN strlen(canonical) > {CONFIG.budget} THEN 'over budget: ' || strlen(canonical) || ' > {CONFIG.budget} bytes' END END AS error FROM first),
r AS (SELECT session_id, facts, 0 AS attempt, canonical, error, CASE WHEN error IS NULL THEN list_filter(facts, lambda x: contains(translate(canonical, '{_UP}', '{_LOW}'), translate(x, '{_UP}', '{_LOW}'))) ELSE [] END AS hits FROM seen
  UNION ALL SELECT session_id, facts, attempt, canonical, CASE WHEN strlen(canonical) > {CONFIG.budget} THEN 'over budget: ' || strlen(canonical) || ' > {CONFIG.budget} bytes' END, CASE WHEN strlen(canonical) > {CONFIG.budget} THEN [] ELSE list_filter(facts, lambda x: contains(translate(canonical, '{_UP}', '{_LOW}'), translate(x, '{_UP}', '{_LOW}'))) END
  FROM (SELECT session_id, facts, attempt + 1 AS attempt, replace(canonical, hits[1], 'unknown') AS canonical FROM r WHERE error IS NULL AND len(hits) > 0 AND attempt < {CONFIG.attempts})),
ends AS (SELECT session_id, attempt, canonical, error, hits, CASE WHEN error IS NOT NULL THEN 'error' WHEN len(hits) > 0 THEN 'refused' WHEN attempt > 0 THEN 'repaired' ELSE 'accepted' END AS status FROM r QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY attempt DESC) = 1)
SELECT session_id, status, attempt AS attempts, CASE WHEN status IN ('accepted', 'repaired') THEN md5(canonical) END AS digest, error, array_to_string(hits, ',') AS hits FROM ends
UNION ALL SELECT session_id, 'error', 0, NULL, error, '' FROM asked WHERE error IS NOT NULL""",
)
def projection_repair(spark, sf):
    """Accepted, repaired, refused and failed projections; only those with a fact that still stands are asked again."""
    found = P.project(A.ev_conv(spark, sf), directives(spark, sf), faulty, ["session_id"], CONFIG)
    return found.select("session_id", "status", "attempts", F.md5("memory").alias("digest"), "error", F.array_join("hits", ",").alias("hits"))
