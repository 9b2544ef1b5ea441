"""Queries of the hook loop, of the correction barrier, and of incremental append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.audit import blocked
from ..operators.shared import fresh
from ..sources import adapters as A
from ..streaming import append, hooks
from . import functions as R

#: Conversations as hook events: what each turn is, what it says, and what a tool call holds.
_HOOK = "CASE turn WHEN 0 THEN 'SessionStart' WHEN 1 THEN 'UserPromptSubmit' WHEN 2 THEN 'PreToolUse' WHEN 3 THEN 'PostToolUse' WHEN 4 THEN 'UserPromptSubmit' WHEN 5 THEN CASE WHEN conv_id % 2 = 0 THEN 'PreToolUse' ELSE 'PermissionRequest' END WHEN 6 THEN 'PreCompact' ELSE 'Stop' END"
_HELD = "CASE conv_id % 3 WHEN 0 THEN 'git push foo bar 1 Alpha ONE now' WHEN 1 THEN 'git commit -m ''wrong: OLD_name'' ' || turn ELSE 'ls ' || text END"
_NAME = "CASE WHEN conv_id % 4 = 3 THEN 'Edit' ELSE 'Bash' END"


def events(spark, sf) -> DataFrame:
    t = F.col("t")
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(w)) for w in words])
    corrects = has(R.HINTS) & (R.says(t) | has(["correction", "correcting"]))
    c = A.table(spark, sf, "conversations").selectExpr("CAST(conv_id AS STRING) AS session_id", "turn AS seq", f"{_HOOK} AS hook", f"{R._SAY} AS t", f"{_HELD} AS command", f"{_NAME} AS tool")
    boundary = F.col("tool").isin(R.EDITORS) | F.lower("tool").isin(R.EDITORS_FOLDED) | (F.lower("tool").isin(R.SHELLS) & F.col("command").rlike(R.RISKY))
    return c.select("session_id", "seq", "hook", corrects.alias("corrects"), F.substring(F.sha2("t", 256), 1, 16).alias("correction_id"), R._facts(t, 1).alias("invalidated"), R._facts(t, 2).alias("replacements"), F.col("command").alias("text"), boundary.alias("boundary"))


_EVENTS = f"""said AS (SELECT conv_id, turn, text, {_HOOK} AS hook, {R._SAY} AS t, {_HELD} AS command, {_NAME} AS tool FROM conversations),
f AS (SELECT *, {R._facts_sql(1)} AS old, {R._facts_sql(2)} AS new FROM said),
h AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, hook, ({' OR '.join(f"contains(lower(t), '{x}')" for x in R.HINTS)}) AND ({R._FORMS_SQL} OR contains(lower(t), 'correction') OR contains(lower(t), 'correcting')) AS corrects, left(sha256(t), 16) AS id,
  {R._distinct_sql('old')} AS old, {R._distinct_sql('new')} AS new, command AS text, tool IN ({R._names(R.EDITORS)}) OR lower(tool) IN ({R._names(R.EDITORS_FOLDED)}) OR (lower(tool) IN ({R._names(R.SHELLS)}) AND regexp_matches(command, '{R.RISKY}')) AS boundary FROM f),
reg AS (SELECT session_id, id, min(seq) AS seq, any_value(old) AS old, any_value(new) AS new FROM h WHERE hook = 'UserPromptSubmit' AND corrects GROUP BY session_id, id),
lines AS (SELECT session_id, id, seq, old, array_to_string(list_filter([CASE WHEN len(old) > 0 THEN 'Invalidated: ' || array_to_string(list_transform(old, lambda x: '`' || x || '`'), '; ') END, CASE WHEN len(new) > 0 THEN 'Use instead: ' || array_to_string(list_transform(new, lambda x: '`' || x || '`'), '; ') END], lambda x: x IS NOT NULL), chr(10)) AS line FROM reg WHERE len(old) > 0),
n AS (SELECT h.*, (SELECT count(*) FROM lines l WHERE l.session_id = h.session_id AND l.seq <= h.seq) AS active, (SELECT array_to_string(list(line ORDER BY seq)[-3:], chr(10)) FROM lines l WHERE l.session_id = h.session_id AND l.seq <= h.seq) AS context,
  (SELECT list(x ORDER BY l.seq, k) FROM (SELECT session_id, seq, unnest(old) AS x, generate_subscripts(old, 1) AS k FROM lines) l WHERE l.session_id = h.session_id AND l.seq <= h.seq AND contains(lower(h.text), lower(x))) AS hit,
  EXISTS (SELECT 1 FROM reg WHERE reg.session_id = h.session_id AND reg.id = h.id AND reg.seq < h.seq) AS again, (SELECT count(*) FROM h o WHERE o.session_id = h.session_id AND o.seq <= h.seq AND o.hook = 'PreCompact') AS compactions FROM h),
a AS (SELECT *, CASE WHEN hook = 'UserPromptSubmit' AND corrects THEN CASE WHEN again THEN 'refreshed' ELSE 'registered' END WHEN hook IN ('SessionStart', 'UserPromptSubmit') THEN 'context' WHEN hook IN ('PreToolUse', 'PermissionRequest') THEN CASE WHEN hit IS NOT NULL THEN 'deny' WHEN active > 0 AND boundary THEN 'allow' ELSE 'none' END
  WHEN hook = 'PostToolUse' THEN CASE WHEN active > 0 THEN 'context' ELSE 'none' END WHEN hook = 'PreCompact' THEN 'checkpoint' WHEN active > 0 THEN 'context' ELSE 'current' END AS action FROM n)"""


@query(
    "I7_hook_answers",
    f"""WITH {_EVENTS} SELECT session_id, seq, action, CASE WHEN action = 'deny' THEN array_to_string(list_filter(hit, lambda x, i: list_position(list_transform(hit, lambda y: lower(y)), lower(x)) = i), ', ') ELSE '' END AS hits,
  CASE WHEN action IN ('context', 'registered', 'refreshed', 'allow') THEN coalesce(context, '') ELSE '' END AS context, active::INTEGER AS active, compactions::INTEGER AS compactions FROM a""",
)
def hook_answers(spark, sf):
    """Six hooks over conversations: corrections are registered, tool calls that hold what they invalidate denied."""
    return hooks.answered(events(spark, sf))


@query(
    "I3_barrier_decision",
    f"""WITH {A.CKPT}, {A.CHECKPOINT_CORRECTIONS}, m AS (SELECT DISTINCT target, severity, interrupts, unnest(list_append(invalidated, target)) AS hash FROM cor),
b AS (SELECT hash, count(*) FILTER (severity = 'blocking') AS blocking, coalesce(bool_or(interrupts) FILTER (severity = 'blocking'), false) AS interrupt FROM m GROUP BY hash)
SELECT c.hash AS checkpoint_hash, coalesce(blocking > 0 AND interrupt, false) AS must_interrupt, coalesce(blocking > 0, false) AS must_reproject, CASE WHEN blocking > 0 THEN 'blocking correction requires fresh projection' ELSE 'no blocking correction for active checkpoint' END AS reason FROM ckpt c LEFT JOIN b USING (hash)""",
)
def barrier_decision(spark, sf):
    """Before each decision: whether its checkpoint has blocking corrections, and whether one of them interrupts."""
    decisions = A.ckpt(spark, sf).select(F.col("hash").alias("checkpoint_hash"))
    return hooks.barred(decisions, blocked(A.checkpoint_corrections(spark, sf)))


@query("I1_append_once", f"WITH {A.EV_CONV} SELECT session_id, event_index, type, md5(payload) AS digest FROM ev_conv")
def append_once(spark, sf):
    """The conversations' log, delivered in three parts of which two overlap, as a stream that appends each event once."""
    log = A.ev_conv(spark, sf).select("session_id", "event_index", "type", "payload")
    source, path, checkpoint = (fresh(spark, t) for t in ("append-source", "append-log", "append-state"))
    for part in (log.filter("event_index < 3"), log.filter("event_index BETWEEN 2 AND 5"), log.filter("event_index > 4")):
        part.write.mode("append").parquet(source)
    query_ = append.append_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(source), path, checkpoint)
    query_.awaitTermination()
    return append.read_log(spark, path).select("session_id", "event_index", "type", F.md5("payload").alias("digest"))
