"""Queries over evaluation result rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import reports as R
from ..sources import adapters as A
from ..sources import corpus

W = f"WITH {A.RESULTS}"
CONDITIONS = "(VALUES " + ", ".join(f"('{c}')" for c in (*A.CONDITIONS, "hybrid")) + ") AS dim(condition)"


def _summary(v: str, p: str) -> str:
    return f"count({v}) AS {p}_count, avg({v}) AS {p}_mean, CASE WHEN count({v}) > 0 THEN coalesce(stddev_samp({v}), 0) END AS {p}_stdev, min({v}) AS {p}_min, max({v}) AS {p}_max"


def _dim(spark):
    return spark.createDataFrame([(c,) for c in (*A.CONDITIONS, "hybrid")], "condition string")


@query("A26_result_source", f"{W} SELECT count(*) AS n, bool_or(doc_id % 50 = 0) AS has_mock, bool_or(doc_id % 50 <> 0) AS has_real, NOT (bool_or(doc_id % 50 = 0) AND bool_or(doc_id % 50 <> 0)) AS unmixed, count(DISTINCT CASE WHEN doc_id % 40 = 0 THEN 2 ELSE 1 END) AS versions FROM results")
def result_source(spark, sf):
    r = A.results(spark, sf).withColumn("mock", F.expr("doc_id % 50 = 0"))
    return r.agg(F.count("*").alias("n"), F.bool_or("mock").alias("has_mock"), F.bool_or(~F.col("mock")).alias("has_real"), (~(F.bool_or("mock") & F.bool_or(~F.col("mock")))).alias("unmixed"), F.count_distinct(F.expr("IF(doc_id % 40 = 0, 2, 1)")).alias("versions"))


_GATED = "(condition IN ('dpm_phase3_checkpoint', 'rolling_summary_plus_dpm_gate'))"
_SCORE_STATUS = "CASE WHEN status = 'errored' THEN 'errored' WHEN status = 'skipped' THEN 'skipped_context_too_large' WHEN decision_score IS NULL AND doc_id % 23 > 0 THEN 'needs_judge' ELSE 'scored' END AS score_status"
#: A result row with the evidence that gated rows must have and others must not; most have what they need.
_ROW = [
    "doc_id", "condition", "budget_chars", "model_calls", f"{_GATED} AS gated", _SCORE_STATUS, "CASE WHEN doc_id % 59 = 7 THEN 1.5 ELSE decision_score END AS decision_score", "CASE WHEN doc_id % 62 = 0 THEN '' ELSE 'why' END AS notes", "CASE WHEN doc_id % 97 = 5 THEN '' ELSE 'run' END AS run_id",
    "CASE WHEN doc_id % 37 = 2 THEN '' ELSE 'p' END AS projection_model", "CASE WHEN doc_id % 67 = 3 THEN '' ELSE 'a' END AS auditor_model", "CASE WHEN doc_id % 71 = 6 THEN '' ELSE 'v1' END AS audit_policy",
    f"CASE WHEN {_GATED} = (doc_id % 41 <> 3) THEN 'pass' ELSE 'not_applicable' END AS audit_verdict", f"CASE WHEN {_GATED} AND doc_id % 73 <> 2 THEN toxic_free END AS may_use", f"CASE WHEN {_GATED} THEN toxic_free AND doc_id % 61 <> 6 WHEN doc_id % 79 = 1 THEN false END AS audit_ok",
    f"CASE WHEN NOT {_GATED} THEN CASE WHEN doc_id % 53 = 1 THEN 'ab' ELSE '' END WHEN doc_id % 43 = 6 THEN 'xyz' WHEN doc_id % 47 = 7 THEN '' ELSE md5(CAST(doc_id AS VARCHAR(20))) END AS manifest_hash", "CASE WHEN doc_id % 83 = 10 THEN '' ELSE md5('b') END AS body_hash",
    f"CASE WHEN {_GATED} AND doc_id % 89 <> 2 THEN md5('c') ELSE '' END AS certificate", "CASE WHEN doc_id % 26 = 3 THEN '' ELSE 'drift' END AS gate_reason", "case_id AS range_start", "case_id + CASE WHEN doc_id % 101 = 4 THEN -1 ELSE 8 END AS range_end", "CASE WHEN doc_id % 103 = 9 THEN 1.25 WHEN doc_id % 2 = 0 THEN 0.5 END AS drift",
]
#: The rules in order: the first that a row breaks is its fault.
_RULES = {
    "run_id": "run_id = ''", "budget": "budget_chars <= 0", "scored_without_score": "score_status = 'scored' AND decision_score IS NULL", "score_range": "score_status = 'scored' AND NOT decision_score BETWEEN 0 AND 1",
    "judge_with_score": "score_status = 'needs_judge' AND decision_score IS NOT NULL", "skipped_condition": "score_status = 'skipped_context_too_large' AND condition <> 'raw_oracle'", "skipped_with_score": "score_status = 'skipped_context_too_large' AND decision_score IS NOT NULL",
    "errored_without_notes": "score_status = 'errored' AND notes = ''", "projection_model": "checked AND projection_model = ''", "auditor_model": "checked AND auditor_model = ''", "audit_policy": "checked AND audit_policy = ''", "audit_verdict": "checked AND audit_verdict = 'not_applicable'",
    "gate_unset": "checked AND may_use IS NULL", "manifest_hash": "checked AND may_use AND manifest_hash = ''", "body_hash": "checked AND may_use AND body_hash = ''", "certificate": "checked AND may_use AND certificate = ''", "audit_uncoupled": "checked AND may_use AND NOT coalesce(audit_ok, false)",
    "not_hex": "checked AND may_use AND NOT ({hex})", "gate_reason": "checked AND NOT may_use AND gate_reason = ''", "foreign_evidence": "NOT gated AND (manifest_hash <> '' OR certificate <> '')", "foreign_audit": "NOT gated AND audit_ok IS NOT NULL", "foreign_verdict": "NOT gated AND audit_verdict <> 'not_applicable'",
    "oracle_calls": "condition = 'raw_oracle' AND score_status = 'scored' AND model_calls <> 1", "range": "range_end < range_start", "drift": "drift IS NOT NULL AND NOT drift BETWEEN 0 AND 1",
}
_ROWS = f"rows AS (SELECT *, gated AND score_status <> 'errored' AS checked FROM (SELECT {', '.join(_ROW)} FROM (SELECT *, coalesce(gate_may_use, doc_id % 3 > 0) AS toxic_free FROM results)))"
_HEX_SQL = " AND ".join(f"regexp_full_match({c}, '[0-9a-fA-F]+')" for c in ("manifest_hash", "body_hash", "certificate"))


@query("B20_row_validity", f"{W}, {_ROWS} SELECT doc_id, CASE " + " ".join(f"WHEN {c.replace('{hex}', _HEX_SQL)} THEN '{n}'" for n, c in _RULES.items()) + " ELSE 'ok' END AS fault FROM rows")
def row_validity(spark, sf):
    """What a row must have, must not have, and by which condition and status; the first thing that is wrong."""
    rows = A.results(spark, sf).withColumn("toxic_free", F.expr("coalesce(gate_may_use, doc_id % 3 > 0)")).selectExpr(*_ROW).withColumn("checked", F.expr("gated AND score_status <> 'errored'"))
    hexed = " AND ".join(f"{c} RLIKE '^[0-9a-fA-F]+$'" for c in ("manifest_hash", "body_hash", "certificate"))
    return rows.select("doc_id", F.coalesce(*[F.when(F.expr(c.replace("{hex}", hexed)), n) for n, c in _RULES.items()], F.lit("ok")).alias("fault"))


@query("B21_chart_admission", f"{W} SELECT doc_id, condition, score_status FROM (SELECT *, {_SCORE_STATUS} FROM results) WHERE test_kind IN ('decision', 'correction_safety') AND score_status <> 'needs_judge'")
def chart_admission(spark, sf):
    """Rows of a quality chart: one of another kind or condition, or without a budget, is an error and not left out; a row that
    waits for a judge is left out and never counts as 0."""
    kinds, rows = ("decision", "correction_safety"), A.results(spark, sf).selectExpr("*", _SCORE_STATUS)
    chosen = rows.filter(F.col("test_kind").isin(*kinds))  # what the caller asks for
    admitted = F.col("test_kind").isin(*kinds) & F.col("condition").isin(*A.CONDITIONS) & (F.col("budget_chars") > 0)
    checked = chosen.withColumn("condition", F.when(admitted, F.col("condition")).otherwise(F.raise_error(F.concat(F.lit("not admitted to the chart: "), "doc_id"))))
    return checked.filter("score_status <> 'needs_judge'").select("doc_id", "condition", "score_status")


@query("B22_category_rule", f"{W} SELECT doc_id, CASE test_kind WHEN 'decision' THEN 'answer' WHEN 'memory_projection' THEN 'memory' ELSE 'memory' END AS expected, CASE WHEN doc_id % 6 = 0 THEN 'answer' ELSE 'memory' END AS scored, CASE test_kind WHEN 'decision' THEN 'answer' ELSE 'memory' END = CASE WHEN doc_id % 6 = 0 THEN 'answer' ELSE 'memory' END AS valid FROM results")
def category_rule(spark, sf):
    rule = F.create_map(F.lit("decision"), F.lit("answer"), F.lit("memory_projection"), F.lit("memory"), F.lit("correction_safety"), F.lit("memory"))
    r = A.results(spark, sf).select("doc_id", rule[F.col("test_kind")].alias("expected"), F.expr("IF(doc_id % 6 = 0, 'answer', 'memory')").alias("scored"))
    return r.withColumn("valid", F.col("expected") == F.col("scored"))


@query("B23_report_guard", f"{W} SELECT count(*) > 0 AS has_rows, count(*) - count(condition) = 0 AS conditions_set, count(*) FILTER (status = 'errored') AS errored, count(DISTINCT (case_id, condition, repeat, budget_chars, test_kind)) = count(*) AS cells_distinct FROM results")
def report_guard(spark, sf):
    cell = F.struct("case_id", "condition", "repeat", "budget_chars", "test_kind")
    return A.results(spark, sf).agg((F.count("*") > 0).alias("has_rows"), (F.count("*") == F.count("condition")).alias("conditions_set"), F.count_if(F.col("status") == "errored").alias("errored"), (F.count_distinct(cell) == F.count("*")).alias("cells_distinct"))


@query("B24_fixture_validity", "WITH c AS (SELECT conv_id, count(*) AS n_events, conv_id % 9 AS probe_t, max(turn) + 1 AS declared, bool_or(length(text) > 400) AS truth FROM conversations GROUP BY conv_id) SELECT conv_id, n_events = declared AS count_ok, probe_t <= n_events AS probe_ok, truth AS has_truth FROM c")
def fixture_validity(spark, sf):
    c = A.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("events"), (F.max("turn") + 1).alias("declared"), F.bool_or(F.length("text") > 400).alias("has_truth"))
    return c.select("conv_id", (F.size("events") == F.col("declared")).alias("count_ok"), (F.col("conv_id") % 9 <= F.size("events")).alias("probe_ok"), "has_truth")


@query("B31_test_kind", "SELECT conv_id, turn, CASE role WHEN 'system' THEN 'correction_safety' WHEN 'assistant' THEN 'memory_projection' ELSE 'decision' END AS test_kind FROM conversations")
def test_kind(spark, sf):
    kinds = F.create_map(F.lit("system"), F.lit("correction_safety"), F.lit("assistant"), F.lit("memory_projection"))
    return A.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(kinds[F.col("role")], F.lit("decision")).alias("test_kind"))


@query("D2_null_summary", f"SELECT o_orderpriority, {_summary('CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END', 'price')} FROM orders GROUP BY o_orderpriority")
def null_summary(spark, sf):
    return A.table(spark, sf, "orders").groupBy("o_orderpriority").agg(*R.summary(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END"), "price"))


@query("D3_matched_cells", f"{W} SELECT doc_id, case_id, repeat, condition FROM results r WHERE (SELECT count(DISTINCT condition) FROM results x WHERE x.case_id = r.case_id AND x.repeat = r.repeat) = (SELECT count(DISTINCT condition) FROM results)")
def matched_cells(spark, sf):
    return R.matched_cells(A.results(spark, sf), ["case_id", "repeat"], "condition").select("doc_id", "case_id", "repeat", "condition")


@query("D4_quality_by_condition", f"{W} SELECT dim.condition, {_summary('decision_score', 'score')}, coalesce(avg(CASE WHEN stale_memory_escape IS NULL THEN NULL ELSE CAST(stale_memory_escape AS INTEGER) END), 0)::DOUBLE AS stale_rate, count(stale_memory_escape) AS stale_n FROM {CONDITIONS} LEFT JOIN results r ON r.condition = dim.condition GROUP BY dim.condition")
def quality_by_condition(spark, sf):
    r = A.results(spark, sf).groupBy("condition").agg(*R.summary("decision_score", "score"), F.avg(F.col("stale_memory_escape").cast("double")).alias("stale_rate"), F.count("stale_memory_escape").alias("stale_n"))
    out = _dim(spark).join(r, "condition", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("score_count", "stale_n")} | {"stale_rate": F.coalesce("stale_rate", F.lit(0.0))})


@query("D5_gate_counters", f"{W} SELECT count(*) FILTER (gate_may_use) AS accepted, count(*) FILTER (NOT gate_may_use) AS refused, count(*) FILTER (audit_pass) AS passed, count(*) FILTER (NOT audit_pass AND NOT gate_may_use) AS emitted FROM results")
def gate_counters(spark, sf):
    return A.results(spark, sf).agg(F.count_if("gate_may_use").alias("accepted"), F.count_if(~F.col("gate_may_use")).alias("refused"), F.count_if("audit_pass").alias("passed"), F.count_if(F.expr("NOT audit_pass AND NOT gate_may_use")).alias("emitted"))


@query("D6_cost_by_condition", f"{W} SELECT condition, avg(CASE WHEN status = 'ok' THEN model_calls END) AS mean_calls, avg(CASE WHEN status = 'ok' AND wall_ms > 0 THEN wall_ms END) AS mean_wall, avg(CASE WHEN status = 'ok' AND input_tokens > 0 THEN input_tokens END) AS mean_tokens, count(*) FILTER (status = 'skipped') AS skipped FROM results GROUP BY condition")
def cost_by_condition(spark, sf):
    ok = lambda c, more="true": F.avg(F.expr(f"CASE WHEN status = 'ok' AND {more} THEN {c} END"))
    return A.results(spark, sf).groupBy("condition").agg(ok("model_calls").alias("mean_calls"), ok("wall_ms", "wall_ms > 0").alias("mean_wall"), ok("input_tokens", "input_tokens > 0").alias("mean_tokens"), F.count_if(F.col("status") == "skipped").alias("skipped"))


@query("D7_cell_variance", f"{W} SELECT case_id, condition, count(decision_score) AS n, stddev_samp(decision_score) AS stdev FROM results GROUP BY case_id, condition HAVING count(decision_score) >= 2")
def cell_variance(spark, sf):
    return A.results(spark, sf).groupBy("case_id", "condition").agg(F.count("decision_score").alias("n"), F.stddev_samp("decision_score").alias("stdev")).filter("n >= 2")


@query("D8_rates", f"{W} SELECT dim.condition, coalesce(avg(CASE WHEN r.doc_id IS NULL THEN NULL WHEN stale_memory_escape THEN 1.0 ELSE 0.0 END), 0)::DOUBLE AS rate FROM {CONDITIONS} LEFT JOIN results r ON r.condition = dim.condition GROUP BY dim.condition")
def rates(spark, sf):
    r = A.results(spark, sf).groupBy("condition").agg(R.rate(F.col("stale_memory_escape")).alias("rate"))
    return _dim(spark).join(r, "condition", "left").select("condition", F.coalesce("rate", F.lit(0.0)).alias("rate"))


@query("D9_budget_consistency", f"{W} SELECT case_id, test_kind, repeat, count(DISTINCT budget_chars) AS budgets FROM results GROUP BY case_id, test_kind, repeat HAVING count(DISTINCT budget_chars) > 1")
def budget_consistency(spark, sf):
    return A.results(spark, sf).groupBy("case_id", "test_kind", "repeat").agg(F.count_distinct("budget_chars").alias("budgets")).filter("budgets > 1")


@query("D10_mean_by_cell", f"{W} SELECT condition, wall_ms // 2000 AS size, budget_chars, avg(CASE WHEN doc_id % 23 <> 0 THEN decision_score END) AS mean FROM results GROUP BY condition, wall_ms // 2000, budget_chars")
def mean_by_cell(spark, sf):
    r = A.results(spark, sf).withColumn("score", F.expr("IF(doc_id % 23 = 0, double('NaN'), decision_score)"))
    return r.groupBy("condition", F.expr("wall_ms div 2000").alias("size"), "budget_chars").agg(F.avg(F.when(~F.isnan("score"), F.col("score"))).alias("mean"))


@query("D11_median_cost", f"{W} SELECT condition, median(wall_ms)::DOUBLE AS wall, median(input_tokens)::DOUBLE AS tokens, median(model_calls)::DOUBLE AS calls FROM results WHERE budget_chars = 1338 GROUP BY condition")
def median_cost(spark, sf):
    rows = A.results(spark, sf).filter("budget_chars = 1338")
    of = lambda c, name: R.quantiles(rows, "condition", c, [0.5]).withColumnRenamed("q0", name)
    return of("wall_ms", "wall").join(of("input_tokens", "tokens"), "condition").join(of("model_calls", "calls"), "condition")


@query("D12_percentiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag")
def percentiles(spark, sf):
    """Linear interpolation at q (n - 1)."""
    return R.quantiles(A.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", [0.5, 0.99]).withColumnsRenamed({"q0": "p50", "q1": "p99"})


_PLACE = "CASE condition WHEN 'raw_oracle' THEN 0 WHEN 'rolling_summary' THEN 1 WHEN 'dpm_phase3_checkpoint' THEN 2 ELSE 3 END"


@query("D13_stage_delta", f"{W}, m AS (SELECT condition, {_PLACE} AS place, avg(decision_score) AS mean FROM results GROUP BY condition) SELECT condition, mean, mean - lag(mean) OVER (ORDER BY place) AS delta FROM m")
def stage_delta(spark, sf):
    m = A.results(spark, sf).groupBy("condition").agg(F.avg("decision_score").alias("mean")).withColumn("place", F.expr(_PLACE))
    return m.select("condition", "mean", (F.col("mean") - F.lag("mean").over(Window.orderBy("place"))).alias("delta"))  # a row per condition


_AXES = "CASE WHEN doc_id % 5 > 0 THEN (doc_id % 7) / 7.0::DOUBLE END AS a1, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 3) / 3.0::DOUBLE END AS a2, (doc_id % 2)::DOUBLE AS a3, CASE WHEN doc_id % 9 > 0 THEN 0.5::DOUBLE END AS a4, CASE WHEN doc_id % 6 = 1 THEN 0.25::DOUBLE END AS det"


def _axes(spark, sf):
    return A.results(spark, sf).selectExpr("*", "CASE WHEN doc_id % 5 > 0 THEN (doc_id % 7) / 7.0D END AS a1", "CASE WHEN doc_id % 4 > 0 THEN (doc_id % 3) / 3.0D END AS a2", "CAST(doc_id % 2 AS DOUBLE) AS a3", "CASE WHEN doc_id % 9 > 0 THEN 0.5D END AS a4", "CASE WHEN doc_id % 6 = 1 THEN 0.25D END AS det")


@query("D14_composite_score", f"{W}, x AS (SELECT *, {_AXES} FROM results) SELECT doc_id, coalesce(decision_score, det, (a1 + a2 + a3 + a4) / 4, 'nan'::DOUBLE) AS score, coalesce(a1 = 1 AND a2 = 1 AND a3 = 1 AND a4 = 1, false) AS strict FROM x")
def composite_score(spark, sf):
    return _axes(spark, sf).selectExpr("doc_id", "coalesce(decision_score, det, (a1 + a2 + a3 + a4) / 4, double('NaN')) AS score", "coalesce(a1 = 1 AND a2 = 1 AND a3 = 1 AND a4 = 1, false) AS strict")


@query("D15_axis_rollup", f"{W}, x AS (SELECT *, {_AXES} FROM results) SELECT doc_id, coalesce(a1, 0) + coalesce(a2, 0) + coalesce(a3, 0) + coalesce(a4, 0) AS total, (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (a3 IS NOT NULL)::INT + (a4 IS NOT NULL)::INT AS scored, concat_ws(',', CASE WHEN a1 IS NULL THEN 'a1' END, CASE WHEN a2 IS NULL THEN 'a2' END, CASE WHEN a3 IS NULL THEN 'a3' END, CASE WHEN a4 IS NULL THEN 'a4' END) AS pending, (a1 + a2 + a3 + a4) / 4 AS mean FROM x")
def axis_rollup(spark, sf):
    values = F.array("a1", "a2", "a3", "a4")
    scored = F.array_compact(values)
    pending = F.array_join(F.array_compact(F.array(*[F.when(F.col(a).isNull(), a) for a in ("a1", "a2", "a3", "a4")])), ",")
    total = F.aggregate(scored, F.lit(0.0), lambda s, v: s + v)
    return _axes(spark, sf).select("doc_id", total.alias("total"), F.size(scored).alias("scored"), pending.alias("pending"), F.when(F.size(scored) == 4, total / 4).alias("mean"))


@query("D16_handoff_summary", f"{W} SELECT test_kind, count(*) AS n, count(*) FILTER (audit_pass) AS pass, count(*) FILTER (NOT audit_pass) AS fail, count(*) FILTER (audit_pass IS NULL) AS na, CAST(sum(input_tokens) AS BIGINT) AS tokens, avg(decision_score) AS mean FROM results GROUP BY test_kind")
def handoff_summary(spark, sf):
    return A.results(spark, sf).groupBy("test_kind").agg(F.count("*").alias("n"), F.count_if("audit_pass").alias("pass"), F.count_if(~F.col("audit_pass")).alias("fail"), F.count_if(F.col("audit_pass").isNull()).alias("na"), F.sum("input_tokens").alias("tokens"), F.avg("decision_score").alias("mean"))


@query("D17_corpus_summary", f"WITH {A.EV_STREAM}, b AS (SELECT CASE WHEN n < 55 THEN 'short' WHEN n < 70 THEN 'medium' ELSE 'long' END AS bucket, * FROM (SELECT session_id, count(*) AS n, count(*) FILTER (type = 'tool') AS tools, count(*) FILTER (type = 'correction') AS corrections FROM ev_stream GROUP BY session_id)) SELECT bucket, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, CAST(sum(tools) AS BIGINT) AS tools, CAST(sum(corrections) AS BIGINT) AS corrections FROM b GROUP BY bucket")
def corpus_summary(spark, sf):
    s = A.ev_stream(spark, sf).groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "tool").alias("tools"), F.count_if(F.col("type") == "correction").alias("corrections"))
    return s.groupBy(F.expr("CASE WHEN n < 55 THEN 'short' WHEN n < 70 THEN 'medium' ELSE 'long' END").alias("bucket")).agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.sum("tools").alias("tools"), F.sum("corrections").alias("corrections"))


@query("D18_first_by_class", f"{W} SELECT case_id, " + ", ".join(f"coalesce(arg_min(wall_ms, doc_id) FILTER (condition = '{c}'), 0) AS {c}" for c in A.CONDITIONS) + " FROM results GROUP BY case_id")
def first_by_class(spark, sf):
    p = A.results(spark, sf).groupBy("case_id").pivot("condition", list(A.CONDITIONS)).agg(F.min_by("wall_ms", "doc_id"))
    return p.fillna(0, list(A.CONDITIONS))


@query("D19_cost_asymmetry", f"{W}, s AS (SELECT case_id, sum(model_calls) AS calls, sum(wall_ms) FILTER (condition = 'rolling_summary') AS wa, sum(wall_ms) FILTER (condition = 'dpm_phase3_checkpoint') AS wb, sum(CASE WHEN condition = 'rolling_summary' THEN model_calls ELSE 0 END) AS ca, sum(CASE WHEN condition = 'dpm_phase3_checkpoint' THEN model_calls ELSE 0 END) AS cb FROM results GROUP BY case_id), t AS (SELECT * FROM s ORDER BY calls DESC, case_id LIMIT 1) SELECT case_id, CAST(calls AS BIGINT) AS calls, wa / nullif(wb, 0)::DOUBLE AS wall_ratio, ca / nullif(cb, 0)::DOUBLE AS call_ratio FROM t")
def cost_asymmetry(spark, sf):
    of = lambda c, x: F.sum(F.expr(f"CASE WHEN condition = '{x}' THEN {c} END"))
    s = A.results(spark, sf).groupBy("case_id").agg(F.sum("model_calls").alias("calls"), of("wall_ms", "rolling_summary").alias("wa"), of("wall_ms", "dpm_phase3_checkpoint").alias("wb"), F.coalesce(of("model_calls", "rolling_summary"), F.lit(0)).alias("ca"), F.coalesce(of("model_calls", "dpm_phase3_checkpoint"), F.lit(0)).alias("cb"))
    return s.orderBy(F.desc("calls"), "case_id").limit(1).selectExpr("case_id", "calls", "try_divide(wa, wb) AS wall_ratio", "try_divide(ca, cb) AS call_ratio")


@query("D20_policy_retention", f"{W} SELECT case_id, " + ", ".join(f"max(decision_score) FILTER (condition = '{c}') AS {c}" for c in A.CONDITIONS) + " FROM results WHERE test_kind = 'memory_projection' GROUP BY case_id")
def policy_retention(spark, sf):
    return A.results(spark, sf).filter("test_kind = 'memory_projection'").groupBy("case_id").pivot("condition", list(A.CONDITIONS)).agg(F.max("decision_score"))


@query("D23_agent_costs", f"{W} SELECT case_id, condition, CAST(sum(model_calls) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens, CAST(sum(wall_ms) AS BIGINT) AS wall FROM results GROUP BY case_id, condition")
def agent_costs(spark, sf):
    return A.results(spark, sf).groupBy("case_id", "condition").agg(F.sum("model_calls").alias("calls"), F.sum("input_tokens").alias("tokens"), F.sum("wall_ms").alias("wall"))


@query("D29_grouping_sets", "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark, sf):
    c = A.table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return c.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@query("D30_twin_axis", f"{W} SELECT condition, avg(input_tokens * 4) AS mean_bytes, avg(wall_ms) AS mean_ms FROM results GROUP BY condition")
def twin_axis(spark, sf):
    return A.results(spark, sf).groupBy("condition").agg(F.avg(F.col("input_tokens") * 4).alias("mean_bytes"), F.avg("wall_ms").alias("mean_ms"))


@query("D28_throughput", "WITH t AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS tokens, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE AS sec, count(*) AS n FROM events GROUP BY user_id, date_trunc('day', ts)) SELECT user_id, count(*) AS turns, round(avg(CASE WHEN sec > 0 THEN tokens / sec ELSE 0 END), 6) AS mean_rate, round(sum(sec), 3) AS seconds FROM t GROUP BY user_id")
def throughput(spark, sf):
    """Tokens a second by turn (a user's day); a turn without duration has rate 0."""
    e = A.table(spark, sf, "events").withColumn("us", F.expr("unix_micros(CAST(ts AS TIMESTAMP))"))
    t = e.groupBy("user_id", F.expr("date_trunc('day', ts)").alias("day")).agg(F.sum("value").alias("tokens"), ((F.max("us") - F.min("us")) / F.lit(1e6)).alias("sec"))
    return t.groupBy("user_id").agg(F.count("*").alias("turns"), F.round(F.avg(F.coalesce(F.try_divide("tokens", "sec"), F.lit(0.0))), 6).alias("mean_rate"), F.round(F.sum("sec"), 3).alias("seconds"))


@query("D31_metric_records", f"{W} SELECT condition, test_kind, count(*) AS n, '{{\"calls\":' || CAST(sum(model_calls) AS BIGINT) || ',\"tokens\":' || CAST(sum(input_tokens) AS BIGINT) || '}}' AS record FROM results GROUP BY condition, test_kind")
def metric_records(spark, sf):
    return A.results(spark, sf).groupBy("condition", "test_kind").agg(F.count("*").alias("n"), F.to_json(F.struct(F.sum("model_calls").alias("calls"), F.sum("input_tokens").alias("tokens"))).alias("record"))


@query("F4_unique_sorted", f"{W} SELECT DISTINCT budget_chars, test_kind FROM results ORDER BY 1, 2")
def unique_sorted(spark, sf):
    return A.results(spark, sf).select("budget_chars", "test_kind").distinct().orderBy("budget_chars", "test_kind")


@query("F6_ordered_listing", f"WITH {A.CKPT} SELECT session_id, string_agg(hash, ',' ORDER BY hash) AS hashes FROM ckpt GROUP BY session_id")
def ordered_listing(spark, sf):
    return A.ckpt(spark, sf).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("hash")), ",").alias("hashes"))


_TOOLS = "(SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 0)) AS normal, list_sort(list(DISTINCT event_type) FILTER (event_id % 3 = 0)) AS hack FROM events GROUP BY user_id)"


@query("G3_tool_difference", f"SELECT user_id, array_to_string(list_sort(list_filter(coalesce(hack, []), lambda x: NOT list_contains(coalesce(normal, []), x))), ',') AS only_hack FROM {_TOOLS}")
def tool_difference(spark, sf):
    return _tools(spark, sf).select("user_id", F.array_join(F.array_sort(F.array_except("hack", "normal")), ",").alias("only_hack"))


def _tools(spark, sf):
    e = A.table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.collect_set(F.expr("CASE WHEN event_id % 2 = 0 THEN event_type END")).alias("normal"), F.collect_set(F.expr("CASE WHEN event_id % 3 = 0 THEN event_type END")).alias("hack"))


@query("G4_tool_union", f"SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(hack, []), coalesce(normal, [])))), ',') AS every FROM {_TOOLS}")
def tool_union(spark, sf):
    return _tools(spark, sf).select("user_id", F.array_join(F.array_sort(F.array_union("hack", "normal")), ",").alias("every"))


@query("G5_superset", f"SELECT user_id, len(list_filter(coalesce(hack, []), lambda x: NOT list_contains(coalesce(normal, []), x))) = 0 AS covers FROM {_TOOLS}")
def superset(spark, sf):
    return _tools(spark, sf).select("user_id", (F.size(F.array_except("hack", "normal")) == 0).alias("covers"))


@query("G7_set_operations", "SELECT 'both' AS part, user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup') UNION ALL SELECT 'only_error', user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup')")
def set_operations(spark, sf):
    e = A.table(spark, sf, "events")
    a, b = e.filter("event_type = 'error'").select("user_id"), e.filter("event_type = 'signup'").select("user_id")
    return a.intersect(b).selectExpr("'both' AS part", "user_id").unionByName(a.subtract(b).selectExpr("'only_error' AS part", "user_id"))


@query("C10_twins", f"{W} SELECT a.case_id, a.repeat, a.doc_id AS raw_doc, b.doc_id AS roll_doc, a.decision_score - b.decision_score AS gap FROM results a JOIN results b ON a.case_id = b.case_id AND a.repeat = b.repeat AND a.condition = 'raw_oracle' AND b.condition = 'rolling_summary'")
def twins(spark, sf):
    r = A.results(spark, sf)
    a = r.filter("condition = 'raw_oracle'").selectExpr("case_id", "repeat", "doc_id AS raw_doc", "decision_score AS x")
    b = r.filter("condition = 'rolling_summary'").selectExpr("case_id", "repeat", "doc_id AS roll_doc", "decision_score AS y")
    return a.join(b, ["case_id", "repeat"]).selectExpr("case_id", "repeat", "raw_doc", "roll_doc", "x - y AS gap")


@query("A23_rubric_pairs", "SELECT conv_id || '-' || k AS case_id, conv_id || '-' || CASE k WHEN 'hack' THEN 'normal' ELSE 'hack' END AS paired_case_id, k AS pair_role, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), (VALUES ('normal'), ('hack')) AS v(k)")
def rubric_pairs(spark, sf):
    c = A.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.array(F.lit("normal"), F.lit("hack"))))
    return c.selectExpr("concat(conv_id, '-', k) AS case_id", "concat(conv_id, '-', IF(k = 'hack', 'normal', 'hack')) AS paired_case_id", "k AS pair_role", "n")


@query("E14_ranking_windows", "SELECT o_orderkey, rank() OVER w AS r, ntile(4) OVER w AS quarter, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ranking_windows(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return A.table(spark, sf, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.ntile(4).over(w).alias("quarter"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"))


_LINE = ["doc_id", "case_id", "condition", "repeat", "status", "decision_score", "audit_pass", "gate_may_use", "wall_ms"]


def _json_sql(c: str) -> str:
    value = f"'\"' || {c} || '\"'" if c in ("condition", "status") else f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || {value} END"


@query("A27_result_lines", f"{W} SELECT doc_id, '{{' || concat_ws(',', {', '.join(_json_sql(c) for c in _LINE)}) || '}}' AS line FROM results")
def result_lines(spark, sf):
    """The lines that files.write_json_lines writes: a fixed order of keys, absent optional fields left out."""
    return A.results(spark, sf).select("doc_id", F.to_json(F.struct(*_LINE), {"ignoreNullFields": "true"}).alias("line"))


_BARS = f"{W}, m AS (SELECT condition, count(*) AS n, avg(decision_score) AS mean FROM results GROUP BY condition), b AS (SELECT *, row_number() OVER (ORDER BY condition) - 1 AS place FROM m)"


@query("A28_report_lines", f"{_BARS} SELECT condition, '| ' || condition || ' | ' || n || ' | ' || coalesce(printf('%.3f', mean), '') || ' |' AS row, '<rect x=\"0\" y=\"' || place * 24 || '\" width=\"' || CAST(floor(coalesce(mean, 0) * 400) AS INTEGER) || '\" height=\"20\"/>' AS bar, '{{\"condition\":\"' || condition || '\",\"n\":' || n || '}}' AS summary FROM b")
def report_lines(spark, sf):
    """A row of the Markdown table, a bar of the chart and an entry of the JSON summary for each condition."""
    m = A.results(spark, sf).groupBy("condition").agg(F.count("*").alias("n"), F.avg("decision_score").alias("mean"))
    b = m.withColumn("place", F.row_number().over(Window.orderBy("condition")) - 1)  # a row for each condition
    row = F.concat(F.lit("| "), "condition", F.lit(" | "), "n", F.lit(" | "), F.coalesce(F.format_string("%.3f", "mean"), F.lit("")), F.lit(" |"))
    bar = F.concat(F.lit('<rect x="0" y="'), F.col("place") * 24, F.lit('" width="'), F.floor(F.coalesce("mean", F.lit(0.0)) * 400).cast("int"), F.lit('" height="20"/>'))
    return b.select("condition", row.alias("row"), bar.alias("bar"), F.to_json(F.struct("condition", "n")).alias("summary"))


@query("A24_corpus_cases", "SELECT 'case-' || conv_id AS case_id, 'd' || conv_id % 3 AS domain, conv_id * 7 AS seed, turn AS place, role AS type, 'T' || turn AS timestamp, CASE WHEN turn % 3 = 2 THEN 'turn ' || turn ELSE trim(regexp_replace(text, '[^A-Za-z .,]', ' ', 'g')) || CASE WHEN turn % 2 = 1 THEN chr(10) || '  # no comment' || chr(10) || 'end' ELSE '' END END AS payload, 'a b,' || conv_id AS ground_truth FROM conversations")
def corpus_cases(spark, sf):
    """Conversations as YAML files, with block scalars, quotes, comments and flow lists, and what is read of them."""
    said = F.expr("CASE WHEN turn % 3 = 2 THEN concat('\"turn ', turn, '\"') ELSE concat('|\n      ', trim(regexp_replace(text, '[^A-Za-z .,]', ' ')), IF(turn % 2 = 1, '\n        # no comment\n      end', ''), '\n') END")
    event = F.concat(F.lit("  - type: "), "role", F.lit("\n    timestamp: 'T"), "turn", F.lit("'\n    payload: "), said, F.lit("\n"))
    c = A.table(spark, sf, "conversations").withColumn("e", event).groupBy("conv_id").agg(F.expr("listagg(e, '# next\n\n') WITHIN GROUP (ORDER BY turn)").alias("t"))
    head = F.expr("concat('# a case\ncase_id: \"case-', conv_id, '\"\ndomain: d', conv_id % 3, '\nseed: ', conv_id * 7, '\nground_truth: [\"a b\", ', conv_id, ']\ntrajectory:\n')")
    return c.select(F.col("conv_id").cast("string").alias("path"), F.concat(head, "t").alias("value")).mapInPandas(corpus.events, corpus.EVENTS).drop("path")
