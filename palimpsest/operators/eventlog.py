"""Operators over event logs: scans, ranges, branches, rendering, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SESSION = ["tenant_id", "session_id"]
MAX_BRANCH_DEPTH = 16
MAX_RECORD_BYTES = 64 << 20


def in_range(log: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Events of the half-open range; the predicate reaches the scan."""
    log = log.filter(F.col("event_index") >= start)
    return log if end is None else log.filter(F.col("event_index") < end)


def accepted(log: DataFrame) -> DataFrame:
    """Rows that may be appended: not empty, not over the record limit."""
    return log.filter((F.octet_length("payload") > 0) & (F.octet_length("payload") <= MAX_RECORD_BYTES))


def render(log: DataFrame, line: Column, keys: list[str] = SESSION) -> DataFrame:
    return log.withColumn("_line", F.concat(F.lit("["), F.col("event_index") + 1, F.lit("] "), line)).groupBy(*keys).agg(F.expr("listagg(_line, '\n') WITHIN GROUP (ORDER BY event_index)").alias("rendered"))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their place, from 0, in the order of a column: ranges are sorted each by itself, and the ranges' sizes, a row
    for each, give what comes before. No task sees all rows."""
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = written(rows.repartitionByRange(int(parts), F.col(order).asc_nulls_first()).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first())))
    placed = inside.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_range", "_nth", "_before")


def tail(log: DataFrame, most: int, keys: list[str] = SESSION) -> DataFrame:
    """The last events of each session; 0 keeps all."""
    if most <= 0:
        return log
    order = Window.partitionBy(*keys).orderBy(F.desc("event_index"))
    return log.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= most).drop("_nth")


def resolve_branches(log: DataFrame, branches: DataFrame, depth: int = MAX_BRANCH_DEPTH) -> DataFrame:
    """log (conv_id, event_index, ...), branches (conv_id, parent_id, parent_count) -> each session's events with the
    prefix it inherits, renumbered. Each level is a join on the parent; a session's level is bounded by depth."""
    own = log.select("conv_id", F.col("event_index").alias("_own"), "payload", F.lit(0).alias("_level"))
    chain = branches.select("conv_id", "parent_id", F.col("parent_count").alias("_count"), F.lit(1).alias("_level"))
    levels = [own]
    for _ in range(depth):
        part = chain.join(log.select(F.col("conv_id").alias("parent_id"), F.col("event_index").alias("_own"), "payload"), "parent_id").filter(F.col("_own") < F.col("_count"))
        levels.append(part.select("conv_id", "_own", "payload", "_level"))
        chain = chain.alias("c").join(branches.alias("b"), F.col("c.parent_id") == F.col("b.conv_id")).select(F.col("c.conv_id"), F.col("b.parent_id"), F.least("c._count", "b.parent_count").alias("_count"), (F.col("c._level") + 1).alias("_level"))
        if not chain.limit(1).count():
            break
    every = levels[0]
    for part in levels[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("conv_id").orderBy(F.desc("_level"), "_own")
    return every.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("event_index"), "payload", (F.col("_level") > 0).alias("inherited"))


def with_regressions(log: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Adds timestamp_regressed, step_regressed and step_repeated."""
    order = Window.partitionBy(*keys).orderBy("event_index")
    seen = order.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("step_index") > 0, F.col("step_index"))
    return log.withColumns({
        "timestamp_regressed": F.coalesce(F.col("timestamp_us") < F.lag("timestamp_us").over(order), F.lit(False)),
        "step_regressed": F.coalesce(step < F.max(step).over(seen), F.lit(False)),
        "step_repeated": F.coalesce(step.isNotNull() & (F.count(step).over(Window.partitionBy(*keys, step)) > 1), F.lit(False)),
    })


def traced(log: DataFrame) -> DataFrame:
    """Fills unset trace coordinates: the step is the place, a tool's id is tool-<step>."""
    step = F.coalesce(F.when(F.col("step_index") > 0, F.col("step_index")), F.col("event_index") + 1)
    return log.withColumn("step_index", step).withColumn("tool_call_id", F.when(F.col("type") == "tool", F.coalesce(F.nullif(F.col("tool_call_id"), F.lit("")), F.concat(F.lit("tool-"), step))).otherwise(F.col("tool_call_id")))
