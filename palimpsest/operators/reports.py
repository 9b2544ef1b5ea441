"""Null-aware summaries of result rows. A missing score is null and is left out, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def summary(value: str | Column, prefix: str) -> list[Column]:
    """count, mean, sample standard deviation (0 for one value), least and most; all null but the count without values."""
    v = F.col(value) if isinstance(value, str) else value
    return [
        F.count(v).alias(f"{prefix}_count"), F.avg(v).alias(f"{prefix}_mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"{prefix}_stdev"),
        F.min(v).alias(f"{prefix}_min"), F.max(v).alias(f"{prefix}_max"),
    ]


def rate(condition: Column) -> Column:
    """Share of rows, 0 of none; null counts as not."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def matched_cells(rows: DataFrame, cell: list[str], condition: str) -> DataFrame:
    """Rows of the cells that every condition present has."""
    per = rows.groupBy(*cell).agg(F.count_distinct(condition).alias("_own"))
    every = rows.agg(F.count_distinct(condition).alias("_all"))
    kept = per.join(F.broadcast(every), F.col("_own") == F.col("_all")).select(*cell)  # one row
    return rows.join(kept, cell, "left_semi")


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group -> one column q0, q1, ... for each share: exact, interpolated at share * (n - 1). Values are range-partitioned and
    ranked by ranges, so that no group is held by one task; only the rows at the wanted ranks meet."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = rows.select(group, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    ranged = written(v.repartitionByRange(parts, group, "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    before, whole = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    sizes = ranged.groupBy(group, "_range").count().select(group, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(whole).alias("_n"))  # a row for each range and group in it
    placed = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy(group, "_range").orderBy("_v"))).join(sizes, [group, "_range"]).withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
    out = []
    for k, q in enumerate(shares):
        at = F.lit(q) * (F.col("_n") - 1)
        low, high = F.max(F.when(F.col("_rank") == F.floor(at), F.col("_v"))), F.max(F.when(F.col("_rank") == F.ceil(at), F.col("_v")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"q{k}"))
    return placed.groupBy(group).agg(*out)
