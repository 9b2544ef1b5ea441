"""The pluggable runner of a projection, and its deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Runner = Callable[[DataFrame, int], DataFrame]


def heuristic(view: DataFrame, budget: int) -> DataFrame:
    """The first sentence of each event, clipped and cited, in order, while the memory fits the budget."""
    item = F.concat(F.expr("left(split_part(payload, '.', 1), 40)"), F.lit(" ["), F.col("event_index") + 1, F.lit("]"))
    rows = view.select("session_id", "event_index", item.alias("item"))
    used = F.sum(F.length("item") + 1).over(Window.partitionBy("session_id").orderBy("event_index"))
    return rows.withColumn("used", used).filter(F.col("used") <= budget).groupBy("session_id").agg(F.expr("listagg(item, '|') WITHIN GROUP (ORDER BY event_index)").alias("memory"), F.count("*").alias("items"))


def project(view: DataFrame, budget: int, run: Runner = heuristic) -> DataFrame:
    """view (session_id, event_index, payload) -> session_id, memory, items."""
    return run(view, budget)
