"""File sources and sinks: binary logs, JSON lines, reports.

Files are read through Spark's readers, so any store that Spark reaches will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import protocol as P

EVENT = "type STRING, tenant_id STRING, session_id STRING, payload STRING, timestamp_us LONG, model_id STRING, step_index LONG, tool_call_id STRING"


def read_binary_logs(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, record, error: frames of binary logs, with the fault that ended a file."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, None if r is None else r.decode("utf-8", "replace"), e) for p, c in zip(b["path"], b["content"]) for k, r, e in P.frames(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "frame", "record", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, frame long, record string, error string")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Typed events of binary logs; a record that does not parse keeps its text in bad."""
    logs = read_binary_logs(spark, path)
    parsed = logs.withColumn("e", F.from_json("record", EVENT + ", bad STRING", {"columnNameOfCorruptRecord": "bad"}))
    return parsed.select("path", F.col("frame").alias("event_index"), "error", "e.*")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Absent optional fields are left out; columns keep their order."""
    rows.write.mode("append").option("ignoreNullFields", "true").json(path)


def read_results(spark: SparkSession, path: str, schema: str, version: int = 1, allow_mock: bool = False) -> DataFrame:
    """Result lines of one version, mock and real ones not mixed."""
    rows = spark.read.schema(schema).json(path)
    seen = rows.agg(F.count_if(F.col("schema_version") != version).alias("other"), F.bool_or("mock").alias("mock"), F.bool_or(~F.col("mock")).alias("real")).first()
    if seen["other"]:
        raise ValueError(f"{seen['other']} rows are not of version {version}")
    if seen["mock"] and (seen["real"] or not allow_mock):
        raise ValueError("mock rows are mixed with real ones, or not allowed")
    return rows


def markdown(summary: DataFrame) -> str:
    """All rows of a summary as a Markdown table; a summary has a row for each condition or cell, not for each event."""
    rows = summary.collect()
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(summary.columns) + " |", "|" + "-|" * len(summary.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"
