"""Tables between the steps of an operator, in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, a local session (tests) gets a temporary
    folder, a cluster its warehouse."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    own = context._jsc.sc().getCheckpointDir()
    if not folder and own.isDefined():
        folder = own.get()
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-") if context.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
        folder = context._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to a fresh path and read back: lineage ends there, and every later read sees the same rows."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
