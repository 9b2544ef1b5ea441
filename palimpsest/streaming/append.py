"""Incremental append: a stream of events into a log, each event once.

A batch is written to a folder of its own, batch=<id>, in place of what is there, so a batch that runs again after a failure changes
nothing; and events whose (session, index) an earlier batch has are left out, so a source that delivers twice does not either. The log is
read as one table, partitioned by batch; a reader that replays from a checkpoint's index prunes by session and index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["session_id", "event_index"]


def _folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes the events of a batch that no earlier batch has; of equal keys in the batch one, the first by its columns."""
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in KEYS]
    new = batch.groupBy(*KEYS).agg(F.min(F.struct(*rest)).alias("e")).select(*KEYS, "e.*") if rest else batch.distinct()
    if batch_id and _folder(spark, path):
        seen = spark.read.schema("session_id string, event_index long, batch long").parquet(path).filter(F.col("batch") < batch_id)
        new = new.join(seen.select(*KEYS), KEYS, "left_anti")
    new.select(*batch.columns).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def append_stream(events: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Starts the query that appends a stream of events (session_id, event_index, ...) to the log at path."""
    writer = events.writeStream.foreachBatch(lambda df, i: append_batch(df, i, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """The log from an index on."""
    return spark.read.parquet(path).drop("batch").filter(F.col("event_index") >= start)
