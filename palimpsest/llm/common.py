"""What the operators of this folder share: tables in the shared folder, text rules, and grouped ranks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of texts that go to Python at once: some megabytes, which the executor and its worker hold a few times over.
BATCH_ROWS = 1000

#: A word, as Java's and Python's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"
#: The same class for RE2, in DuckDB.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. Where that is unset, a local session (tests) gets a temporary
    folder; a cluster falls back to the warehouse, never to one machine's disk.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if context.master.startswith("local"):
        made = tempfile.mkdtemp(prefix="palimpsest-")
    else:
        made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    context.setCheckpointDir(made)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there, and what
    is read later is the same rows whichever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = shared_dir(spark)
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base.split(":", 1)[-1].strip("/") in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends at most BATCH_ROWS rows to Python at once (Spark's default is 10,000)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def released() -> None:
    """Gives what a Python worker has freed back to the system: it stays with its executor while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
