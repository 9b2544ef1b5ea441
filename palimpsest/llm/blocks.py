"""Blocks of documents, and questions that blocks ask of all others.

A block is one row with some megabytes of whole documents. The table of blocks is written once, bucketed by block_id,
to the shared folder: every later pass reads the same rows whatever executor is lost, and a join with a block's small
answers moves the answers, never the texts.

Blocks ask about keys, 64-bit names of text windows. Each block first drops its own repeats, so a key that is everywhere
is sent once a block at most; keys go by their value to parts, whose size follows the input; a part answers each
block with a string of bits in the order of its keys.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Bytes of text in a block; a longer document is a block by itself.
BLOCK = 2 << 20
#: Bytes of text whose keys go to one part.
PART = 16 << 20
SCHEMA = "block_id long, doc_ids array<long>, ends array<long>, data binary"

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One name for two names in order."""
    h = a * _M1
    h ^= h >> np.uint64(32)
    h += b
    h *= _M2
    h ^= h >> np.uint64(29)
    return h


@dataclass
class Blocks:
    table: DataFrame
    name: str
    path: str
    parts: int

    def drop(self) -> None:
        """Deletes the table; what was read from it must have been written elsewhere."""
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pack(docs: DataFrame, *, ordered: bool) -> Blocks:
    """docs (doc_id, text) -> blocks; in data each document is followed by one space, whose place is its end.

    ordered: block_ids, and documents in a block, follow (doc_id, hash of the text), null first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if ordered:
        key = [F.col("doc_id"), F.xxhash64("text")]
        rows = rows.repartitionByRange(partitions, *key).sortWithinPartitions(*key)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, nth = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            ends = (np.cumsum([len(t) + 1 for t in texts]) - 1).tolist()
            return pa.RecordBatch.from_arrays([pa.array([base + nth], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([b" ".join(texts) + b" "], pa.binary())], names=["block_id", "doc_ids", "ends", "data"])

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = t.as_buffer().to_pybytes()
                if ids and size + len(text) > BLOCK:
                    yield block()
                    ids, texts, size, nth = [], [], 0, nth + 1
                ids.append(d)
                texts.append(text)
                size += len(text) + 1
        if ids:
            yield block()

    name, path = f"blocks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    made = rows.mapInArrow(build, SCHEMA)
    made.write.bucketBy(partitions, "block_id").option("compression", "zstd").option("path", path).saveAsTable(name)
    del made, rows
    release(spark)
    table = spark.table(name)
    total = table.select(F.element_at("ends", -1).alias("n")).agg(F.sum("n")).collect()[0][0] or 0
    return Blocks(table, name, path, max(partitions, -(-total // PART)))


def release(spark) -> None:
    """Lets Spark delete shuffle files that no plan needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Block:
    """One row, as arrays."""

    def __init__(self, row: dict) -> None:
        self.block_id: int = row["block_id"]
        self.doc_ids: list = row["doc_ids"]
        self.ends = np.asarray(row["ends"], np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.data: bytes = row["data"]
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.answers = [unpacked(row[c]) for c in ("first", "second") if c in row]


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            row = {n: b.column(n)[k].as_py() for n in b.schema.names}
            yield Block(row)


def unpacked(answer: list | None) -> dict[int, np.ndarray]:
    """Bytes of an answer by part."""
    return {a["part"]: np.frombuffer(a["bits"], np.uint8) for a in answer or []}


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)


def asked(block_id: int, keys: np.ndarray, columns: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """A row for each part that has keys: their columns one after the other, in order of place."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    payloads = [b"".join(c[order[cuts[p] : cuts[p + 1]]].tobytes() for c in columns) for p in rows]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([block_id] * len(rows), pa.int64()), pa.array(payloads, pa.binary())], names=["part", "block_id", "payload"])


def answered(keys: np.ndarray, answer: dict[int, np.ndarray], parts: int, columns: int) -> list[np.ndarray]:
    """The bits, columns of them, for each key in its own order."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    out = [np.zeros(len(keys), bool) for _ in range(columns)]
    for p, data in answer.items():
        n = cuts[p + 1] - cuts[p]
        bits = np.unpackbits(data)[: columns * n].astype(bool)
        for k in range(columns):
            out[k][order[cuts[p] : cuts[p + 1]]] = bits[k * n : (k + 1) * n]
    return out


def ask(table: DataFrame, question: Callable[[Block], pa.RecordBatch], answer: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]], width: int) -> DataFrame:
    """(block_id, answers): question makes a block's keys, width 64-bit columns; answer gets a part's columns and the
    block_id of each key, and returns the columns of bits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_in(batches):
            yield question(b)

    def reply(t: pa.Table) -> pa.Table:
        ids, payloads = t.column("block_id").to_numpy(), [np.frombuffer(x, np.uint64).reshape(width, -1) for x in t.column("payload").to_pylist()]
        sizes = [p.shape[1] for p in payloads]
        columns = [np.concatenate([p[k] for p in payloads]) for k in range(width)]
        bits = answer(columns, np.repeat(ids, sizes))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        packed = [np.packbits(np.concatenate([b[lo:hi] for b in bits])).tobytes() for lo, hi in zip(cuts, cuts[1:])]
        return pa.table({"block_id": pa.array(ids, pa.int64()), "part": t.column("part"), "bits": pa.array(packed, pa.binary())})

    sent = table.mapInArrow(send, "part int, block_id long, payload binary")
    replies = sent.groupBy("part").applyInArrow(reply, "block_id long, part int, bits binary")
    return replies.groupBy("block_id").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))
