"""Sharding by sampled splitters, law ``bytes``: the shards' sizes are near equal.

Records are ordered by (md5 of the text, doc_id), so equal texts stand together. A size-weighted sample of keys gives splitters
at its quantiles; ranges between splitters that turn out overfull are sampled, all in one pass, and split again until none is
left that can be split: first between texts, then, where one text alone overfills a range, between its doc_ids. Inside a range a
window gives each record its exact prefix of bytes; with the totals of the ranges before it, that is its place on the line of
all bytes. The result depends on the order alone, not on the sample.

A group of equal texts stays whole unless it is larger than a shard; then the line cuts it. Groups of more than a FINE-th of a
shard, or of a range, whose number is bounded so, are dealt to the emptiest shards, largest first; all other groups lie on the
line, which fills what room that leaves, and go where their middle lies.

Nulls: a null text has size 1 and the digest of the empty text; a null doc_id sorts first. Rows equal in
all columns are separate records in any order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Ranges at least, and rows of a range about.
RANGES = 256
PER_RANGE = 1 << 20
#: Keys drawn for each splitter.
DRAWN = 32
FINE = 200
WIDTH = 24


def _exponential(salt: int) -> Column:
    """The smallest of these are a sample without replacement with probability by size."""
    unit = (F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(2**52)) + 0.5) / float(2**52)
    return -F.log(unit) / F.col("size")


def _between_texts(key: bytes) -> bytes:
    return key[:16].ljust(WIDTH, b"\0")


def ranged(rows: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Adds rid, the number of splitters at or below the key."""
    cuts = np.array(splitters, dtype=f"S{WIDTH}")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array(b.column("key").to_pylist(), dtype=f"S{WIDTH}")
            rid = np.searchsorted(cuts, keys, side="right").astype(np.int32) if len(keys) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rid)], names=[*b.schema.names, "rid"])

    return rows.mapInArrow(place, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", rid int")


def splitters(rows: DataFrame, ranges: int, total: int) -> list[bytes]:
    """Keys that cut rows (key, size) into ranges of about equal bytes. As many as there are ranges are held by the driver."""
    drawn = sorted(bytes(r[0]) for r in rows.select("key", _exponential(0).alias("e")).orderBy("e").limit(DRAWN * ranges).select("key").collect())
    cuts = sorted({_between_texts(drawn[i * len(drawn) // ranges]) for i in range(1, ranges)}) if drawn else []
    salt = 0
    while True:
        salt += 1
        placed = ranged(rows, cuts)
        sums = placed.groupBy("rid").agg(F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).filter((F.col("b") > 2 * max(1, total // ranges)) & (F.col("lo") != F.col("hi"))).collect()
        if not sums:
            return cuts
        full = {r["rid"]: r for r in sums}
        nth = F.row_number().over(Window.partitionBy("rid").orderBy("e", "key"))
        some = placed.filter(F.col("rid").isin(list(full))).select("rid", "key", _exponential(salt).alias("e")).withColumn("nth", nth).filter(F.col("nth") <= 8 * DRAWN)
        keys: dict[int, list[bytes]] = {}
        for r in some.select("rid", "key").collect():
            keys.setdefault(r["rid"], []).append(bytes(r["key"]))
        more: set[bytes] = set()
        for rid, r in full.items():
            lo, hi, part = bytes(r["lo"]), bytes(r["hi"]), sorted(keys[rid])
            pieces = min(DRAWN, max(2, -(-r["b"] * ranges // total)))
            found = {part[i * len(part) // pieces] for i in range(1, pieces)} | {hi}
            if lo[:16] != hi[:16]:
                found = {_between_texts(k) for k in found}
            more |= {k for k in found if k > lo}  # hi is one of them, so the range is split
        cuts = sorted(set(cuts) | more)


def dealt(groups: list[tuple[str, int]], shards: int) -> tuple[list[tuple[str, int]], list[int]]:
    """(name, shard) of each group, the largest first to the emptiest shard; the shards' bytes."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for name, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        held, s = heapq.heappop(heap)
        out.append((name, s))
        heapq.heappush(heap, (held + size, s))
    return out, [held for held, _ in sorted(heap, key=lambda h: h[1])]


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, group_md5."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    flipped = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("group_md5"))
    rows = rows.withColumn("key", F.concat(F.unhex("group_md5"), F.unhex(F.coalesce(flipped, F.lit("0" * 16)))))
    rows = stored(rows, "shard")

    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(RANGES, -(-n // PER_RANGE))
    fine = min(total // (shards * FINE), total // ranges)
    groups = rows.groupBy("group_md5").agg(F.sum("size").alias("b"))
    large = [(r["group_md5"], r["b"]) for r in groups.filter((F.col("b") > fine) & (F.col("b") * shards <= total)).collect()]  # less than total / fine rows
    homes, held = dealt(large, shards)
    free = [max(0.0, total / shards - h) for h in held]
    light, room = total - sum(held), sum(free)
    edges = np.cumsum([f * light / room if room else 0 for f in free])[:-1]
    home = spark.createDataFrame(homes, "group_md5 string, home int")

    cuts = splitters(rows, ranges, total)
    placed = ranged(rows, cuts).join(F.broadcast(home), "group_md5", "left")  # bounded as above
    placed = placed.withColumn("lies", F.when(F.col("home").isNull(), F.col("size")).otherwise(0))
    order = Window.partitionBy("rid").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("rid", "group_md5")
    totals = placed.groupBy("rid").agg(F.sum("lies").alias("range_bytes"))
    line = Window.orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select("rid", F.coalesce(F.sum("range_bytes").over(line), F.lit(0)).alias("bytes_before"))
    placed = placed.withColumn("end", F.sum("lies").over(order)).withColumn("group_bytes", F.sum("lies").over(group)).withColumn("group_start", F.min(F.col("end") - F.col("lies")).over(group))
    placed = placed.join(F.broadcast(totals), "rid")  # a row per range
    middle = F.col("bytes_before") + F.when(F.col("group_bytes") <= fine, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("end") - F.col("lies") / 2)
    number = reduce(lambda a, e: a + (middle >= F.lit(float(e))).cast("int"), edges, F.lit(0))
    placed = stored(placed.select("doc_id", "size", "text_crc32", "group_md5", "key", "rid", F.coalesce("home", number).cast("int").alias("shard")), "sharded")

    before = Window.partitionBy("shard").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("rid", "shard").count().select("rid", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))  # a few rows per range
    out = placed.withColumn("nth", F.row_number().over(Window.partitionBy("rid", "shard").orderBy("key"))).join(counts, ["rid", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_md5")
