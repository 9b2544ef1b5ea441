"""Pairs of texts whose sets of word shingles have a Jaccard similarity of a bound or more, none lost and none added.

Candidates: in any order of all shingles, two such sets share l of the first n - ceil(similarity * n) + l shingles of the one
whose prefix ends first, and those are in the other's prefix too (prefix filter). So a text stays only if the smallest l that
a partner can have of its prefix is in other prefixes; others go. Of what remains, a shingle that at most RARE sets have links
each pair of them (RARE / 2 rows a set at most), and pairs are counted: one stays if its count, and what either has of more
frequent shingles, reach l. A pair without a rare shingle in common shares l frequent ones; so those who have as many are
chained, by size, at each frequent shingle. Shingles that are frequent in a sample of SAMPLE texts come last in the order; it
affects the cost only.

Links: in each component of candidates the sets are compared in full, over an inverted list of the component's shingles.
The Jaccard distance is a metric: whoever was reached from a center need not ask again where the triangle bound leaves
nobody. A component of more than CHUNK shingles or NODES nodes is split into chunks that meet in pairs.

Shingles are 64-bit XXH64 values, and a set is named by 63 bits of its MD5: false chance about n^2 / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored

SAMPLE = 4096
#: Shingles whose frequency in the sample is known, at most; 16 bytes each in every task.
FREQUENT = 1 << 16
#: A prefix must share this part of the set's shingles.
PART = 0.1
#: Sets that have a shingle, up to which pairs are counted.
RARE = 8
#: Shingles and nodes of a chunk, about.
CHUNK, NODES = 1 << 20, 4096


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles, ascending; a text of fewer words has one, a text without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        found = [b" ".join(words)]
    else:
        found = list(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def least(n: int, similarity: float) -> int:
    """The smallest set that a set of n can be similar to."""
    return int(np.ceil(similarity * n - 1e-9))


def due(n: int) -> int:
    return max(1, int(PART * n))


def prefix_length(n: int, similarity: float) -> int:
    return min(n, n - least(n, similarity) + due(n))


def simhash(s: np.ndarray) -> bytes:
    """64 bits, each set if more than half of the shingles have it."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 15):
        bits = np.unpackbits(s[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 255):  # sums of bytes: less than 256 rows do not overflow
            count += np.add.reduce(bits[lo : lo + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(s), bitorder="little").tobytes()


def name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(s.astype("<u8").tobytes()).digest()[:8], "little") >> 1


def alike(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links between sets of similarity or more that connect what all such pairs connect."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    listed = owner[np.argsort(at, kind="stable")]
    ends = np.cumsum(np.bincount(at, minlength=len(values)))
    starts = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[0], np.cumsum(size)])
    open_ = np.ones(m, bool)
    left: list[int] = []
    right: list[int] = []
    for root in range(m):
        if not open_[root]:
            continue
        open_[root] = False
        queue: list[tuple[int, np.ndarray | None, float]] = [(root, None, 0.0)]
        while queue and open_.any():
            v, seen, far = queue.pop()
            if seen is not None and not (seen[open_] <= far + (1 - similarity) + 1e-9).any():
                continue
            own = at[first[v] : first[v + 1]]
            n = ends[own] - starts[own]
            places = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(listed[places], minlength=m)
            share = both / (size + size[v] - both)
            near = np.flatnonzero(open_ & (share >= similarity))
            open_[near] = False
            left += [v] * len(near)
            right += near.tolist()
            distance = 1 - share
            queue += [(int(u), distance, float(distance[u])) for u in near]
    return left, right


def frequencies(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three texts of the sample have, ascending, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t or b"", width).view(np.int64))], names=["shingle"])

    share = max(1, docs.count() // SAMPLE)
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(share)) == 0).select("text")
    found = drawn.mapInArrow(run, "shingle long").groupBy("shingle").count().filter("count > 2").orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect()
    known = np.array([r[0] for r in found], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.array([r[1] for r in found], np.int64)[order]


def prefixes(docs: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """docs (doc_id long, text binary) -> doc_id, digest (the text's MD5), node (its set's name), fp (the set's SimHash), size,
    prefix."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = frequent.value
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            node, fp, size, prefix = [], [], [], []
            for t in texts:
                s = shingles(t, width)
                weight = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, count[at], 0)
                node.append(name(s))
                fp.append(simhash(s))
                size.append(len(s))
                prefix.append(s[np.lexsort((s, weight))[: prefix_length(len(s), similarity)]].view(np.int64))
            digest = pa.array([hashlib.md5(t).hexdigest() for t in texts], pa.string())
            columns = [b.column("doc_id"), digest, pa.array(node, pa.int64()), pa.array(fp, pa.binary()), pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "node", "fp", "size", "prefix"])
        released()

    return docs.mapInArrow(run, "doc_id long, digest string, node long, fp binary, size long, prefix array<long>")


def candidates(prints: DataFrame, *, similarity: float) -> DataFrame:
    """prints (node, size, prefix), stored -> (a, b): links that connect all pairs of similarity or more. Entries are shuffled
    as they are once, by shingle; what is left, few, by node and once more by shingle."""
    by_node = Window.partitionBy("shingle").orderBy("node")
    whole = by_node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entries = prints.select("node", "size", F.explode("prefix").alias("shingle"))
    met = entries.withColumns({"before": F.lag("node").over(by_node), "low": F.first("node").over(whole), "high": F.last("node").over(whole)})
    shared = met.filter("low <> high AND (before IS NULL OR before <> node)").select("node", "size", "shingle")
    own = Window.partitionBy("node")
    likely = shared.withColumn("n", F.count("*").over(own)).filter(F.col("n") >= _needed(similarity)).select("node", "size", "shingle")
    sized = Window.partitionBy("shingle")
    ranked = likely.withColumn("sets", F.count("*").over(sized)).filter("sets > 1")
    # how many frequent shingles a set has goes along with it
    ranked = stored(ranked.withColumn("frequent", F.count(F.when(F.col("sets") > RARE, 1)).over(own)), "shared")
    by_size = sized.orderBy("size", "node")
    fits = F.col("smaller") / F.col("size") >= similarity
    frequent = ranked.filter((F.col("sets") > RARE) & (F.col("frequent") >= _needed(similarity)))
    chain = frequent.select(F.col("node").alias("a"), F.lag("node").over(by_size).alias("b"), "size", F.lag("size").over(by_size).alias("smaller"))
    rare = ranked.filter(F.col("sets") <= RARE)
    before = [F.lag(F.struct("node", "size", "frequent"), k).over(by_size) for k in range(1, RARE)]
    pairs = rare.withColumns({f"o{k}": o for k, o in enumerate(before)}).select("node", "size", "frequent", F.explode(F.array_compact(F.array(*[f"o{k}" for k in range(len(before))]))).alias("o"))
    pairs = pairs.select(F.col("node").alias("a"), F.col("o.node").alias("b"), "size", F.col("o.size").alias("smaller"), F.least("frequent", "o.frequent").alias("frequent")).filter(fits)
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("frequent").alias("frequent"), F.first("size").alias("size"))
    near = counted.filter(F.col("n") + F.col("frequent") >= _needed(similarity))
    return chain.filter(fits).select("a", "b").unionByName(near.select("a", "b")).distinct()


def _needed(similarity: float) -> Column:
    """How many shingles of its prefix a set of this size has in a similar set's, at least."""
    smallest = F.ceil(F.lit(similarity) * F.col("size") - 1e-9)
    return F.least(smallest, F.greatest(F.lit(1), F.floor(F.lit(PART) * smallest)))


def exact_links(members: DataFrame, heads: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """members (node, label, text), heads (node, label, size), stored -> (a, b): pairs of similarity or more that connect
    what all such pairs of one label connect."""
    total = heads.groupBy("label").agg(F.ceil(F.greatest(F.sum("size") / CHUNK, F.count("*") / NODES)).cast("int").alias("chunks")).filter("chunks > 1")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([shingles(t or b"", width).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), found], names=["node", "label", "own"])
        released()

    def compare(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        own = t.column("own").to_pylist()
        order = np.unique(node, return_index=True)[1]  # equal rows are one node
        a, b = alike([np.frombuffer(own[i], np.uint64) for i in order], similarity)
        return pa.table({"a": pa.array(node[order][a], pa.int64()), "b": pa.array(node[order][b], pa.int64())})

    dealt = members.select("node", "label", "text").mapInArrow(sets, "node long, label long, own binary").join(stored(total, "labels"), "label", "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1))
    dealt = dealt.withColumn("chunk", chunk).withColumn("other", other)
    dealt = dealt.select("label", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node", "own")
    return dealt.groupBy("label", "low", "high").applyInArrow(compare, "a long, b long").distinct()
