"""SimHash near-duplicates, found in forests of vantage-point trees.

Fingerprint: every shingle of words gets 64-bit XXH64 values; a bit is 1 if more than half of them have it. Longer
fingerprints are several such words with different seeds.

Search: documents of equal fingerprints are one node, named by that fingerprint. A tree splits nodes by their
Hamming distance, on a mask of bits, to a vantage point: near ones go left, far ones right. Two fingerprints that differ
in at most ``limit`` bits differ in few bits on some mask (for masks that are ``blocks`` equal parts, limit // blocks on
one at least, which is the tree's radius). Whoever is farther from the vantage point than border - radius also enters the
right side: by the triangle bound nobody else on the left can be within radius of one on the right, so that branch is
pruned for all others, while those near the border reach the boundary-overlapping shards. The leaves are the shards; both
of a close pair are in one of them, and there distances are exact. So with equal parts as masks no pair is lost. The
first levels' vantage points come from SAMPLE fingerprints, which affects the sizes of leaves only; the points of deeper
levels are random words that each task derives from the place in the tree. The depth follows the number of nodes.

An overfull leaf is split into chunks that meet in pairs. A leaf returns a forest of links, not its pairs: a vantage point
takes its ball of radius limit; balls join through the nodes within twice that, which the triangle bound leaves. Connected
components then come from label spreading with pointer jumping over stored tables.

Nulls: a null text is empty; documents without words have the fingerprint zero and link like any other; a null doc_id
never names a component that has another, and is null if it has none. Equal rows are members of one node. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import dropped, stored, unused

SAMPLE = 4096
LEAF = 512
#: A leaf with more nodes is split: its nodes form chunks of about so many, and each pair of chunks is a task.
SPLIT = 2048
#: Nodes of a leaf that are compared with each other as one matrix; larger leaves go ball by ball.
MATRIX = 768
#: Sampled fingerprints that a vantage point needs below it; the levels with fewer have random points.
LEAST = 32
#: Candidates, some 100 bytes each, that may be broadcast.
FEW = 200_000
_AT_ONCE = 1 << 15


def fingerprint(text: bytes, width: int = 3, seeds: tuple[int, ...] = (42,), distinct: bool = False) -> list[int]:
    """One 64-bit word for each seed."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return [0] * len(seeds)
    n = max(1, len(words) - width + 1)
    if n == 1:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    if distinct:
        shingles = list(set(shingles))
        n = len(shingles)
    out = []
    for seed in seeds:
        count = np.zeros(64, np.int64)
        for at in range(0, n, _AT_ONCE):
            part = shingles[at : at + _AT_ONCE]
            h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), np.uint64, len(part))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # sums of bytes in eights: less than 256 rows at a time would not overflow
            for lo in range(0, len(bits), 255):
                count += np.add.reduce(bits[lo : lo + 255], axis=0, dtype=np.uint8)
        out.append(int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little"))
    return out


def fingerprints(docs: DataFrame, *, width: int = 3, seeds: tuple[int, ...] = (42,), distinct: bool = False, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (binary, little-endian words) and, if asked for, digest, the text's MD5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            found = [b"".join(w.to_bytes(8, "little") for w in fingerprint(t, width, seeds, distinct)) for t in texts]
            columns = [b.column("doc_id"), pa.array(found, pa.binary())] + [pa.array([hashlib.md5(t).hexdigest() for t in texts], pa.string())] * digest
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp"] + ["digest"] * digest)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp binary" + ", digest string" * digest)


def equal_parts(bits: int, limit: int, blocks: int = 2, keep: int = 1) -> tuple[list[np.ndarray], int]:
    """All masks of keep of the blocks parts, and the radius in which one of them finds every pair: if the pair
    differs in limit bits, spread as evenly as can be, the keep parts with fewest of them hold the radius."""
    edges = [bits * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), keep):
        m = np.zeros(bits, np.uint8)
        for c in chosen:
            m[edges[c] : edges[c + 1]] = 1
        masks.append(np.packbits(m, bitorder="little").view("<u8").astype(np.uint64))
    each, more = divmod(limit, blocks)
    return masks, each * keep + max(0, keep - (blocks - more))


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ v).sum(axis=-1, dtype=np.int64)


def _random(at: int, word: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(at.to_bytes(8, "little"), word))


class Tree:
    """A complete binary tree of so many levels that its leaves are about as many as asked for: vantage points and borders
    of its first levels by heap order, and a rule for the others."""

    def __init__(self, sample: np.ndarray, mask: np.ndarray, leaves: int, radius: int) -> None:
        self.mask, self.radius = mask, radius
        self.points: dict[int, tuple[np.ndarray, int]] = {}
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))

        def split(at: int, x: np.ndarray, level: int) -> None:
            if level == self.depth or len(x) < LEAST:
                return
            v = x[len(x) // 2]
            d = distances(x, v)
            # the border nearest to the middle, by what would be copied to the right
            found = min(np.unique(d)[:-1], key=lambda c: abs(2 * np.mean(d <= c) - 1) + np.mean((d > c - radius) & (d <= c)), default=None)
            if found is None:
                return
            self.points[at] = (v, int(found))
            split(2 * at, x[d <= found], level + 1)
            split(2 * at + 1, x[d > found], level + 1)

        split(1, sample & mask, 0)

    def point(self, at: int) -> tuple[np.ndarray, int]:
        if at in self.points:
            return self.points[at]
        v = np.array([_random(at, k) for k in range(len(self.mask))], np.uint64) & self.mask
        return v, int(np.bitwise_count(self.mask).sum()) // 2 - 1

    def routed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the leaves that each row enters."""
        out: list[tuple[np.ndarray, int]] = []
        x = x & self.mask
        work = [(1, np.arange(len(x)))]
        while work:
            at, rows = work.pop()
            if not len(rows):
                continue
            if at >> self.depth:
                out.append((rows, at))
                continue
            v, border = self.point(at)
            d = distances(x[rows], v)
            work.append((2 * at, rows[d <= border]))
            work.append((2 * at + 1, rows[d > border - self.radius]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in out]), np.repeat([a for _, a in out], [len(r) for r, _ in out])


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each element's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def linked(x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within limit connect."""
    n = len(x)
    if n <= MATRIX:
        near = np.zeros((n, n), np.int64)
        for k in range(x.shape[1]):
            near += np.bitwise_count(x[:, k][:, None] ^ x[:, k][None])
        a, b = np.nonzero(np.triu(near <= limit, 1))
        label = components(n, a, b)
        at = np.flatnonzero(label != np.arange(n))
        return at, label[at]
    left, right = [], []
    rest = np.arange(n)
    while len(rest):
        v, rest = rest[0], rest[1:]
        d = distances(x[rest], x[v])
        ball, shell = rest[d <= limit], rest[(d > limit) & (d <= 2 * limit)]
        left.append(ball)
        right.append(np.full(len(ball), v))
        # whoever is within limit of one in the ball is within twice that of v; the ball itself is connected
        if len(ball) and len(shell):
            for lo in range(0, len(ball), max(1, (1 << 20) // len(shell))):
                part = ball[lo : lo + max(1, (1 << 20) // len(shell))]
                i, j = np.nonzero(distances(x[part][:, None], x[shell][None]) <= limit)
                # one link from each member of the shell is enough: the ball is one component
                s, first = np.unique(j, return_index=True)
                left.append(shell[s])
                right.append(part[i[first]])
        rest = rest[d > limit]
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame, *, limit: int, masks: list[np.ndarray], radius: int) -> DataFrame:
    """nodes (node long, fp binary), stored -> (a, b): links that connect the components."""
    words = len(masks[0])
    n = nodes.count()
    sample = nodes.select("fp").orderBy(F.xxhash64("fp", F.lit(1))).limit(SAMPLE).collect()
    drawn = np.array([np.frombuffer(r["fp"], "<u8") for r in sample], dtype=np.uint64).reshape(-1, words)
    trees = [Tree(drawn, m, -(-n // LEAF), radius) for m in masks]
    forest = nodes.sparkSession.sparkContext.broadcast(trees)  # less than SAMPLE points a tree

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            fps = b.column("fp").to_pylist()
            x = np.frombuffer(b"".join(fps), "<u8").reshape(-1, words)
            for t, tree in enumerate(forest.value):
                rows, leaf = tree.routed(x)
                fp = pa.array([fps[i] for i in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((t << 48) + leaf, pa.int64()), pa.array(node[rows], pa.int64()), fp], names=["shard", "node", "fp"])

    def search(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        x = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").astype(np.uint64).reshape(-1, words)
        order = np.argsort(node, kind="stable")
        a, b = linked(x[order], limit)
        return pa.table({"a": pa.array(node[order][a], pa.int64()), "b": pa.array(node[order][b], pa.int64())})

    routed = nodes.mapInArrow(route, "shard long, node long, fp binary")
    # a cluster of near copies can fill a leaf: its chunks meet in pairs, so no task holds more than two of them
    full = routed.groupBy("shard").count().filter(F.col("count") > SPLIT).select("shard", F.ceil(F.col("count") / SPLIT).cast("int").alias("chunks"))
    full = stored(full, "leaves")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = routed.join(full, "shard", "left").withColumn("chunk", F.coalesce(chunk, F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1))
    dealt = dealt.withColumn("other", other).select("shard", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node", "fp")
    return dealt.groupBy("shard", "low", "high").applyInArrow(search, "a long, b long").distinct()


def spread(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): the smallest node of each component, for nodes with an edge."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        # the label's own label, and the smallest label that reached any of the label's nodes
        jump = hooked.groupBy(F.col("old").alias("at")).agg(F.min("new").alias("far"))
        step = hooked.join(jump, hooked["new"] == jump["at"], "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old")
        new = stored(step, "labels")
        changed = new.filter(F.col("label") != F.col("old")).limit(1).count()
        dropped(labels)
        labels = new.select("node", "label")
        if not changed:
            dropped(both)
            return labels


def grouped(prints: DataFrame, *, limit: int, masks: list[np.ndarray], radius: int) -> DataFrame:
    """prints (doc_id, fp of 8 bytes, ...), stored -> its columns and component_id: the smallest doc_id reachable. A node is named by
    its fingerprint itself, whatever its doc_ids are."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long")), "nodes")
    edges = links(nodes.select("node", "fp"), limit=limit, masks=masks, radius=radius)
    groups = nodes.join(spread(edges), "node", "left").select("fp", "first", F.coalesce("label", "node").alias("component"))
    names = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(groups.join(names, "component").select("fp", "component_id"), "fp", "left")


def near_duplicates(docs: DataFrame, *, width: int = 3, limit: int = 3, blocks: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (16 hexadecimal digits), component_id: 64 bits, every pair within limit."""
    prints = stored(fingerprints(docs, width=width), "prints")
    masks, radius = equal_parts(64, limit, blocks)
    found = grouped(prints, limit=limit, masks=masks, radius=radius)
    digits = F.lower(F.concat(*[F.hex(F.substring("fp", k, 1)) for k in range(8, 0, -1)]))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def bits_for(similarity: float, bits: int, slack: float = 2.0) -> int:
    """Differing bits up to which two shingle sets of this Jaccard similarity are expected to lie, and slack standard
    deviations more. Sets of similarity j have the cosine 2 j / (1 + j), and each bit differs with their angle."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + slack * np.sqrt(bits * share * (1 - share)))


def representatives(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, limit: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each group of near copies: the one with the smallest doc_id, rows without
    one last, ties by the text's digest.

    Groups are the components of documents whose sets of width-word shingles have a Jaccard similarity of at least
    similarity. The forest of vantage-point trees finds the pairs whose SimHash differs in at most limit bits; as fingerprints
    only estimate the similarity, a prefix filter adds the pairs that they miss, and the sets of all candidates are compared in
    full, which decides: see shingles.py.
    """
    key = lambda: F.concat_ws("|", F.col("doc_id").cast("long").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")).alias("k")
    tag = F.concat_ws("|", F.col("k.doc_id").cast("string"), "k.digest").alias("_palimpsest_kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prints = stored(shingles.prefixes(rows, width=width, similarity=similarity), "prints")
    masks, radius = equal_parts(64, limit)
    near = links(stored(prints.groupBy("node").agg(F.first("fp").alias("fp")), "nodes"), limit=limit, masks=masks, radius=radius)
    met = spread(near.unionByName(shingles.candidates(prints, similarity=similarity)).distinct())
    heads = stored(prints.join(met, "node").groupBy("node", "label").agg(first, F.first("size").alias("size")).select("node", "label", "size", tag), "heads")
    few = heads.limit(FEW + 1).count() <= FEW  # else the texts are shuffled
    members = rows.withColumn("_palimpsest_kept", key()).join(F.broadcast(heads) if few else heads, "_palimpsest_kept")
    groups = spread(shingles.exact_links(members, heads, width=width, similarity=similarity))
    found = prints.join(groups, "node", "left").withColumn("component", F.coalesce("label", "node"))
    chosen = stored(found.groupBy("component").agg(first).select(tag), "kept")
    kept = unused(docs, "_palimpsest_kept")
    return docs.withColumn(kept, key()).join(chosen.withColumnRenamed("_palimpsest_kept", kept), kept, "left_semi").dropDuplicates([kept]).drop(kept)
