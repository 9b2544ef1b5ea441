"""Document fingerprints: improbable-feature digests.

Features are the FEATURE-byte windows of a text, one at each of its bytes, with bytes 0 after its end. A window is the rarer the
higher the entropy of its bytes: prose repeats letters. In every SPAN windows in a row (or in all, if a text has fewer) the
leftmost rarest one is selected. Each selected feature, where the text has it first, sets HASHES bits in a Bloom filter of BITS
bits; after CAPACITY features the next filter of the chain begins. The empty text has no filter. This holds for all lengths.

Likeness of two chains: for every filter of the shorter chain the best match in the longer one, where a match is the
share of common bits above what two random filters of these sizes share; mean over the filters, from 0 to 1.

Edited texts and neighbours: documents are range-partitioned and sorted by descending doc_id, so the next document is
the next row; only first and last rows of partitions meet through a small join. Nulls: a null text is empty; a null
doc_id sorts last; rows of equal doc_id are ordered by their text. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURE = 16
SPAN = 16
BITS = 2048
HASHES = 3
CAPACITY = 320
#: Bytes that are ranked together.
CHUNK = 1 << 17
#: The rank of a window that belongs to no text.
NONE = 1 << 30

_MULT = (np.random.default_rng(20).integers(0, 2**63, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_COUNT = np.arange(FEATURE + 2, dtype=np.float64)
_PLOGP = np.round(_COUNT * np.log2(np.maximum(_COUNT, 1)) * 4096).astype(np.int32)
_STEP = (_PLOGP[1:] - _PLOGP[:-1]).astype(np.int32)


def _rank(x: np.ndarray) -> np.ndarray:
    """Rank of the window at each byte but the last FEATURE - 1: small is rare. It is the sum of c log c over the counts of its
    bytes, which falls as the entropy rises."""
    n, w = len(x), FEATURE
    back, fore = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, w):
        same = (x[lag:] == x[:-lag]).view(np.uint8)
        back[lag:] += same
        fore[:-lag] += same
    # a window that moves by one byte: the byte that leaves, the byte that enters; fore counts equal bytes among the next w - 1,
    # back among the last w - 1: the w - 1 bytes that stay
    first = int(_PLOGP[np.bincount(x[:w], minlength=256)].sum())
    moves = _STEP[back[w:]] - _STEP[fore[: n - w]]
    return np.concatenate([[first], first + np.cumsum(moves, dtype=np.int64)])


def _selected(rank: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows that are the leftmost rarest of a span; starts and ends: of each text's windows, at least SPAN apart from the
    next text's, with NONE between."""
    low = (rank << 24) | np.arange(len(rank))
    best, width = low, 1
    while width < SPAN:
        step = min(width, SPAN - width)
        best = np.minimum(best, np.concatenate([best[step:], np.full(min(step, len(best)), NONE << 24)])[: len(best)])
        width += step
    mark = np.zeros(len(rank) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.maximum(starts + 1, ends - SPAN + 1), -1)  # the first span of a short text is all of it
    return np.unique(best[np.cumsum(mark[:-1]) > 0] & 0xFFFFFF)


def _hash(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, FEATURE)[at]).view("<u8")
    h = np.zeros(len(at), np.uint64)
    for k in range(FEATURE // 8):
        h = (h ^ words[:, k]) * _MULT[k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """In order of first place."""
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def features(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of each text's selected features, in order of place."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            x = np.frombuffer(b"".join([texts[i] + bytes(FEATURE) for i in group]), np.uint8)
            size = np.array([len(texts[i]) for i in group])
            starts = np.concatenate([[0], np.cumsum(size + FEATURE)[:-1]])
            rank = _rank(x)
            inside = np.zeros(len(rank) + 1, np.int32)
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + size, -1)
            sel = _selected(np.where(np.cumsum(inside[:-1]) > 0, rank, NONE), starts, starts + size)
            hashes = _hash(x, sel)
            cuts = np.searchsorted(sel, np.append(starts, len(x)))
            for k, i in enumerate(group):
                out[i] = _distinct(hashes[cuts[k] : cuts[k + 1]])
        group, held = [], 0

    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            out[i] = _long(t)
        elif t:
            if held + len(t) > CHUNK:
                flush()
            group.append(i)
            held += len(t) + FEATURE
    flush()
    return out


def _long(text: bytes) -> np.ndarray:
    """As for a short text, a stretch at a time; stretches overlap by what the choice of a window depends on."""
    x = np.frombuffer(text + bytes(FEATURE), np.uint8)
    windows, found = len(text), []
    for lo in range(0, windows, CHUNK):
        hi = min(windows, lo + CHUNK)
        a, b = max(0, lo - SPAN), min(windows, hi + SPAN)
        sel = _selected(_rank(x[a : b + FEATURE - 1]), np.array([0]), np.array([b - a])) + a
        found.append(_hash(x, sel[(sel >= lo) & (sel < hi)]))
    return _distinct(np.concatenate(found))


def chain(hashes: np.ndarray) -> np.ndarray:
    """Filters x BITS/8 bytes."""
    count = -(-len(hashes) // CAPACITY)
    bits = np.zeros(count * BITS, np.uint8)
    nth = np.arange(len(hashes)) // CAPACITY * BITS
    for k in range(HASHES):
        bits[nth + ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits.reshape(count, BITS), axis=1) if count else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    a8, b8 = a.view(np.uint64), b.view(np.uint64)
    na, nb = np.bitwise_count(a8).sum(axis=1).astype(float), np.bitwise_count(b8).sum(axis=1).astype(float)
    best = []
    for k in range(len(a8)):
        common = np.bitwise_count(a8[k] & b8).sum(axis=1)
        chance, most = na[k] * nb / BITS, np.minimum(na[k], nb)
        best.append(float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max()))
    return float(np.mean(best))


def written(filters: np.ndarray) -> str:
    """The chain as text: number of filters and their bits in base 64."""
    return f"{len(filters)}:" + base64.b64encode(filters.tobytes()).decode()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], nexts: list[str]) -> Iterator[tuple]:
    """Texts and the next documents' texts; consecutive texts share their fingerprints."""
    changed = [edited(t, n) for t, n in zip(texts, nexts)]
    own, other = [t.encode() for t in texts], [t.encode() for t in changed]
    follow = {i: n for i, n in enumerate(nexts) if not (i + 1 < len(texts) and texts[i + 1] is n)}
    found = features(own + other + [n.encode() for n in follow.values()])
    chains = [chain(h) for h in found]
    last = dict(zip(follow, chains[2 * len(texts) :]))
    for i, d in enumerate(ids):
        a, e = chains[i], chains[len(texts) + i]
        n = last[i] if i in last else chains[i + 1]
        yield d, len(texts[i]), hashlib.sha256(other[i]).hexdigest(), written(a), written(e), likeness(a, e), likeness(a, n)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])


def compare_neighbours(docs: DataFrame, partitions: int | None = None, at_once: int = 1 << 21) -> DataFrame:
    """docs (doc_id, text) -> RESULT: each text against its edited form and against the next document."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange(partitions, F.desc_nulls_last("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.desc_nulls_last("doc_id"), F.xxhash64("text"))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(d)
                texts.append(t)
                size += len(t)
                if size > at_once and len(ids) > 1:
                    yield _batch(list(_rows(ids[:-1], texts[:-1], texts[1:])))
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        if len(ids) > 1:
            yield _batch(list(_rows(ids[:-1], texts[:-1], texts[1:])))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or (b.column("doc_id")[0].as_py(), b.column("text")[0].as_py())
                last = (b.column("doc_id")[b.num_rows - 1].as_py(), b.column("text")[b.num_rows - 1].as_py())
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first[0]], pa.int64()), pa.array([first[1]]), pa.array([last[0]], pa.int64()), pa.array([last[1]])], names=["part", "first_id", "first_text", "last_id", "last_text"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(list(_rows(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("following").to_pylist())))

    edges = dealt.mapInArrow(ends, "part int, first_id long, first_text string, last_id long, last_text string")
    # a row per partition: numbered through, each last document meets the first of the next part, the very last the very first
    numbered = edges.withColumn("nth", F.row_number().over(Window.orderBy("part"))).withColumn("all", F.count("*").over(Window.partitionBy()))
    heads = numbered.select((F.pmod(F.col("nth") - 2, F.col("all")) + 1).alias("nth"), F.col("first_text").alias("following"))
    tails = numbered.select("nth", F.col("last_id").alias("doc_id"), F.col("last_text").alias("text"))
    closing = tails.join(heads, "nth").select("doc_id", "text", "following").mapInArrow(close, RESULT)
    return dealt.mapInArrow(inner, RESULT).unionByName(closing)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_features, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = features([t or b"" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(h) for h in found], pa.int64()), pa.array([written(chain(h)) for h in found], pa.string())], names=["doc_id", "n_features", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_features long, fingerprint string")
