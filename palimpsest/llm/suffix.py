"""Removal of repeats of LENGTH bytes by content-defined anchors.

These replace bucket-pointer refinement of a suffix array: no suffix is placed or sorted. Identifiers are 64-bit hashes,
not ranks, doubled from 1 byte to 32: that of 2 bytes at i is that of 1 at i with that of 1 at i + 1, and so on.

In every stretch of LENGTH bytes the suffix with the smallest 32-byte
identifier is its anchor; equal stretches have equal anchors at equal offsets. Neighbouring stretches with one anchor
form a context. First the anchors' buckets are compared, refined by the identifier of the whole context (which is
that of its first and its last LENGTH bytes): a bucket of one is done; a context that an earlier block or place has
too is repeated as a whole; only contexts that are the first of their kind, in a bucket with others, are refined to the
identifiers of each of their LENGTH-byte stretches, and those are compared.

A byte goes if a LENGTH-byte string that also starts earlier (smaller doc_id, or same document and earlier start)
covers it. Nulls: a null text is empty; a null doc_id comes before all others. Rows of one doc_id are separate
documents in the order of a hash of their text; for equal rows it does not matter. Two different strings among n compared ones
get one identifier with a chance of about n squared / 2^65. A very long document is a block by itself; its bytes
are named SLICE at a time. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, Blocks, answered, ask, asked, blocks_in, mixed, pack, release
from .common import stored

LENGTH = 100
GRAM = 32
#: Starts whose anchors are found at a time; below 2^24.
SLICE = 1 << 21

_rng = np.random.default_rng(9)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)


def grams(x: np.ndarray) -> np.ndarray:
    """Identifiers of the GRAM bytes at each place."""
    h, have = _BYTE[x], 1
    while have < GRAM:
        h, have = mixed(h[:-have], h[have:]), 2 * have
    return h


class Contexts:
    """The contexts of a block: first and last start, the place of the anchor, identifiers."""

    def __init__(self, b: Block) -> None:
        lo, hi, anchor, bucket, head, tail = [], [], [], [], [], []
        for s, e in self.stretches(b):
            # a stretch of documents, or a part of a long one, with all bytes that its starts need
            x = b.bytes[s:e]
            if len(x) < LENGTH:
                continue
            g = grams(x)
            key = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
            span, have = LENGTH - GRAM + 1, 1
            low = key
            while have < span:
                step = min(have, span - have)
                low, have = np.minimum(low[:-step], low[step:]), have + step
            at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
            start = np.arange(len(at))
            end = b.ends[np.searchsorted(b.ends, start + s)]
            valid = start + s + LENGTH <= np.minimum(end, e)
            new = valid & np.concatenate([[True], (at[1:] != at[:-1]) | ~valid[:-1]])
            first = np.flatnonzero(new)
            last = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
            lo.append(first + s)
            hi.append(last + s)
            anchor.append(at[first] + s)
            bucket.append(g[at[first]])
            head.append(self.named(g, first))
            tail.append(self.named(g, last))
        join = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
        self.lo, self.hi, self.bucket = join(lo, np.int64), join(hi, np.int64), join(bucket, np.uint64)
        names = mixed(join(head, np.uint64), join(tail, np.uint64))
        names = mixed(names, (self.hi - self.lo).astype(np.uint64))
        self.keys, self.first, self.inverse = np.unique(names, return_index=True, return_inverse=True)

    @staticmethod
    def stretches(b: Block) -> Iterator[tuple[int, int]]:
        """Runs of bytes, of about SLICE, so that each start of LENGTH bytes lies in one of them with all of them. A
        long document's parts overlap by LENGTH - 1 bytes; a context that spans two parts is two contexts."""
        at = 0
        while at < len(b.bytes):
            stop = min(len(b.bytes), at + SLICE)
            k = int(np.searchsorted(b.ends, stop, side="right"))
            whole = int(b.ends[k - 1]) + 1 if k else 0
            if whole > at:
                yield at, whole
                at = whole
            else:
                yield at, min(len(b.bytes), stop + LENGTH - 1)
                at = stop

    @staticmethod
    def named(g: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Identifiers of the LENGTH bytes at these places, of four overlapping grams."""
        return mixed(mixed(g[at], g[at + GRAM]), mixed(g[at + LENGTH - 2 * GRAM], g[at + LENGTH - GRAM]))


def _contexts(columns: list[np.ndarray], block: np.ndarray) -> list[np.ndarray]:
    """For a part's (bucket, context): does an earlier block have the context; does the bucket hold another one."""
    bucket, name = columns
    order = np.lexsort((block, name))
    same = np.concatenate([[False], name[order][1:] == name[order][:-1]])
    earlier = np.zeros(len(name), bool)
    earlier[order] = same
    _, inverse = np.unique(bucket, return_inverse=True)
    kinds = np.bincount(inverse, weights=~earlier)  # a context is counted where it comes first
    return [earlier, (kinds > 1)[inverse]]


def _stretches(columns: list[np.ndarray], block: np.ndarray) -> list[np.ndarray]:
    """Does an earlier block have it."""
    order = np.lexsort((block, columns[0]))
    name = columns[0][order]
    earlier = np.zeros(len(name), bool)
    earlier[order] = np.concatenate([[False], name[1:] == name[:-1]])
    return [earlier]


def _refined(b: Block, parts: int) -> tuple[Contexts, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts; which of them are repeated as a whole; the starts in those that need refinement and their names."""
    c = Contexts(b)
    earlier, shared = answered_contexts(c, b, parts)
    n = len(c.lo)
    is_first = np.zeros(n, bool)
    is_first[c.first] = True
    whole = ~is_first | earlier[c.inverse]
    need = np.flatnonzero(is_first & ~whole & shared[c.inverse])
    size = (c.hi - c.lo + 1)[need]
    starts = np.repeat(c.lo[need] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(need) else np.zeros(0, np.int64)
    names = []
    for s, e in Contexts.stretches(b):
        part = starts[(starts >= s) & (starts + LENGTH <= e)]
        names.append(Contexts.named(grams(b.bytes[s:e]), part - s) if len(part) else np.zeros(0, np.uint64))
    names = np.concatenate(names) if names else np.zeros(0, np.uint64)
    return c, whole, starts, names


def answered_contexts(c: Contexts, b: Block, parts: int) -> list[np.ndarray]:
    bucket = c.bucket[c.first]
    return answered(bucket, b.answers[0], parts, 2)


def marked(blocks: Blocks) -> DataFrame:
    """blocks with the answers on contexts (first) and on single stretches (second)."""
    parts = blocks.parts

    def contexts(b: Block) -> pa.RecordBatch:
        c = Contexts(b)
        bucket = c.bucket[c.first]
        return asked(b.block_id, bucket, [bucket, c.keys], parts)

    def stretches(b: Block) -> pa.RecordBatch:
        keys = np.unique(_refined(b, parts)[3])
        return asked(b.block_id, keys, [keys], parts)

    first = stored(ask(blocks.table, contexts, _contexts, 2), "contexts")
    release(blocks.table.sparkSession)
    with_first = blocks.table.join(first.withColumnRenamed("answers", "first").hint("shuffle_hash"), "block_id", "left")
    second = stored(ask(with_first, stretches, _stretches, 1), "stretches")
    release(blocks.table.sparkSession)
    return with_first.join(second.withColumnRenamed("answers", "second").hint("shuffle_hash"), "block_id", "left")


def deduplicate(docs: DataFrame, *, texts: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary)."""
    blocks = pack(docs, ordered=True)
    parts = blocks.parts

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_in(batches):
            c, whole, starts, names = _refined(b, parts)
            keys, first, inverse = np.unique(names, return_index=True, return_inverse=True)
            (earlier,) = answered(keys, b.answers[1], parts, 1)
            again = np.ones(len(names), bool)
            again[first] = False
            hit = starts[again | earlier[inverse]] if len(names) else starts
            step = np.zeros(len(b.bytes) + 1, np.int32)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + LENGTH, -1)
            np.add.at(step, c.lo[whole], 1)
            np.add.at(step, c.hi[whole] + LENGTH, -1)
            gone = np.cumsum(step[:-1]) > 0
            runs = gone & ~np.concatenate([[False], gone[:-1]])
            removed, spans = np.add.reduceat(gone, b.starts, dtype=np.int64), np.add.reduceat(runs, b.starts, dtype=np.int64)
            kept = []
            for s, e, r in zip(b.starts, b.ends, removed):
                kept.append(b.data[s:e] if not r else b.bytes[s:e][~gone[s:e]].tobytes())
            columns = [pa.array(b.doc_ids, pa.int64()), pa.array(b.ends - b.starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            if texts:
                columns.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts)

    out = stored(marked(blocks).mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts), "suffix")
    blocks.drop()
    return out
