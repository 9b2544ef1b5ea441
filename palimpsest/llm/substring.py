"""Substring dedup by difference-cover anchors.

A window is WINDOW consecutive words of one document; it is repeated if its word sequence also starts anywhere else.
The positions of a document whose index modulo PERIOD lies in COVER form a difference cover: for any two positions there
is a shift below PERIOD that takes both into the cover. Two equal windows therefore share an equal run of ANCHOR words,
ANCHOR = WINDOW - PERIOD + 1, that starts at a cover position in both. So only runs at cover positions (5 of 21) are
compared at first; windows that hold a run with a second occurrence are then extended to full length and compared as
wholes, which decides. Names of runs and windows are 64-bit hashes made by doubling; two different windows among n
compared ones get one name with a chance of about n squared / 2^65.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Nulls: a null text has no words; a null doc_id is kept. Rows of one doc_id are
separate documents, and repeated rows make their windows repeated. A very long document is a block by itself and takes
some 60 bytes of a task's memory for each of its bytes. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, Blocks, answered, ask, asked, blocks_in, mixed, pack, release
from .common import stored

WINDOW = 35
PERIOD = 21
#: Every difference modulo PERIOD occurs between two of these.
COVER = (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1

_rng = np.random.default_rng(8)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, 1 << 14, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def named(base: np.ndarray, length: int) -> np.ndarray:
    """Names of the runs of so many names, for every start: doubled, the last two overlapping."""
    h, have = base, 1
    while have < length:
        step = min(have, length - have)
        h, have = mixed(h[:-step], h[step:]) if len(h) > step else h[:0], have + step
    return h


class Words:
    """The words of a block: places, names, and the places of windows."""

    def __init__(self, b: Block) -> None:
        x = b.bytes
        space = (x == 32) | ((x >= 9) & (x <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        n = len(self.start)
        self.doc = np.searchsorted(b.ends, self.start)
        self.first = np.searchsorted(self.doc, np.arange(len(b.ends)))
        self.count = np.diff(np.append(self.first, n))
        if not n:
            self.name = np.zeros(0, np.uint64)
            return
        size = self.end - self.start
        at = np.flatnonzero(~space)
        offset = at - np.repeat(self.start, size)
        value = _BYTE[x[at]] * _PLACE[np.minimum(offset, len(_PLACE) - 1)]
        sums = np.add.reduceat(value, np.concatenate([[0], np.cumsum(size)[:-1]]))
        self.name = mixed(sums, size.astype(np.uint64))
        for i in np.flatnonzero(size > len(_PLACE)):
            self.name[i] = int.from_bytes(hashlib.sha256(b.data[self.start[i] : self.end[i]]).digest()[:8], "little")

    def windows(self) -> np.ndarray:
        """Starts of windows."""
        inside = np.arange(len(self.name)) - self.first[self.doc]
        return np.flatnonzero(inside + WINDOW <= self.count[self.doc])

    def anchors(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cover positions in reach of a window, and for each window those it holds, one for each of COVER."""
        inside = windows - self.first[self.doc[windows]]
        held = [windows + (c - inside) % PERIOD for c in COVER]
        mark = np.zeros(len(self.name), bool)
        for h in held:
            mark[h] = True
        return np.flatnonzero(mark), held


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, their lowest bit telling whether the block has them more than once; place of each key in it."""
    found, inverse, count = np.unique(keys & ~np.uint64(1), return_inverse=True, return_counts=True)
    return found | (count > 1).astype(np.uint64), inverse


def _repeated(columns: list[np.ndarray], _: np.ndarray) -> list[np.ndarray]:
    """Keys that one block has twice or two blocks have."""
    key, many = columns[0] >> np.uint64(1), (columns[0] & np.uint64(1)).astype(bool)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return [((np.bincount(inverse, weights=many) > 0) | (count > 1))[inverse]]


def _candidates(b: Block, parts: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The windows with a repeated anchor, and their names."""
    w = Words(b)
    windows = w.windows()
    at, held = w.anchors(windows)
    keys, inverse = _unique(named(w.name, ANCHOR)[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    (shared,) = answered(keys, b.answers[0], parts, 1)
    mark = np.zeros(len(w.name), bool)
    mark[at] = shared[inverse]
    windows = windows[np.any([mark[h] for h in held], axis=0)] if len(windows) else windows
    return w, windows, named(w.name, WINDOW)[windows] if len(windows) else np.zeros(0, np.uint64)


def marked(blocks: Blocks) -> DataFrame:
    """blocks with the answers on anchors (first) and on windows (second)."""
    parts = blocks.parts

    def anchors(b: Block) -> pa.RecordBatch:
        w = Words(b)
        at, _ = w.anchors(w.windows())
        keys, _ = _unique(named(w.name, ANCHOR)[at]) if len(at) else (np.zeros(0, np.uint64), None)
        return asked(b.block_id, keys, [keys], parts)

    def windows(b: Block) -> pa.RecordBatch:
        keys, _ = _unique(_candidates(b, parts)[2])
        return asked(b.block_id, keys, [keys], parts)

    first = stored(ask(blocks.table, anchors, _repeated, 1), "anchors")
    release(blocks.table.sparkSession)
    with_first = blocks.table.join(first.withColumnRenamed("answers", "first").hint("shuffle_hash"), "block_id", "left")
    second = stored(ask(with_first, windows, _repeated, 1), "windows")
    release(blocks.table.sparkSession)
    return with_first.join(second.withColumnRenamed("answers", "second").hint("shuffle_hash"), "block_id", "left")


def deduplicate(docs: DataFrame, *, texts: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: the words that no
    repeated window covers, joined by one space."""
    blocks = pack(docs, ordered=False)
    parts = blocks.parts

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_in(batches):
            w, windows, names = _candidates(b, parts)
            keys, inverse = _unique(names)
            (shared,) = answered(keys, b.answers[1], parts, 1)
            hit = windows[shared[inverse]]
            step = np.zeros(len(w.name) + 1, np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + WINDOW, -1)
            gone = np.cumsum(step[:-1]) > 0
            x = b.bytes.copy()
            x[w.end] = 32
            mask = np.zeros(len(x) + 1, np.int8)
            keep = ~gone
            mask[w.start[keep]] += 1
            mask[w.end[keep] + 1] -= 1
            inside = np.cumsum(mask[:-1]) > 0
            out = x[inside].tobytes()
            sizes = np.add.reduceat(inside, b.starts).astype(np.int64)
            removed = np.bincount(w.doc[gone], minlength=len(b.ends)) if len(w.doc) else np.zeros(len(b.ends), np.int64)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            kept = [out[lo : max(lo, hi - 1)] for lo, hi in zip(cuts, cuts[1:])]
            columns = [pa.array(b.doc_ids, pa.int64()), pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            if texts:
                columns.append(pa.array([k.decode("utf-8") for k in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    out = stored(marked(blocks).mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts), "substring")
    blocks.drop()
    return out
