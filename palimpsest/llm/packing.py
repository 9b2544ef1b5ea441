"""Best-fit packing by non-negative least squares over length patterns.

1. Every text is tokenized and, with one separator id at its end, cut into pieces of at most max_len ids.
2. The histogram of piece lengths (max_len numbers, whatever the corpus) goes to the driver. Lengths fall
   into bins of BIN ids; all patterns of one to DEPTH bins that fill a sequence are columns of a matrix,
   and non-negative least squares fits how often each is used so that together they use up the histogram.
   The counts are rounded down.
3. What is left is packed best fit, longest first, into the gaps of those sequences and into new ones;
   this too works on counts of lengths, not on pieces.
4. The plan is a list of intervals (length, ranks) -> sequences. Pieces get their rank among those of equal
   length (in RANK_SALTS parts, so that a frequent length is no single task) and look up their sequence.

Nulls: a null text counts as empty, which is one separator; a null doc_id stays null. Equal rows are packed
separately. A very long text is tokenized in slices that end at white space, which no token crosses. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored

BIN = 8
DEPTH = 3
RANK_SALTS = 64
#: A text is tokenized in slices of about so many bytes.
SLICE = 1 << 22
#: Chunks between white space, and words in them, whose ids a worker keeps: twice as many at most, some 200 bytes each.
CACHE = 1 << 19

#: A chunk that is a word and trailing ASCII punctuation; the tokenizer too ends a token between the two, as long as the
#: last character of the word is a letter before and after the tokenizer's own lower-casing and composing (``_letter``).
_tail = re.compile(r"^(.*\w)([!-&(-/:-@\[-`{-~]+)$", re.S)
_encoders: dict[tuple[str, int], "Encoder"] = {}


def _letter(c: str) -> bool:
    return c.isalpha() and c.lower().isalpha() and len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c)


def _letters(tokenizer) -> dict[int, str]:
    """For str.translate: what the tokenizer's model gets for a letter, in scripts whose letters do not compose with each other."""
    found = {}
    for c in filter(_letter, map(chr, range(0x530))):
        parts = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(c))
        if len(parts) == 1:
            found[ord(c)] = parts[0][0]
    return found


class Chunks(dict):
    """Ids of chunks, as little-endian unsigned 32-bit numbers; those not seen yet are tokenized. Of two generations: what is
    asked for stays, what is not goes with its generation."""

    def __init__(self, tokenizer, size: int) -> None:
        super().__init__()
        self.tokenizer, self.size = tokenizer, size
        self.model, self.letters = tokenizer.model, _letters(tokenizer)
        self.word = re.compile("[" + "".join(map(chr, self.letters)) + "]+")
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.encoded(chunk)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def encoded(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if self.word.fullmatch(text):  # the tokenizer takes a run of letters as one word
            return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text.translate(self.letters))])
        m = _tail.match(text) if "<|" not in text else None
        if m and _letter(m[1][-1]):
            return self[m[1].encode()] + self[m[2].encode()]
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and no token crosses it, so a text's ids are those
    of its chunks between ASCII white space, and chunks recur; so do words without the punctuation after them."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = Chunks(self.tokenizer, cache)

    def ids(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        out, at = [], 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) and text[end : end + 1] not in b" \t\n\r\x0b\x0c":
                end += 1
            out.append(b"".join(map(self.chunks.__getitem__, text[at:end].split())))
            at = end
        return b"".join(out)


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One for each worker and size."""
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]


def pieces(docs: DataFrame, tokenizer: str, max_len: int = 2048, separator: int = 0, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32. keep: workers keep the encoder for their next tasks."""
    end = np.array([separator], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cache) if keep else Encoder(tokenizer, cache)
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for d, t in zip(b.column("doc_id").to_pylist(), texts):
                ids = enc.ids(t or b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at : at + 4 * max_len]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if not keep:
            del enc
            released()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(units: int, depth: int) -> np.ndarray:
    """All non-increasing tuples of at most depth parts with sum units, padded with 0."""
    out: list[tuple[int, ...]] = []

    def add(head: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            out.append(head + (0,) * (depth - len(head)))
        elif len(head) < depth:
            for p in range(min(rest, head[-1] if head else rest), 0, -1):
                if p * (depth - len(head)) < rest:
                    break
                add((*head, p), rest - p)

    add((), units)
    return np.array(out, dtype=np.int64)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| with x >= 0, by active sets: the columns of steepest gain enter, a few of disjoint bins at a
    time, and the least-squares solution moves along the boundary, until no column gains."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    limit = 1e-7 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * n):  # each step adds columns; some hundred are usual
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        enter, used = [], np.zeros(a.shape[0], bool)
        for j in np.argsort(-gain)[:256]:
            rows = a[:, j] > 0
            if gain[j] > limit and not (used & rows).any():
                enter.append(j)
                used |= rows
            if len(enter) == 16:
                break
        if not enter:
            break
        passive[enter] = True
        while passive.any():
            at = np.flatnonzero(passive)
            part = a[:, at]
            z = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(at)), part.T @ b)
            bad = z <= limit
            if not bad.any():
                x[:] = 0
                x[at] = z
                break
            old = x[at]
            step = np.clip(np.min(np.where(bad, old / np.maximum(old - z, 1e-300), np.inf)), 0, 1)
            new = old + step * (z - old)
            gone = bad & (new <= limit)
            x[at] = np.where(gone, 0, new)
            passive[at[gone]] = False
    return x


def plan(hist: np.ndarray, max_len: int) -> tuple[np.ndarray, int]:
    """hist[l]: pieces of length l. -> intervals (length, first rank, end rank, sequence of the first), sorted, and
    the number of sequences. Its size depends on max_len, not on the pieces."""
    left = hist.astype(np.int64).copy()
    taken = np.zeros(max_len + 1, dtype=np.int64)
    out: list[tuple[int, int, int, int]] = []
    seq = 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(max_len + 1)]  # by free ids: (first sequence, count)

    def take(length: int, count: int, first: int) -> None:
        out.append((length, int(taken[length]), int(taken[length]) + count, first))
        taken[length] += count
        left[length] -= count

    if left[max_len]:
        count = int(left[max_len])
        take(max_len, count, seq)
        seq += count

    units = max_len // BIN
    forms = patterns(units, DEPTH)
    bins = np.zeros(units + 1, dtype=np.int64)
    np.add.at(bins, -(-np.arange(1, max_len + 1) // BIN), left[1:])
    # only patterns all of whose bins are there can be used
    forms = forms[((forms == 0) | (bins[forms] > 0)).all(axis=1)]
    if len(forms):
        a = np.zeros((units + 1, len(forms)))
        for k in range(DEPTH):
            on = forms[:, k] > 0
            np.add.at(a, (forms[on, k], np.flatnonzero(on)), 1)
        use = np.floor(nnls(a[1:], bins[1:].astype(float)) + 1e-6).astype(np.int64)
        for j in np.argsort(-use, kind="stable"):
            form = [int(p) for p in forms[j] if p]
            need = {p: form.count(p) for p in form}
            count = int(min([use[j], *(bins[p] // c for p, c in need.items())]))
            if count <= 0:
                continue
            edges, runs = {0, count}, []
            for p in form:
                bins[p] -= count
                at, run = 0, []
                for length in range(BIN * p, BIN * (p - 1), -1):
                    n = min(count - at, int(left[length])) if length <= max_len else 0
                    if n > 0:
                        take(length, n, seq + at)
                        run.append((at, at + n, length))
                        at += n
                        edges.add(at)
                runs.append(run)
            marks = sorted(edges)
            for lo, hi in zip(marks, marks[1:]):
                full = sum(length for run in runs for s, e, length in run if s <= lo < e)
                gaps[max_len - full].append((seq + lo, hi - lo))
            seq += count

    for length in range(max_len, 0, -1):
        free = length
        while left[length] > 0:
            while free <= max_len and not gaps[free]:
                free += 1
            n = int(left[length])
            if free <= max_len:
                first, count = gaps[free].pop()
                m = min(n, count)
                take(length, m, first)
                gaps[free - length].append((first, m))
                if count > m:
                    gaps[free].append((first + m, count - m))
                if free - length >= length:
                    free = length
                continue
            fit = max_len // length
            whole, rest = divmod(n, fit)
            if whole:
                for _ in range(fit):
                    take(length, whole, seq)
                gaps[max_len - fit * length].append((seq, whole))
                seq += whole
            if rest:
                for _ in range(rest):
                    take(length, 1, seq)
                gaps[max_len - rest * length].append((seq, 1))
                seq += 1
            free = length
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4), seq


def pack(docs: DataFrame, tokenizer: str, max_len: int = 2048, separator: int = 0, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset. cache: chunks of a generation;
    keep: workers keep them for their next tasks."""
    rows = pieces(docs, tokenizer, max_len, separator, cache, keep).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_SALTS)).cast("int"))
    rows = stored(rows, "pieces")
    counts = rows.groupBy("length", "salt").count()
    hist = np.zeros(max_len + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # max_len rows at most
        hist[r["length"]] = r["n"]
    found, _ = plan(hist, max_len)
    starts, firsts = found[:, 0] * 2**44 + found[:, 1], found[:, 3]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = np.asarray(b.column("rank"))
            at = np.searchsorted(starts, np.asarray(b.column("length")) * 2**44 + rank, side="right") - 1
            yield b.append_column("sequence_id", pa.array(firsts[at] + rank - found[at, 1]))

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(counts), ["length", "salt"])  # max_len * RANK_SALTS rows at most
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, sequence_id long").drop("rank")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
