"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are counted in each task before they are shuffled. A word is the vector of its letter counts. One inserted or deleted letter
changes one count by one, a replaced letter two, so near words have squared distances of 1 or 2, and NumPy gives those of a block
as |x|^2 + |y|^2 - 2xy, one matrix product. Only pairs at most two apart are verified: equal lengths must differ in one place,
adjacent lengths by one letter left out.

Blocks. Letters fall into CLASSES classes, of about equal use over the vocabulary (a table of at most 126 letters). A word's cell is
the numbers of its letters in each class, so a cell has one length, and an edit leads to the same cell or one that differs by one
letter moved or added: near words are in those adjacent cells and nowhere else. A word lives in its own cell and visits the smaller
adjacent ones, so each pair of adjacent cells meets once. A cell with more than SPLIT words and visitors is cut into chunks that
meet in pairs; a block's matrix is made STRIP products at a time.

A block returns for each of its words the number of near words and the best of them, not its pairs. Forms are followed to the last by
pointer jumping over stored tables; each step multiplies n by ten at least, so few rounds are needed.

Nulls: a null text has no words; a null doc_id counts as an empty number; equal rows count each; ties between forms go to the
smallest in code-point order; a run of any length is one word; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, FACTOR, TYPO = 7, 2, 10, 31
CLASSES = 6
#: Words and visitors of a cell that meet as one block.
SPLIT = 16_384
#: Entries of a matrix that are in memory at once.
STRIP = 1 << 22
#: Distinct words that a task holds before it sends their counts on.
HELD = 200_000
#: Lower case for A-Z only.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str, doc_id: int | None, least: int = LEAST_LENGTH, runs: re.Pattern | None = None) -> Iterator[tuple[str, int]]:
    """Words of least code points or more, with their number in this text. Shorter runs cannot become such words."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter((runs or re.compile(f"{LETTERS}{{{least},}}")).findall(text)).items():
        word = run if run.islower() and run.isascii() else run.translate(_LOWER)
        h = zlib.crc32(word.encode(), prefix)
        if h % TYPO == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            yield word, n


def vocabulary(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """docs (doc_id, text) -> word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        runs = re.compile(f"{LETTERS}{{{least_length},}}")

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for word, n in words_of(text or "", doc_id, least_length, runs):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield sent()
                    held = {}
        if held:
            yield sent()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def classes(vocab: DataFrame, count: int = CLASSES) -> np.ndarray:
    """The class of each of 256 code points: letters by falling use, each to the class with least so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.zeros(256, np.int64)
        for b in batches:
            use += np.bincount(np.frombuffer("".join(b.column("word").to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(use)], names=["letter", "use"])

    # 256 rows a task, 256 after the aggregation
    used = vocab.select("word").mapInArrow(run, "letter long, use long").groupBy("letter").agg(F.sum("use").alias("use")).collect()
    out, load = np.zeros(256, np.int64), [0] * count
    for r in sorted(used, key=lambda r: (-r["use"], r["letter"])):
        out[r["letter"]] = least = load.index(min(load))
        load[least] += r["use"]
    return out


def visits(vocab: DataFrame, group: np.ndarray) -> DataFrame:
    """word (Latin-1 bytes), n -> a row for each cell that the word lives in or visits: cell, home, word, n."""
    count = int(group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            if not words:
                continue
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            row = np.repeat(np.arange(len(words)), sizes)
            own = np.bincount(row * count + group[np.frombuffer(b"".join(words), np.uint8)], minlength=len(words) * count).reshape(-1, count)
            ns = b.column("n")

            def sent(at: np.ndarray, cells: np.ndarray, home: bool) -> pa.RecordBatch:
                wide = cells.astype(">u4").tobytes()
                step = 4 * count
                return pa.RecordBatch.from_arrays(
                    [pa.array([wide[k : k + step] for k in range(0, len(wide), step)], pa.binary()), pa.array([home] * len(at), pa.bool_()), pa.array(words, pa.binary()).take(pa.array(at)), ns.take(pa.array(at))],
                    names=["cell", "home", "word", "n"],
                )

            yield sent(np.arange(len(words)), own, True)
            for i in range(count):
                at = np.flatnonzero(own[:, i] > 0)
                less = own[at].copy()
                less[:, i] -= 1
                if len(at):
                    yield sent(at, less, False)  # the word is longer by one
                    for j in range(i + 1, count):
                        moved = less.copy()
                        moved[:, j] += 1  # smaller than its own: a letter moved to a later class
                        yield sent(at, moved, False)

    return vocab.select("word", "n").mapInArrow(run, "cell binary, home boolean, word binary, n long")


def _counts(m: np.ndarray, letters: np.ndarray, width: int) -> np.ndarray:
    n = len(m)
    return np.bincount((np.arange(n)[:, None] * width + letters[m]).ravel(), minlength=n * width).reshape(n, width).astype(np.float32)


def near_pairs(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near words of two matrices of code points, a row a word; y's words are as long as x's or longer by one.
    same: x is y, and each pair comes once."""
    if not len(x) or not len(y):
        return
    used = np.unique(np.concatenate([x.ravel(), y.ravel()]))
    letters = np.zeros(256, np.int64)
    letters[used] = np.arange(len(used))
    a, b = _counts(x, letters, len(used)), _counts(y, letters, len(used))
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    longer = y.shape[1] > x.shape[1]
    step = max(1, STRIP // len(b))
    for lo in range(0, len(a), step):
        from_ = lo if same else 0  # what is before has met these rows
        d = a[lo : lo + step] @ b[from_:].T
        d *= -2
        d += a2[lo : lo + step, None]
        d += b2[None, from_:]
        i, j = np.nonzero(d <= 2)
        i, j = i + lo, j + from_
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), STRIP // 16):
            p, q = i[at : at + STRIP // 16], j[at : at + STRIP // 16]
            ok = left_out(x[p], y[q]) if longer else (x[p] != y[q]).sum(axis=1) == 1
            if ok.any():
                yield p[ok], q[ok]


def left_out(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a row of long is that of short with one letter more: what they share at the beginning and the end is all of short."""
    head = np.cumprod(short == long[:, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return head + tail >= short.shape[1]


class Best:
    """Of each word of one matrix: how many near words it has, the largest n among them, and whose it is."""

    def __init__(self, m: np.ndarray, n: np.ndarray) -> None:
        self.m, self.n = m, n
        self.near = np.zeros(len(m), np.int64)
        self.top = np.zeros(len(m), np.int64)
        self.form: list[bytes | None] = [None] * len(m)

    def take(self, own: np.ndarray, other: Best, of: np.ndarray) -> None:
        self.near += np.bincount(own, minlength=len(self.m))
        order = np.lexsort((-other.n[of], own))
        first = order[np.r_[True, own[order][1:] != own[order][:-1]]]
        top = np.zeros(len(self.m), np.int64)
        top[own[first]] = other.n[of[first]]
        tied = other.n[of] == top[own]  # ties too go by code points: equal length or not, bytes of Latin-1 order like them
        for k, f in zip(own[tied].tolist(), of[tied].tolist()):
            n, word = int(top[k]), other.m[f].tobytes()
            if n > self.top[k] or n == self.top[k] and word < self.form[k]:
                self.top[k], self.form[k] = n, word


def _matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def block_forms(rows: list[tuple[bool, int, bytes, int]], one: int, two: int) -> list[tuple[str, int, int, str]]:
    """rows (home, chunk, word, n) of the block in which chunks one and two of a cell meet -> (word, near, top, form)."""
    sets: dict[tuple[bool, int, int], Best] = {}
    grouped: dict[tuple[bool, int, int], list[tuple[bytes, int]]] = {}
    for home, chunk, word, n in rows:
        grouped.setdefault((home, chunk, len(word)), []).append((word, n))
    for k, own in grouped.items():
        sets[k] = Best(_matrix([w for w, _ in own]), np.array([n for _, n in own], np.int64))
    for (home, chunk, _), x in sets.items():
        if not home:
            continue
        for (other, there, _), y in sets.items():
            if other and (there, chunk) != (two, one) or not other and one != two and there == chunk:
                continue  # two homes meet from the first chunk; those of one chunk meet in a block of their own
            for p, q in near_pairs(x.m, y.m, x is y):
                x.take(p, y, q)
                y.take(q, x, p)
    return [(b.m[k].tobytes().decode("latin-1"), int(b.near[k]), int(b.top[k]), b.form[k].decode("latin-1")) for b in sets.values() for k in np.flatnonzero(b.near)]


def near_forms(vocab: DataFrame, *, count: int = CLASSES, split: int = SPLIT) -> DataFrame:
    """word, n (a stored table) -> word, n_near, top, best of the words that have near ones."""
    rows = visits(vocab, classes(vocab, count))
    over = rows.groupBy("cell").agg(F.count("*").alias("size")).filter(F.col("size") > split).select("cell", F.ceil(F.col("size") / split).cast("int").alias("chunks"))
    rows = rows.join(over, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("word"), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("cell", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "home", "chunk", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple] = []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "top", "form"])

        def done() -> None:
            if held and any(r[0] for r in held) and len(held) > 1:
                out.extend(block_forms(held, *key[1:]))

        for b in batches:
            for cell, one, two, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (cell, one, two) != key:
                    done()
                    key, held = (cell, one, two), []
                    if len(out) > 20_000:
                        yield sent()
                        out.clear()
                held.append(row)
        done()
        if out:
            yield sent()

    found = rows.repartition("cell", "one", "two").sortWithinPartitions("cell", "one", "two").mapInArrow(run, "word string, near long, top long, form string")
    best = F.min(F.struct((-F.col("top")).alias("top"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("best.top")).alias("top"), F.col("best.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: forms followed to the last, twice as far each round."""
    found = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while found.filter("open").limit(1).count():
        there = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = stored(found.join(there, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "roots")
    return found.select("word", "root")


def group(docs: DataFrame, *, factor: int = FACTOR, count: int = CLASSES, split: int = SPLIT) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n."""
    vocab = stored(vocabulary(docs), "vocabulary")
    near = near_forms(vocab, count=count, split=split)
    known = stored(vocab.join(near, "word", "left").withColumn("form", F.when(F.col("top") >= factor * F.col("n"), F.col("best"))), "forms")
    root = roots(known.filter("form IS NOT NULL"))
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("top")).alias("form_n"))
