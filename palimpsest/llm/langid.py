"""Language identification in two steps: the family first, then one linear machine for each pair of its languages.

Features are hashed counts of byte 1- to 3-grams of the whole lower-cased text, square-rooted and scaled to length 1.
All classifiers are linear support vector machines (squared hinge, trained by accelerated gradients): one against
the rest for families, one against one inside a family, the votes of the pairs deciding and their margins breaking ties.

Families are the FAMILIES of known codes; a code that is not there is a family of its own. Training uses a sample of
at most ``per_language`` labelled documents of each language, the smallest of a hash of the doc_id; everything else
covers all rows. A language with one labelled document is learned like any other. Without labelled documents the
prediction is ``und``.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Null labels are not learned from. A null doc_id
is an identity like any other, the empty string. Rows equal in all columns get equal predictions. An empty table gives
an empty result. Other columns pass through where the caller keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released

DIMENSIONS = 4096
#: Bytes of a text that are counted at a time.
SLICE = 1 << 20
UNKNOWN = "und"
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be"],
}
_family_of = {code: name for name, codes in FAMILIES.items() for code in codes}
_letter = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """DIMENSIONS numbers of length 1 (or 0)."""
    counts = np.zeros(DIMENSIONS)
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    for at in range(0, max(1, len(data) - 2), SLICE):
        x = data[at : at + SLICE + 2]
        last = at + SLICE + 2 >= len(data)
        a, b, c = x[:-2], x[1:-1], x[2:]
        three = ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B) ^ (c * 0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        two = ((b * 0x165667B1) ^ (c * 0x9E3779B1)) * np.uint32(0x85EBCA77)
        counts += np.bincount(three >> 20, minlength=DIMENSIONS) + np.bincount(two >> 20, minlength=DIMENSIONS)
        counts += np.bincount((x if last else x[:-2]) * np.uint32(0x9E3779B1) >> 20, minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    return counts / max(1e-12, float(np.linalg.norm(counts)))


def has_letter(text: str | None) -> bool:
    return bool(text) and _letter.search(text) is not None


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights of a linear machine for y in {-1, 1}, both sides weighted alike; the last column of x is 1, for the bias."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1.0 / (2 * min(float(np.einsum("i,ij,ij->", weight, x, x)), 4.0) + penalty)
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v.astype(x.dtype)))
        new = v - rate * (penalty * v - 2 * ((weight * y * slack).astype(x.dtype) @ x))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: list[list[str]] = field(default_factory=list)
    family: np.ndarray | None = None
    pairs: list[np.ndarray] = field(default_factory=list)

    def predict(self, text: str | None) -> tuple[str, float, str | None]:
        """Language, score in [0, 1], family."""
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0, None
        x = np.append(features(text), 1.0)
        margin = self.family @ x
        at = int(margin.argmax())
        names = self.languages[at]
        score = 1 / (1 + np.exp(-4 * float(margin[at]))) if len(self.families) > 1 else 1.0
        if len(names) == 1:
            return names[0], float(score), self.families[at]
        won, total = np.zeros(len(names)), np.zeros(len(names))
        m = self.pairs[at] @ x
        k = 0
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                won[i] += m[k] >= 0
                won[j] += m[k] < 0
                total[i] += np.tanh(m[k])
                total[j] -= np.tanh(m[k])
                k += 1
        best = max(range(len(names)), key=lambda i: (won[i], total[i]))
        sure = 1 / (1 + np.exp(-4 * total[best] / (len(names) - 1)))
        return names[best], float(score * sure), self.families[at]


def fit(x: np.ndarray, labels: list[str]) -> Model:
    if not labels:
        return Model()
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    lang = np.array(labels)
    fam = np.array([_family_of.get(code.lower().split("-")[0], code) for code in labels])
    model = Model(families=sorted(set(fam.tolist())))
    model.family = np.stack([machine(x, np.where(fam == f, 1.0, -1.0)) if len(model.families) > 1 else np.zeros(x.shape[1]) for f in model.families])
    for f in model.families:
        names = sorted(set(lang[fam == f].tolist()))
        model.languages.append(names)
        rows = []
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                on = (lang == a) | (lang == b)
                rows.append(machine(x[on], np.where(lang[on] == a, 1.0, -1.0)))
        model.pairs.append(np.stack(rows) if rows else np.zeros((0, x.shape[1])))
    return model


def held_out():
    """Whether the document is kept from training: crc32 of its id as text modulo 5 is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _by_language(values: dict[str, float]):
    """The value of the row's language."""
    return F.coalesce(*[F.when(F.col("lang") == code, F.lit(v)) for code, v in values.items()], F.lit(-1.0))


def train(docs: DataFrame, per_language: int = 400) -> Model:
    """From docs (doc_id, text, lang), those that are not held out; at most per_language of each language."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)))
    # a hash threshold keeps about four times as many as are needed, so the exact pick sorts few rows and no text
    unit = F.pmod("draw", F.lit(2**40)) / float(2**40)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    few = known.select("doc_id", "lang", unit.alias("unit")).filter(F.col("unit") < _by_language({c: (4 * per_language + 100) / n for c, n in counts.items()}))
    drawn = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("unit", "doc_id"))).filter(F.col("nth") <= per_language)
    most = {r["lang"]: r["m"] for r in drawn.groupBy("lang").agg(F.max("unit").alias("m")).collect()}
    limit = _by_language(most)
    sample = known.filter(unit <= limit).select("text", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, codes = b.column("text").to_pylist(), b.column("lang").to_pylist()
            keep = [(features(t).astype(np.float32).tobytes(), c) for t, c in zip(texts, codes) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.binary()), pa.array([k[1] for k in keep], pa.string())], names=["x", "lang"])

    rows = sample.mapInArrow(vectors, "x binary, lang string").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    labels = [r["lang"] for r in rows]
    del rows
    return fit(x, labels)


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "family")) -> DataFrame:
    """The columns in keep, then language, score and family under these names, from text alone."""
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its size is languages squared times DIMENSIONS, not the corpus
    schema = f"row {dict(rows.dtypes)['row']}, lang_pred string, score double, family string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("row"), *columns], names=["row", "lang_pred", "score", "family"])
        released()

    return rows.mapInArrow(run, schema).select("row.*", *[F.col(c).alias(n) for c, n in zip(("lang_pred", "score", "family"), names)])
