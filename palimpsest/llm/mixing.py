"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a word budget. Whole epochs of the source come first; what is left of the budget is
filled with the documents of smallest exponential key ``-ln(u) / quality``, in key order, until the
prefix sum of their sizes reaches it; the document on the edge gives its first words only, so a
source meets its budget to the word.

The prefix sum is not one sort of a source. Keys fall into KEY_BINS bins of the unit interval; sums
by (source, bin) tell in which bin the budget ends, and only the rows of that bin are sorted. A source
that holds most rows costs one aggregation like any other.

A source without words has the target 0, and nothing is taken of it. Nulls: a null text has size 0; a null source is a source of its own, the last; a null doc_id has the
key of the empty string; a missing, null or non-positive grade counts as 1. Rows that are equal in all columns
are separate documents with equal keys. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

KEY_BINS = 4096


def allocate(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> target: share of all sizes by weight, none above most times its size;
    what a capped source leaves goes to the others by weight. One row per source, so one small window.

    A source is capped if its share of what the sources with a smaller ratio of cap to weight leave is
    above its cap; in that order the capped ones come first, and this equals resharing again and again.
    """
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", cycle.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = ranked.withColumn("capped", F.col("cap") <= F.col("weight") * left / weight_left)
    spare = F.lit(share) * F.sum("source_size").over(all_rows) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(all_rows)
    level = spare / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_rows)
    return out.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level))


def letters(text: str = "text") -> Column:
    """A quality weight from the text itself: 0.5, and up to 1.5 more by the share of letters and white space."""
    share = F.length(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.lit(0.5) + F.lit(1.5) * F.coalesce(share, F.lit(0.0))


def sized(docs: DataFrame, columns: list[str], seed: str, quality: Column | None = None) -> DataFrame:
    """columns of docs (doc_id, text, source), then size, unit (the uniform number of the document), skey, and _grade
    where there is a quality."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return docs.select(*columns, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), unit.alias("unit"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), *([quality.cast("double").alias("_grade")] if quality is not None else []))


def keyed(rows: DataFrame, grades: DataFrame | None = None) -> DataFrame:
    """rows of sized() with the exponential key, scaled by the document's grade (of grades, or their own), and its bin."""
    if grades is not None:
        rows = rows.join(grades.select("doc_id", F.col("grade").cast("double").alias("_grade")), "doc_id", "left")
    grade = F.when(F.col("_grade") > 0, F.col("_grade")).otherwise(1.0) if "_grade" in rows.columns else F.lit(1.0)
    rows = rows.withColumn("key", -F.log("unit") / grade)
    return rows.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * KEY_BINS).cast("int")).drop("unit", "_grade")


def planned(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """skey -> source_size, target, epochs, rest (words beyond the epochs), edge (the bin where they end), below (words
    of the bins before it); a row per source, stored."""
    bins = rows.groupBy("skey", "bin").agg(F.max("source").alias("source"), F.sum("size").alias("words"))
    plan = allocate(bins.groupBy("skey").agg(F.max("source").alias("source"), F.sum("words").alias("source_size")), weights, share, most)
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    plan = plan.select("skey", "source_size", "target", "epochs", "rest")
    order = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = bins.withColumn("upto", F.sum("words").over(order)).join(plan.select("skey", "rest"), "skey")
    edge = edge.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    edge = edge.groupBy("skey").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("below"))).alias("e")).select("skey", F.col("e.bin").alias("edge"), F.col("e.below").alias("below"))
    return stored(plan.join(edge, "skey", "left"), "mix-plan")


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows of keyed() with source_size, target, epochs, part and taken. Only rows in edge bins are sorted."""
    columns = [c for c in rows.columns if c not in ("skey", "key", "bin")]
    rows = rows.join(plan, "skey")
    inside = rows.filter(F.col("edge").isNull() | (F.col("bin") != F.col("edge")))
    inside = inside.withColumn("part", F.when(F.col("edge").isNull() & (F.col("rest") == 0), 0).when(F.col("edge").isNull() | (F.col("bin") < F.col("edge")), F.col("size")).otherwise(0).cast("long"))
    at = Window.partitionBy("skey").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edged = rows.filter(F.col("bin") == F.col("edge")).withColumn("room", F.col("rest") - F.col("below") - F.coalesce(F.sum("size").over(at), F.lit(0)))
    edged = edged.withColumn("part", F.greatest(F.lit(0), F.least("size", "room")).cast("long"))
    columns += ["source_size", "target", "epochs", "part"]
    both = inside.select(*columns).unionByName(edged.select(*columns))
    return both.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mix(docs: DataFrame, *, grades: DataFrame | None = None, quality: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, epochs, part, taken.

    epochs: whole copies of the document; part: words of one more, partial or whole, copy;
    taken = epochs * size + part. grades: (doc_id, grade), a row per graded document at most; it meets
    the sizes, not the texts. quality: a weight from docs' own columns instead.
    """
    slim = stored(sized(docs, ["doc_id", "source"], seed, quality), "mix-sizes")
    slim = stored(keyed(slim, grades), "mix")
    return decided(slim, planned(slim, weights, share, most))


def mixed_documents(docs: DataFrame, *, quality: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: docs' rows as often as it takes them, a partial copy with its first words, joined by one space.
    quality: a weight from docs' own columns; every row then finds its decision by itself and no text is shuffled but
    those of the edge bins."""
    slim = stored(keyed(sized(docs, ["doc_id", "source"], seed, quality)), "mix")
    plan = planned(slim, weights, share, most)
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("_row"), "doc_id", "text", "source")  # whatever the other columns are called
    rows = decided(keyed(sized(packed, packed.columns, seed, quality)), plan)
    copies = (F.col("epochs") + (F.col("part") > 0).cast("long")).cast("int")
    rows = rows.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    whole = (F.col("copy") <= F.col("epochs")) | (F.col("part") == F.col("size"))
    text = F.when(whole, F.col("text")).otherwise(words).alias("text")
    return rows.select(*[text if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
