"""A corpus pipeline of five stages: language, near copies, personal data, mix, sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes what it returns
as Parquet to the shared folder and reads it again as the next one's docs. All but the last return the columns of documents,
and any further columns that docs has, whatever they are called. An empty table gives an empty result in every stage. A text is
one value, however long: it is scanned, fingerprinted, cut and tokenized whole. What nulls, ties and repeated rows do is said
at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, packing, pii, simhash
from palimpsest.llm.common import dropped, small_batches, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null, empty, or no letter); the others carry the predicted one. A null doc_id is an
    identity like any other, a null label is not learned from; equal rows get equal languages, a tie the first by name."""
    small_batches(spark)
    names = ("_palimpsest_lang", "_palimpsest_score", "_palimpsest_family")
    found = langid.predict(docs, langid.train(docs), docs.columns, names)
    return found.filter(F.col(names[0]) != langid.UNKNOWN).withColumn("lang", F.col(names[0])).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, and what chains of such pairs
    connect. The smallest doc_id stays, rows without one come last, ties go by the text's digest; of rows that are equal in
    both one stays. Null and empty texts are copies of each other."""
    small_batches(spark)
    return simhash.representatives(docs, width=5, similarity=0.8).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data. A null text stays null; equal rows stay equal; n_chars follows the text."""
    return pii.replace(docs, "palimpsest").withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, weighted by their share of letters. A null source is a source of
    its own; texts without words have the size 0 and are not taken beyond whole epochs; equal keys go by doc_id and size."""
    mixed = mixing.mixed_documents(docs, quality=mixing.letters())
    return mixed.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens. A null text is one separator; equal rows are packed each by
    itself; pieces of equal length are placed in order of doc_id and piece."""
    import public_tokenizers

    small_batches(spark)
    # workers that go on to other stages keep nothing
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=1 << 16, keep=False)


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mix", mix), ("sequences", sequences)]

#: Regular expressions, fingerprints and a tokenizer that SQL does not have: tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)  # the next stages read what this one wrote
        before = docs
    return docs
