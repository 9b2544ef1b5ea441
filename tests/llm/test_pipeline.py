import corpus_pipeline
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, simhash
from palimpsest.llm.common import stored


def test_stages(spark, sf, docs):
    """Each stage's decisions on its own input, against plain recomputation."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "personal_data", "mix", "sequences"]
    now, outs = docs, []
    for _, f in corpus_pipeline.STAGES:
        now = stored(f(spark, now, sf), "test")
        outs.append(now)
    for out in outs[:-1]:
        assert out.columns == docs.columns
    language, unique, clean, mixed, placed = outs
    letters = {r.doc_id for r in docs.collect() if langid.has_letter(r.text)}
    assert {r.doc_id for r in language.collect()} == letters
    assert unique.count() == unique.select("text").distinct().count()  # exact copies went
    kept = {r.doc_id: r.text for r in unique.collect()}
    assert kept.keys() == smallest({r.doc_id: r.text for r in language.collect()}, 0.8)
    assert clean.count() == unique.count() and clean.filter("text LIKE '%@mail%example.com%'").count() == 0
    target = {r.source: int(r.target) for r in mixing.mix(clean, quality=mixing.letters()).collect()}
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert got == {s: n for s, n in target.items() if n}
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert placed.filter("piece = 0").count() == mixed.count()


def test_stages_on_odd_rows(spark, sf, odd, odd_rows, none):
    """Nulls, long and empty texts, repeated rows, clashing columns; every stage by itself, and an empty table."""
    clash = odd.withColumnsRenamed({"score": "lang_pred", "fp": "family", "bin": "copy", "rid": "taken", "key": "node"}) if "key" in odd.columns else odd
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, sf).count() == 0, name
        out = f(spark, clash, sf)
        rows = out.collect()
        assert name == "sequences" or out.columns == clash.columns, name
        texts = [r[1] for r in odd_rows]
        if name == "language":
            assert sorted(r.size for r in rows) == [i for i, t in enumerate(texts) if langid.has_letter(t)] and all(r.lang for r in rows)
        if name == "near_copies":
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 1, 5, 6, 7, 9, 10, 11, 12] and all(r.doc_id is not None for r in rows)  # those without an id are copies of 0 and 1
        if name == "personal_data":
            assert len(rows) == len(odd_rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        if name == "sequences":
            assert sum(r.piece == 0 for r in rows) == len(odd_rows)


def smallest(texts, similarity):
    """The smallest id of each component of texts whose sets of five-word shingles are so similar."""
    words = {d: t.encode().lower().split() for d, t in texts.items()}
    sets = {d: {*zip(*(w[k:] for k in range(5)))} or {tuple(w)} for d, w in words.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {find(d) for d in sets}


def test_near_copies_keep_any_columns(spark, sf, docs):
    named = docs.withColumn("_palimpsest_kept", F.lit("own")).withColumn("_palimpsest_kept_", F.lit("too"))
    out = corpus_pipeline.near_copies(spark, named, sf)
    assert out.columns == named.columns and {tuple(r)[-2:] for r in out.collect()} == {("own", "too")}


def test_workers_hold_little_after_sequences(spark, sf, docs):
    """The workers that run on for other stages hold no tokenizer, and texts come to them in small batches."""

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    def held(batches):
        import pyarrow as pa

        from palimpsest.llm import packing

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len([k for k in packing._encoders if k[1] == 1 << 16])])], names=["n"])

    assert corpus_pipeline.sequences(spark, docs, sf).count() > 0
    assert {r.n for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()} == {0}
    assert max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()) <= 1000


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_bits_follow_similarity():
    assert simhash.bits_for(0.8, 256) < simhash.bits_for(0.7, 256) < 128
