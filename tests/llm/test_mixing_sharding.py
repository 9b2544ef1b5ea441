import zlib
from collections import defaultdict

from compare import same
from conftest import WORD

from palimpsest.llm import mixing, queries, sharding


def test_mixing_matches_sql(spark, sf, duck):
    assert same(queries.op1_mixing(spark, sf), duck, queries.OP1_SQL)


def check_mix(rows, sizes):
    """By source: target within twice the size, taken words equal to it, no document over twice its own."""
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r.taken <= 2 * r.size and r.taken == r.epochs * r.size + r.part
        s = by[r.source]
        s[0] += r.size
        s[1] += r.taken
        s[2] = r.target
    total = sum(s[0] for s in by.values())
    assert total == sizes
    for size, taken, target in by.values():
        assert target <= 2 * size + 1e-6 and taken == int(target)
    assert abs(sum(s[2] for s in by.values()) - 1.5 * total) < 1e-6 * max(1, total)


def test_mixing_odd_rows(odd, odd_rows, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows)
    check_mix(rows, sum(len(WORD.findall(r[1] or "")) for r in odd_rows))
    assert mixing.mix(none).count() == 0
    again = mixing.mix(odd.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_a_source_without_words(spark):
    rows = [(1, "a b c d", "a"), (2, None, "empty"), (3, " ", "empty"), (4, "x y", None), (5, "", "blank")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.source_size, r.target, r.taken) for r in mixing.mix(df).collect()}
    assert got[2] == got[3] == got[5] == (0, 0.0, 0) and got[1][2] + got[4][2] == 9
    assert sorted(r.doc_id for r in mixing.mixed_documents(df).collect() if r.doc_id in (2, 3, 5)) == []
    assert all(r.taken == 0 for r in mixing.mix(df.filter("doc_id IN (2, 3, 5)")).collect())


def test_resharing_until_none_is_above(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.allocate(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    assert got == {"a": 20.0, None: 10.0, "b": 1.5 * 1015 - 30}


def test_mixed_documents_repeat_and_cut(odd, odd_rows):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    target = {r.source: int(r.target) for r in mixing.mix(odd).collect()}
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in target.items() if n}


def check_shards(rows, source, shards):
    assert len(rows) == len(source)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in source)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == want
    return {s: sum(r.size for r in part) for s, part in by.items()}


def test_sharding(docs, texts):
    rows = sharding.shard(docs).collect()
    sums = check_shards(rows, list(texts.items()), 16)
    most = max(r.size for r in rows)
    mean = sum(sums.values()) / 16
    assert all(abs(sums.get(s, 0) - mean) <= most + 0.01 * mean for s in range(16))


def test_groups_stay_whole(docs, spark):
    """Groups of copies of up to a shard are in one shard each, and sizes stay near equal."""
    rows = [(100 * g + i, f"group {g} " * (5 + g)) for g in range(40) for i in range(3 * g)] + [(10_000 + i, f"text {i} " * 20) for i in range(2000)]
    for df, near in ((docs, None), (spark.createDataFrame(rows, "doc_id long, text string"), 0.02)):
        out = sharding.shard(df).collect()
        sums, of, size = defaultdict(int), defaultdict(set), defaultdict(int)
        for r in out:
            sums[r.shard] += r.size
            of[r.group_md5].add(r.shard)
            size[r.group_md5] += r.size
        mean = sum(sums.values()) / 16
        assert all(len(of[g]) == 1 for g in of if size[g] <= mean)
        assert near is None or all(abs(v - mean) <= near * mean + 200 for v in sums.values())


def test_overfull_ranges_are_split(spark, monkeypatch):
    """Few keys drawn, one text in most rows: ranges end up small, and the result does not depend on them."""
    rows = [(i, "same words " * 20) for i in range(2000)] + [(5000 + i, f"text {i} " * 20) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = lambda r: (r.doc_id, r.shard, r.slot)
    want = sorted(map(key, sharding.shard(df).collect()))
    monkeypatch.setattr(sharding, "RANGES", 40)
    monkeypatch.setattr(sharding, "DRAWN", 2)
    assert sorted((d, s) for d, s, _ in map(key, sharding.shard(df).collect())) == [(d, s) for d, s, _ in want]


def test_sharding_splits_one_hot_text(spark):
    rows = [(i, "same words " * 20) for i in range(3000)] + [(5000 + i, f"text {i} " * 20) for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sums = check_shards(out, rows, 16)
    mean = sum(sums.values()) / 16
    assert len(sums) == 16 and all(abs(v - mean) < 0.02 * mean + 400 for v in sums.values())


def test_sharding_odd_rows(odd, odd_rows, none):
    check_shards(sharding.shard(odd, 4).collect(), [(r[0], r[1]) for r in odd_rows], 4)
    assert sharding.shard(none).count() == 0
