import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from palimpsest.llm import blocks, shingles, simhash, substring, suffix

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_substring(rows, window):
    """(text) of each row -> (words, removed, digest), in order of rows."""
    ws = [WORDS.findall((t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in ws for k in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, ws):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((str(d), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def brute_suffix(rows, length):
    """rows in order."""
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(s)
        out.append((str(d), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 40_000)


def test_substring_matches_brute_force(docs, texts, small_blocks):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(docs).collect())
    want = brute_substring(list(texts.items()), substring.WINDOW)
    assert got == want and sum(w[2] for w in want) > 0


def test_substring_odd_rows(odd, odd_rows, none):
    got = substring.deduplicate(odd, texts=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring([(r[0], r[1]) for r in odd_rows], substring.WINDOW)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring.deduplicate(none).count() == 0


def test_cover_has_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_suffix_matches_brute_force(docs, texts, small_blocks):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicate(docs).collect())
    want = brute_suffix(sorted(texts.items()), suffix.LENGTH)
    assert got == want and sum(w[2] for w in want) > 0


def test_suffix_odd_rows(odd, odd_rows, none):
    """Null ids first; the repeated rows have equal texts, so their order does not matter."""
    rows = sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, -xxhash64_of(r[1])))
    options = [brute_suffix(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, s * len(r[1] or ""))), suffix.LENGTH) for s in (1, -1)]
    got = suffix.deduplicate(odd, texts=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) in options
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert suffix.deduplicate(none).count() == 0


def xxhash64_of(t):
    return xxhash.xxh64_intdigest((t or "").encode(), 42)


def test_periodic_and_long_texts(spark, monkeypatch):
    """Runs of one byte, periods, and documents cut into parts."""
    monkeypatch.setattr(suffix, "SLICE", 700)
    rng = np.random.default_rng(3)
    noise = "".join(map(chr, rng.integers(97, 123, 3000)))
    rows = [(0, "a" * 500), (1, "ab" * 300), (2, noise), (3, noise[500:1700] + "x" + noise[1700:]), (4, "a" * 150), (5, noise[:99]), (6, noise[:100]), (7, "é" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicate(df).collect())
    assert got == brute_suffix(rows, suffix.LENGTH)


def brute_components(x, limit):
    near = np.bitwise_count(x[:, None, :] ^ x[None, :, :]).sum(-1) <= limit
    a, b = np.nonzero(np.triu(near, 1))
    return simhash.components(len(x), a, b)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(rows, source):
    """component: the smallest doc_id among the nodes reachable; null only if none has one."""
    fp = [brute_fingerprint(t or "") for _, t in source]
    label = brute_components(np.array(fp, dtype=np.uint64)[:, None], 3)
    least: dict = {}
    for (d, _), g in zip(source, label):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = sorted((str(d), f"{f:016x}", str(least.get(g))) for (d, _), f, g in zip(source, fp, label))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_simhash_matches_brute_force(docs, texts):
    check_simhash(simhash.near_duplicates(docs).collect(), list(texts.items()))


def test_simhash_odd_rows(odd, odd_rows, none):
    check_simhash(simhash.near_duplicates(odd).collect(), [(r[0], r[1]) for r in odd_rows])
    assert simhash.near_duplicates(none).count() == 0


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)
    chain, parts = base.copy(), [base]
    for _ in range(12):
        chain = chain ^ flip() ^ flip()
        parts.append(chain)
    return np.concatenate([*parts, rng.integers(0, 2**64, 400, dtype=np.uint64)])[:, None]


@pytest.mark.parametrize("matrix", [1, 10_000])
def test_leaf_keeps_components(cloud, matrix, monkeypatch):
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    a, b = simhash.linked(cloud, 3)
    assert np.array_equal(simhash.components(len(cloud), a, b), brute_components(cloud, 3))
    assert len(a) < 3 * len(cloud)


@pytest.mark.parametrize(("blocks_", "keep", "radius"), [(1, 1, 3), (2, 1, 1), (4, 1, 0), (5, 2, 0), (6, 3, 0)])
def test_forest_loses_no_link(cloud, blocks_, keep, radius):
    """Also where queries enter boundary-overlapping shards (radius above 0)."""
    masks, r = simhash.equal_parts(64, 3, blocks_, keep)
    assert r == radius
    left, right = [], []
    for m in masks:
        tree = simhash.Tree(cloud[:300], m, 64, r)
        rows, leaf = tree.routed(cloud)
        assert np.array_equal(np.unique(rows), np.arange(len(cloud))) and (len(rows) > len(cloud)) == (r > 0)
        assert 8 < len(np.unique(leaf)) <= 64 and len(tree.points) < 63  # the deeper levels have random points
        for x in np.unique(leaf):
            at = np.flatnonzero(leaf == x)
            at = at[np.argsort(rows[at])]
            a, b = simhash.linked(cloud[rows[at]], 3)
            left.append(rows[at][a])
            right.append(rows[at][b])
    assert np.array_equal(simhash.components(len(cloud), np.concatenate(left), np.concatenate(right)), brute_components(cloud, 3))


def test_overfull_leaves_are_split(spark, cloud, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 40)
    monkeypatch.setattr(simhash, "LEAF", 10_000)
    nodes = spark.createDataFrame([(i, bytearray(int(v).to_bytes(8, "little"))) for i, v in enumerate(cloud[:, 0])], "node long, fp binary")
    masks, radius = simhash.equal_parts(64, 3, 2)
    edges = simhash.links(nodes, limit=3, masks=masks, radius=radius).collect()
    label = simhash.components(len(cloud), np.array([e.a for e in edges]), np.array([e.b for e in edges]))
    assert np.array_equal(label, brute_components(cloud, 3))


def test_long_chain_spreads(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "a long, b long")
    got = {r.node: r.label for r in simhash.spread(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_representatives_keep_one_of_near_copies(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    base = [word() for _ in range(300)]
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for k in range(2, 12):
        w = list(base)
        for at in rng.integers(0, 300, 4):
            w[at] = word()
        rows.append((k, " ".join(w)))
    clean = [(100 + k, " ".join(word() for _ in range(200))) for k in range(40)]
    df = spark.createDataFrame(rows + clean + [(None, None), (None, "")], "doc_id long, text string")
    kept = [r.doc_id for r in simhash.representatives(df).collect()]
    assert sorted(k for k in kept if k is not None) == [0, *(c[0] for c in clean)] and kept.count(None) == 1


def test_near_copies_go_from_exactly_the_similarity_on(spark):
    """Pairs of 90 five-word shingles each: 80 in common are 80 of 100, 79 are 79 of 101."""
    rows = []
    for k in range(120):
        shared = 80 if k < 60 else 79
        first = [f"w{k}x{i}" for i in range(94)]
        second = first[: shared + 4] + [f"v{k}x{i}" for i in range(90 - shared)]
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.representatives(df).collect())
    assert kept == [d for d in range(240) if d % 2 == 0 or d >= 120]


@pytest.mark.parametrize(("chunk", "nodes"), [(1 << 20, 4096), (500, 4096), (1 << 20, 3)])
def test_near_copies_match_brute_force(spark, chunk, nodes, monkeypatch):
    """Families of edited texts around the bound that share a passage, with short, equal and empty ones."""
    monkeypatch.setattr(shingles, "CHUNK", chunk)
    monkeypatch.setattr(shingles, "NODES", nodes)
    monkeypatch.setattr(shingles, "SAMPLE", 100)
    rng = np.random.default_rng(7)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 5)))
    passage = [word() for _ in range(30)]
    rows = [(None, "a b c"), (500, None), (501, " "), (502, "a b c"), (503, "A  b c"), (504, "a b d")]
    for f in range(15):
        base = [word() for _ in range(60)] + passage + [word() for _ in range(40)]
        for k in range(12):
            w = list(base)
            for at in rng.integers(0, len(w), k // 3):
                w[at] = word()
            rows.append((20 * f + k, " ".join(w[: len(w) - int(rng.integers(0, 20))])))
    sets = [set(shingles.shingles((t or "").encode(), 5).tolist()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = simhash.components(len(rows), *np.array(pairs).T)
    expected = [min((rows[i][0] for i in np.flatnonzero(label == c) if rows[i][0] is not None), default=None) for c in np.unique(label)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [r.doc_id for r in simhash.representatives(df).collect()]
    assert sorted(got) == sorted(expected) and 30 < len(got) < 150


def test_components_of_ids_at_both_ends(spark):
    """The smallest doc_id names a component, however small or large; null only where there is no other."""
    low, high = -(2**63), 2**63 - 1
    rows = [(high, "a b c d e"), (2**62 + 5, "x y z w v"), (2**62 + 9, "x y z w v"), (low, "k l m n o"), (high - 1, "k l m n o"), (None, "q r s t u"), (None, "f g h i j"), (high - 2, "f g h i j"), (-1, ""), (None, None)]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_id = {d: c for (d, _), c in got.items() if d is not None}
    assert by_id == {high: high, 2**62 + 5: 2**62 + 5, 2**62 + 9: 2**62 + 5, low: low, high - 1: low, high - 2: high - 2, -1: -1}
    assert sorted(str(c) for (d, _), c in got.items() if d is None) == sorted(["None", str(high - 2), "-1"])
