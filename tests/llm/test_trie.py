import hashlib
import zlib
from collections import defaultdict

import pytest
from compare import same

from palimpsest.llm import queries, trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def beginnings(own, rebuild):
    """conv_id -> its turns as rebuilt."""
    if not rebuild:
        return own
    out = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        out[c] = (own.get(int(c / 100) * 100, [])[:h] if c is not None else []) + turns[h:]
    return out


def brute(rows, rebuild=True):
    """rows (conv_id, turn, role, text) -> node rows, by walking prefixes."""
    own = defaultdict(list)
    by_hash = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    for c, *r in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, by_hash(r[1:]))):
        own[c].append(tuple(r[1:]))
    paths = beginnings(own, rebuild)
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    low = lambda cs: min((c for c in cs if c is not None), default=None)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    joined = lambda cs: ",".join("" if c is None else str(c) for c in sorted(cs, key=lambda c: (c is not None, c or 0)))
    return sorted(((low(m), len(p), low(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(joined(ends[p]).encode()).hexdigest()) for p, m in members.items()), key=repr)


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def test_query_equals_its_sql_and_brute_force(spark, sf, duck):
    rows = same(queries.op12_trie(spark, sf), duck, queries.ORACLE["op12_trie"])
    want = brute(duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    assert got(queries.op12_trie(spark, sf)) == want and len(rows) == len(want)
    assert max(w[3] for w in want if w[1]) > 1


SCHEMA = "conv_id long, turn long, role string, text string, block int, d1 long, at int, level int"


@pytest.mark.parametrize("rebuild", [True, False])
def test_deep_shared_and_odd_conversations(spark, rebuild):
    """Beginnings longer than several blocks, exact copies, one text within another, nulls, ties, repeats, negative numbers."""
    long = [(k, "user" if k % 2 == 0 else "assistant", f"turn {k} ü") for k in range(3 * trie.WIDTH + 3)]
    rows = [(c, *t) for c in (1, 2, 3, 4, 100, 205) for t in long[: {1: 27, 2: 24, 3: 16, 4: 27, 100: 8, 205: 20}[c]]]
    rows += [(2, 90, "user", "other"), (3, 90, "user", "other"), (3, 91, None, None), (7, None, None, None), (7, None, "user", "first"), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, 1, "user", "b")]
    rows += [(None, 0, "user", "turn 0 ü"), (None, 1, "x", ""), (-5, 0, "user", "turn 0 ü"), (0, 0, "user", "turn 0 ü"), (9, 0, "us", "er"), (10, 0, "use", "r"), (2**62 + 1, 0, "user", "turn 0 ü")]
    rows += [(c, 0, "user", "one turn") for c in range(300, 330)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    want = brute(rows, rebuild)
    assert got(trie.trie(df, rebuild=rebuild)) == want


def test_turnless_conversations_and_an_empty_table(spark):
    """A conversation that loses all its turns to an absent beginning is a member of the root, and ends there."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    df = spark.createDataFrame([(c, 0, "user", "gone", 0, 0, 0, 0)], SCHEMA)
    assert got(trie.trie(df)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 40)
    df = spark.range(500).selectExpr("id AS conv_id", "id % 2 AS d1", "0L AS d2")
    found = {r.d1: r.ends_sha256 for r in trie.end_digests(df).collect()}
    assert found == {k: hashlib.sha256(",".join(str(c) for c in range(k, 500, 2)).encode()).hexdigest() for k in (0, 1)}
