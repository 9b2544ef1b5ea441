import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import same

from palimpsest.llm import queries, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    """rows (doc_id, text) -> (word, form, root, n, n_near, form_n)."""
    count = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    cuts = defaultdict(set)
    for w in count:
        for k in range(len(w)):
            cuts[w[:k] + w[k + 1 :]].add(w)
    friends = {w: {x for k in range(len(w)) for r in [w[:k] + w[k + 1 :]] for x in cuts[r] | ({r} & count.keys())} | cuts[w] for w in count}
    friends = {w: [x for x in xs if near(w, x)] for w, xs in friends.items()}
    form = {}
    for w, xs in friends.items():
        best = min(xs, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(friends[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_equals_its_sql_and_brute_force(spark, sf, duck, texts):
    rows = same(queries.op13_variants(spark, sf), duck, queries.ORACLE["op13_variants"])
    want = brute(texts.items())
    assert got(queries.op13_variants(spark, sf)) == want and len(rows) == len(want)
    assert any(w[1] for w in want)  # not vacuous


def words(seed, n, letters="abcéÉx×"):
    """Texts of few letters, so that near words, ties and chains are many."""
    rng = random.Random(seed)
    roots = ["".join(rng.choices(letters, k=rng.randrange(7, 11))) for _ in range(n)]
    out = []
    for i, w in enumerate(roots):
        near_one = w[:3] + rng.choice(letters) + w[4:]
        out.append((i, f"{(w + ' ') * rng.choice([1, 2, 30])}{near_one.upper()} {near_one}; {w[:-1]} {w[:-1]} {w}a {w}a"))
    chain = [("abcdefgh", 500), ("abcdefg", 45), ("abcdefx", 4), ("abcdexx", 40)]
    return out + [(None, None), (10**6, " ".join((w + " ") * n for w, n in chain)), (2**62, "a" * 300 + " " + "a" * 300 + " " + "a" * 301 + " " + "a" * 301)]


@pytest.mark.parametrize(("count", "split"), [(6, 16_384), (2, 40), (1, 25)])
def test_brute_force_with_split_cells(spark, count, split):
    rows = words(count, 400)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert got(variants.group(df, count=count, split=split)) == want
    assert {w[0]: w[2] for w in want}.get("abcdefx") == "abcdefgh" or len(want) > 100


def test_odd_rows(spark, odd, odd_rows, none):
    assert got(variants.group(odd)) == brute([(r[0], r[1]) for r in odd_rows])
    assert variants.group(none).count() == 0


def test_counts_are_sent_on_in_parts(spark, monkeypatch, docs, texts):
    assert {(r.word, r.n) for r in variants.vocabulary(docs).collect()} == {(w[0], w[3]) for w in brute(texts.items())}


def test_left_out_letters():
    rng = random.Random(3)
    for _ in range(2000):
        a = "".join(rng.choices("ab", k=5))
        b = "".join(rng.choices("ab", k=6))
        m = lambda s: np.frombuffer(s.encode(), np.uint8).reshape(1, -1)
        assert variants.left_out(m(a), m(b))[0] == near(a, b)
