import pytest

from palimpsest.operators import capability as C

PIN = ", ".join(f"{p} string" for p in C.PINNED)
BLOCKS = f"token string, parent string, expires long, {PIN}"
REQUESTS = "request_id int, token string, at long, " + ", ".join(f"requested_{p} string" for p in C.PINNED)
GOOD = ("read", "decider", "r", "t", "h")


@pytest.fixture(scope="module")
def blocks(spark):
    root, free = ("root", None, None, *[None] * 5), [None] * 5
    rows = [root, ("a", "root", 100, "read", None, None, None, None), ("b", "a", 200, None, "decider", "r", None, None), ("c", "b", None, *free[:3], "t", "h"), ("orphan", "nobody", None, *free), ("loop", "loop", None, *free), (None, None, None, *free)]
    rows += [(f"n{k}", f"n{k - 1}" if k else None, None, *free) for k in range(C.DEPTH + 2)]
    return spark.createDataFrame(rows, BLOCKS)


def verdicts(spark, blocks, requests, revoked=()):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(requests)], REQUESTS)
    gone = spark.createDataFrame([(h,) for h in revoked], "handoff_id string")
    return [(r.verdict, r.links) for r in sorted(C.authorised(df, blocks, gone).collect(), key=lambda r: r.request_id)]


def test_every_refusal_and_its_order(spark, blocks):
    bad = lambda k, v="x": tuple(v if i == k else g for i, g in enumerate(GOOD))
    requests = [("c", 50, *GOOD), *[("c", 50, *bad(k)) for k in range(5)], ("c", 100, *GOOD), ("c", 500, "write", *GOOD[1:]), ("orphan", 1, *GOOD), ("unknown", 1, *GOOD), (None, 1, *GOOD), ("c", 1, *bad(3, None)), ("root", 10**6, "write", "any", "x", "y", "z"), ("b", 50, "read", "decider", "r", "other", "other")]
    assert verdicts(spark, blocks, requests) == [("granted", 4), *[(p, 4) for p in C.PINNED], ("expired", 4), ("action", 4), ("signature", 1), ("signature", 0), ("malformed", 0), ("malformed", 0), ("granted", 1), ("granted", 3)]
    assert verdicts(spark, blocks, [("c", 50, "write", *GOOD[1:]), ("orphan", 1, *GOOD)], ["h", "h"]) == [("revoked", 4), ("signature", 1)]


def test_chains_end(spark, blocks):
    free = ("a", "b", "c", "d", "e")
    assert verdicts(spark, blocks, [("loop", 1, *free), (f"n{C.DEPTH - 1}", 1, *free), (f"n{C.DEPTH}", 1, *free)]) == [("signature", C.DEPTH), ("granted", C.DEPTH), ("signature", C.DEPTH)]


def test_empty_tables(spark, blocks):
    assert verdicts(spark, blocks, []) == [] and verdicts(spark, blocks.limit(0), [("c", 1, *GOOD)]) == [("signature", 0)]
