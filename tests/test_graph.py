import pytest

from palimpsest.operators import graph


def test_deep_chains_with_diamonds(spark, monkeypatch):
    """Levels are merged on the way; shortest levels come out."""
    monkeypatch.setattr(graph, "TIER", 3)
    n = 14
    edges = [(f"n{k}", f"n{k + 1}") for k in range(n)] + [("n0", "n5"), ("n3", "n5"), ("n14", "n2"), ("x", "y")]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("a", "n0"), ("a", "n0"), ("b", "n12"), ("c", "none")], "seed string, node string")
    out = {}
    for seed, start in (("a", "n0"), ("b", "n12"), ("c", "none")):
        level, todo = {start: 0}, [start]
        for node in todo:
            for s, d in edges:
                if s == node and d not in level:
                    level[d] = level[node] + 1
                    todo.append(d)
        out |= {(seed, k): v for k, v in level.items()}
    assert {(r.seed, r.node): r.level for r in graph.reachable(df, seeds).collect()} == out
    with pytest.raises(ValueError, match="deeper"):
        graph.reachable(df, seeds, cap=3)
