"""Registries, agents, tools and constraints."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import plugins as P


def test_names_are_taken_once():
    r = P.Registry("thing")
    r.add("a", 1)
    for bad in ("a", ""):
        with pytest.raises(ValueError):
            r.add(bad, 2)
    with pytest.raises(KeyError, match="there are \\['a'\\]"):
        r.get("b")


def test_adapter_and_tools(spark):
    out = P.ADAPTERS.get("stand_in")(spark.createDataFrame([("hello",)], "prompt string"), "project", 3)
    assert out.first().output == "hel"
    box = P.Toolbox()
    box.tools.add("add", P.Tool("add", "a LONG, b LONG", lambda x: x["a"] + x["b"]))
    box.tools.add("shout", P.Tool("shout", "text STRING", lambda x: F.upper(x["text"])))
    rows = [("add", '{"a":2,"b":3}'), ("shout", '{"text":"hi"}'), ("add", "{"), ("no", "{}")]
    got = [(r.name, r.result, r.error) for r in box.run(spark.createDataFrame(rows, "name string, arguments string")).collect()]
    assert got == [("add", "5", None), ("shout", "HI", None), ("add", None, "bad_arguments"), ("no", None, "unknown_tool")]


def test_constraint_steps_and_restarts(spark):
    """a b* c, again and again."""
    c = P.Constraint(0, {(0, 1): 1, (1, 2): 1, (1, 3): 2}, frozenset({2}))
    assert c.allowed(1) == [2, 3]
    rows = [([1, 2, 2, 3],), ([1, 3, 1, 3],), ([1, 3, 2],), ([2],), ([],)]
    got = [tuple(r.r) for r in spark.createDataFrame(rows, "t array<int>").select(c.run(F.col("t")).alias("r")).collect()]
    assert got == [(2, 4, 0, True), (2, 4, 1, True), (2, 2, 0, True), (0, 0, 0, False), (0, 0, 0, False)]
