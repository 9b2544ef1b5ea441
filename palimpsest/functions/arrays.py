"""Sequence and vector functions over arrays, all built of higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST = -3.4028234663852886e38
EPSILON = 1e-9


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once, not for every element of a lambda that names it."""
    return F.transform(F.array(value), use)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def argmax(x: Column) -> Column:
    """Place, from 0, of the first greatest value."""
    return F.array_position(x, F.array_max(x)) - 1


def top_k(x: Column, k: int) -> Column:
    """Places of the k greatest values, ties by place."""
    pairs = F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Stable; a temperature of 0 is floored."""
    t = max(temperature, EPSILON)

    def shares(e: Column) -> Column:
        return let(total(e), lambda s: F.transform(e, lambda v: v / s))

    return let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp((v - m) / F.lit(t))), shares))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.ln(total(F.transform(x, lambda v: F.exp(v - m)))))


def nucleus(p: Column, mass: float) -> Column:
    """How many of the descending probabilities reach the mass."""
    state = F.aggregate(p, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, v: F.when(a["s"] >= mass, a).otherwise(F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n"))))
    return state["n"]


def smoothed(x: Column, coefficient: float) -> Column:
    """Exponential smoothing, forward."""
    first = F.struct(x[0].alias("y"), F.array(x[0]).alias("out"))

    def step(a: Column, v: Column) -> Column:
        y = F.lit(coefficient) * v + F.lit(1 - coefficient) * a["y"]
        return F.struct(y.alias("y"), F.concat(a["out"], F.array(y)).alias("out"))

    return F.aggregate(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), first, step)["out"]


def stop_detector(tokens: Column, stop: list[int]) -> Column:
    """Tokens read when the stop sequence first completes, -1 if never. On a mismatch the match restarts at 0 or 1,
    so a sequence that overlaps itself can be missed, as in the detector this mirrors."""
    want = F.array(*[F.lit(s) for s in stop])
    zero = F.struct(F.lit(0).alias("m"), F.lit(0).alias("n"), F.lit(-1).alias("hit"))

    def step(a: Column, t: Column) -> Column:
        m = F.when(F.element_at(want, a["m"] + 1) == t, a["m"] + 1).when(F.lit(stop[0]) == t, 1).otherwise(0)
        n = a["n"] + 1
        done = a["hit"] >= 0
        full = ~done & (m == len(stop))
        return F.struct(F.when(full | done, 0).otherwise(m).cast("int").alias("m"), n.cast("int").alias("n"), F.when(full, n).otherwise(a["hit"]).cast("int").alias("hit"))

    return F.aggregate(tokens, zero, step)["hit"]


def quantised(x: Column) -> Column:
    """Int8 by the largest magnitude: struct of scale and values, rounded to even."""
    scale = F.array_max(F.transform(x, lambda v: F.abs(v))) / 127.0
    return F.struct(scale.alias("scale"), F.transform(x, lambda v: F.when(scale == 0, 0).otherwise(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(v / scale)))).cast("int")).alias("q"))


def agreed(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    differs = F.transform(F.arrays_zip(a.alias("l"), b.alias("r")), lambda p: F.coalesce(p["l"] != p["r"], F.lit(True)))
    at = F.array_position(differs, True)
    return F.when(at > 0, at - 1).otherwise(F.size(differs)).cast("int")
