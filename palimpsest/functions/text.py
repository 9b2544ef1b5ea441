"""Text functions: case folding, containment, clipping, estimates, extraction."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

REVOKED = "[REVOKED_BY_DPM_GATE]"


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only; the log's folding, unlike lower()."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_contains(text: Column, fact: Column) -> Column:
    return F.contains(ascii_lower(text), ascii_lower(fact))


def folded_contains(text: Column, fact: Column) -> Column:
    """Unicode folding; the scorers' containment."""
    return F.contains(F.lower(text), F.lower(fact))


def cited(text: Column) -> Column:
    """Contains a citation [n] with n >= 1."""
    return text.rlike(r"\[[0-9]*[1-9][0-9]*\]")


def distinct_folded(items: Column) -> Column:
    """Items in order, without those that an earlier one equals but for case."""
    folded = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def clip(text: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(suffix)), F.lit(suffix))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """0 for the empty text, else at least 1: a quarter of the length, rounded up."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int")))


def stripped_contains(text: Column, needle: Column) -> Column:
    """Case-insensitive containment without white space."""
    return F.contains(F.lower(F.regexp_replace(text, r"\s", "")), F.lower(F.regexp_replace(needle, r"\s", "")))


def numeric_contains(text: Column, needle: Column) -> Column:
    """Containment of digits and dots only; an empty needle is never contained."""
    n = F.regexp_replace(needle, "[^0-9.]", "")
    return (n != "") & F.contains(F.regexp_replace(text, "[^0-9.]", ""), n)


def sanitised(text: Column, fallback: str = "default") -> Column:
    """An identity component: other characters become -, leading dots go."""
    s = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]", "-"), r"^\.+", "")
    return F.when(s == "", fallback).otherwise(s)


def valid_identity(c: Column) -> Column:
    """May be a path component."""
    return F.coalesce((F.length(c) > 0) & ~c.isin(".", "..") & ~c.rlike(r'[/\\"<>:|?*\x00-\x1f]'), F.lit(False))


def cut_at_stop(text: Column, stops: list[str]) -> Column:
    """Up to the first of the stop strings."""
    places = [F.nullif(F.locate(s, text), F.lit(0)) for s in stops]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first.isNotNull(), F.substr(text, F.lit(1), first - 1)).otherwise(text)


def overlap(left: Column, right: Column, most: int) -> Column:
    """The longest suffix of left that is a prefix of right, up to most characters."""
    sizes = F.sequence(F.lit(1), F.lit(most))
    hit = F.filter(sizes, lambda n: (n <= F.length(left)) & (n <= F.length(right)) & (F.substr(left, F.length(left) - n + 1, n) == F.substr(right, F.lit(1), n)))
    return F.coalesce(F.array_max(hit), F.lit(0))
