"""Corpus cases in YAML: scalars, block scalars, lists of maps and flow lists, as the corpora use them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EVENTS = "path string, case_id string, domain string, seed long, place long, type string, timestamp string, payload string, ground_truth string"


def scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" else text


def flow(text: str) -> list[str]:
    """[a, "b, c", d]"""
    inside = text.strip()[1:-1]
    return [scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", inside)]


def parse(text: str) -> dict:
    """Top-level scalars, and for each top-level list its items: maps, or strings. Blank lines and comments between entries
    are passed over; in a block scalar they belong to it."""
    lines, out, at = text.split("\n"), {}, 0
    indent = lambda line: len(line) - len(line.lstrip(" "))

    def block(base: int, fold: bool) -> str:
        nonlocal at
        kept: list[str] = []
        while at < len(lines) and (not lines[at].strip() or indent(lines[at]) > base):
            kept.append(lines[at])
            at += 1
        while kept and not kept[-1].strip():
            kept.pop()
        own = min((indent(k) for k in kept if k.strip()), default=0)
        return (" " if fold else "\n").join(k[own:] for k in kept)

    def value(rest: str, base: int) -> object:
        rest = rest.strip()
        if rest[:1] in ("|", ">"):
            return block(base, rest[0] == ">")
        return flow(rest) if rest.startswith("[") else scalar(rest)

    key, items = "", None
    while at < len(lines):
        line = lines[at]
        at += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        name, colon, rest = line.strip().removeprefix("- ").partition(":")
        if indent(line) == 0 and not line.startswith("- "):
            key, items = name, None
            if rest.strip():
                out[key] = value(rest, 0)
            continue
        if line.strip().startswith("- "):
            if items is None:
                items = out.setdefault(key, [])
            if colon and re.fullmatch(r"\w+", name):
                items.append({name: value(rest, indent(line) + 2)})
            else:
                items.append(scalar(line.strip()[2:]))
        elif items and isinstance(items[-1], dict) and colon:
            items[-1][name] = value(rest, indent(line))
    return out


def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, value) of whole files -> their events."""
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["value"]):
            case = parse(text)
            truth = ",".join(x for x in case.get("ground_truth", []) if isinstance(x, str))
            for place, e in enumerate(case.get("trajectory", [])):
                rows.append((path, case.get("case_id"), case.get("domain"), int(case.get("seed") or 0), place, e.get("type"), e.get("timestamp"), e.get("payload"), truth))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The events of all cases under a path, a file each."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS path", "value").mapInPandas(events, EVENTS)
