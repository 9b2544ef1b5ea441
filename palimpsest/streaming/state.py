"""Stateful operators: checkpoint triggers, channel splitting, decoding, rolling summaries.

Each has a pure step function, used by the streaming operator (state kept per session by applyInPandasWithState) and by its
batch twin, a fold in order of event_index, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Precedence: handoff, correction, delta, pressure, milestone, idle."""

    max_delta: int = 200
    context: int = 1000
    ratio: float = 0.75
    min_delta: int = 60
    milestone: str = "tool"
    idle_us: int = 86_400_000_000


def trigger(policy: Policy, kind: str, payload: str, gap: int, context: int, delta: int) -> str | None:
    """context and delta, the tokens since the last checkpoint, count this event too; the context never falls."""
    if payload.startswith("signup"):
        return "handoff"
    if kind == "correction":
        return "correction"
    if delta >= policy.max_delta:
        return "max_delta"
    if context >= policy.context * policy.ratio:
        return "pressure"
    if kind == policy.milestone and delta >= policy.min_delta:
        return "milestone"
    return "idle" if gap > policy.idle_us and delta > 0 else None


def triggers(log: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """log (session_id, event_index, type, payload, tokens, timestamp_us) -> the events that trigger, with the reason and
    the tokens since the checkpoint before. A fold of Catalyst's over each session's events."""
    event = F.struct("event_index", "type", "payload", "tokens", "timestamp_us")
    start = F.expr("named_struct('context', 0L, 'delta', 0L, 'at', CAST(NULL AS BIGINT), 'out', CAST(array() AS ARRAY<STRUCT<event_index: BIGINT, reason: STRING, delta: BIGINT>>))")

    def step(a: Column, e: Column) -> Column:
        context, delta = a["context"] + e["tokens"], a["delta"] + e["tokens"]
        gap = F.coalesce(e["timestamp_us"] - a["at"], F.lit(0))
        reason = (
            F.when(e["payload"].startswith("signup"), "handoff").when(e["type"] == "correction", "correction").when(delta >= policy.max_delta, "max_delta").when(context >= policy.context * policy.ratio, "pressure")
            .when((e["type"] == policy.milestone) & (delta >= policy.min_delta), "milestone").when((gap > policy.idle_us) & (delta > 0), "idle")
        )
        hit = reason.isNotNull()
        out = F.when(hit, F.concat(a["out"], F.array(F.struct(e["event_index"].alias("event_index"), reason.alias("reason"), delta.cast("long").alias("delta"))))).otherwise(a["out"])
        return F.struct(context.cast("long").alias("context"), F.when(hit, 0).otherwise(delta).cast("long").alias("delta"), e["timestamp_us"].alias("at"), out.alias("out"))

    folded = log.groupBy("session_id").agg(F.aggregate(F.array_sort(F.collect_list(event)), start, step)["out"].alias("out"))
    return folded.select("session_id", F.inline("out"))


def trigger_stream(log: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The live twin: rows of a session arrive in order of event_index within a batch and between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        context, delta, at = state.get if state.exists else (0, 0, -1)
        rows = []
        for e in pd.concat(list(batches)).sort_values("event_index").itertuples():
            context, delta = context + int(e.tokens), delta + int(e.tokens)
            reason = trigger(policy, e.type, e.payload, 0 if at < 0 else e.timestamp_us - at, context, delta)
            at = int(e.timestamp_us)
            if reason:
                rows.append((key[0], int(e.event_index), reason, delta))
                delta = 0
        state.update((context, delta, at))
        yield pd.DataFrame(rows, columns=["session_id", "event_index", "reason", "delta"])

    return log.groupBy("session_id").applyInPandasWithState(run, "session_id string, event_index long, reason string, delta long", "context long, delta long, at long", "append", "NoTimeout")


def held_back(text: str, mark: str) -> int:
    """Length of the longest end of text that the mark begins with, short of the whole mark."""
    return next((n for n in range(min(len(text), len(mark) - 1), 0, -1) if text.endswith(mark[:n])), 0)


def split_channels(buffer: str, inside: bool, start: str, end: str, last: bool) -> tuple[list[tuple[str, str]], str, bool]:
    """What is safe to emit of the buffer, the rest, and whether the channel is open. A partial mark is held back."""
    out: list[tuple[str, str]] = []
    while True:
        mark = end if inside else start
        at = buffer.find(mark)
        where = "channel" if inside else "text"
        if at >= 0:
            out.append((where, buffer[:at]))
            buffer, inside = buffer[at + len(mark) :], not inside
            continue
        keep = 0 if last else held_back(buffer, mark)
        out.append((where, buffer[: len(buffer) - keep]))
        return [(w, t) for w, t in out if t], buffer[len(buffer) - keep :], inside


def channel_stream(pieces: DataFrame, start: str = "<think>", end: str = "</think>") -> DataFrame:
    """pieces (session_id, seq, piece, last) -> session_id, seq, channel, text, as soon as it is safe."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buffer, inside = state.get if state.exists else ("", False)
        rows = []
        for p in pd.concat(list(batches)).sort_values("seq").itertuples():
            parts, buffer, inside = split_channels(buffer + p.piece, inside, start, end, bool(p.last))
            rows += [(key[0], int(p.seq), w, t) for w, t in parts]
        state.update((buffer, inside))
        yield pd.DataFrame(rows, columns=["session_id", "seq", "channel", "text"])

    return pieces.groupBy("session_id").applyInPandasWithState(run, "session_id string, seq long, channel string, text string", "buffer string, inside boolean", "append", "NoTimeout")


def rolling_summary(log: DataFrame, budget: int = 200, size: int = 8) -> DataFrame:
    """A summary per session, refolded at each chunk of events: the last budget characters of what it was and the chunk's
    first words. A fold over chunks, which are few."""
    chunks = log.withColumn("chunk", F.expr(f"event_index div {size}")).withColumn("head", F.substring_index("payload", " ", 3))
    texts = chunks.groupBy("session_id", "chunk").agg(F.expr("listagg(head, ' ') WITHIN GROUP (ORDER BY event_index)").alias("t"))
    fold = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "t"))), lambda c: c["t"]), F.lit(""), lambda a, t: F.substring(F.concat(a, F.lit("|"), t), -budget, budget))
    return texts.groupBy("session_id").agg(fold.alias("summary"), F.count("*").alias("calls"))


def stop_stream(tokens: DataFrame, stop: list[int]) -> DataFrame:
    """tokens (session_id, seq, token), in order of seq -> the place of each session's first whole stop sequence, as soon as it
    is there. The state is how much of the sequence has matched; as with the batch twin, a mismatch restarts at 0 or 1."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        matched, seen, hit = state.get if state.exists else (0, 0, -1)
        rows = []
        for t in pd.concat(list(batches)).sort_values("seq")["token"]:
            seen += 1
            matched = matched + 1 if stop[matched] == t else int(stop[0] == t)
            if matched == len(stop):
                matched = 0
                if hit < 0:
                    hit = seen
                    rows.append((key[0], hit))
        state.update((matched, seen, hit))
        yield pd.DataFrame(rows, columns=["session_id", "hit"])

    return tokens.groupBy("session_id").applyInPandasWithState(run, "session_id string, hit long", "matched int, seen long, hit long", "append", "NoTimeout")
