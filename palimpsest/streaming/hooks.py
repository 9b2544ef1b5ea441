"""The hook loop of an agent: session start, prompts, tool calls before and after, compaction, stop.

What a hook says depends on the corrections that its session has registered so far. Everything that needs the message alone
(whether it corrects, which facts, what a tool call holds, whether it decides something) comes as columns that Catalyst computes;
``Gate`` is a session's state and step. The streaming operator keeps it between triggers, so a restart goes on where it was; the
batch twin folds it over a session's events as they stream, sorted, through a task.

Events: session_id, seq, hook, corrects, correction_id, invalidated, replacements, text, boundary. A correction that comes again takes
the place of the first. Only corrections with invalidated facts block. Unknown hooks answer nothing. Nulls: a null text holds no
fact, a null list is empty, a null flag is false.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many corrections a context names, and how many compactions a state remembers.
NAMED, REMEMBERED = 3, 20
COLUMNS = ["session_id", "seq", "hook", "corrects", "correction_id", "invalidated", "replacements", "text", "boundary"]
SCHEMA = "session_id string, seq long, action string, hits string, context string, active int, compactions int"


@dataclass
class Gate:
    corrections: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    compactions: int = 0

    def active(self) -> list[tuple[list[str], list[str]]]:
        return [c for c in self.corrections.values() if c[0]]

    def context(self) -> str:
        """What the last corrections invalidate and what to use instead, a line each."""
        said = lambda label, facts: [f"{label}: " + "; ".join(f"`{f}`" for f in facts)] if facts else []
        return "\n".join(line for old, new in self.active()[-NAMED:] for line in said("Invalidated", old) + said("Use instead", new))

    def hits(self, text: str) -> list[str]:
        """Invalidated facts that the text holds, distinct whatever their case."""
        low, out = text.lower(), {}
        for facts, _ in self.active():
            for f in facts:
                if f.lower() in low:
                    out.setdefault(f.lower(), f)
        return list(out.values())

    def step(self, hook: str, corrects: bool, correction_id: str, invalidated: list[str], replacements: list[str], text: str, boundary: bool) -> tuple[str, str, str]:
        """The action, the facts that denied it, and the context that goes with it."""
        if hook == "UserPromptSubmit" and corrects:
            action = "refreshed" if correction_id in self.corrections else "registered"
            self.corrections[correction_id] = (list(invalidated), list(replacements))
            return action, "", self.context()
        if hook in ("SessionStart", "UserPromptSubmit"):
            return "context", "", self.context()
        if hook in ("PreToolUse", "PermissionRequest"):
            hits = self.hits(text)
            if hits:
                return "deny", ", ".join(hits), ""
            return ("allow", "", self.context()) if self.active() and boundary else ("none", "", "")
        if hook in ("PostToolUse", "PostToolBatch"):
            return ("context", "", self.context()) if self.active() else ("none", "", "")
        if hook == "PreCompact":
            self.compactions = min(REMEMBERED, self.compactions + 1)
            return "checkpoint", "", ""
        if hook in ("Stop", "SessionEnd"):
            return ("context", "", self.context()) if self.active() else ("current", "", "")
        return "none", "", ""

    def saved(self) -> tuple[str, int]:
        return json.dumps(list(self.corrections.items())), self.compactions

    @classmethod
    def restored(cls, saved: tuple[str, int]) -> Gate:
        return cls({k: (v[0], v[1]) for k, v in json.loads(saved[0])}, saved[1])

    def row(self, session: str, seq: int, event: tuple) -> tuple:
        """The answer to an event, its columns from hook on."""
        return (session, seq, *self.step(*event), len(self.active()), self.compactions)


def _event(r: tuple) -> tuple:
    hook, corrects, correction_id, invalidated, replacements, text, boundary = r
    return hook or "", bool(corrects), correction_id or "", [] if invalidated is None else list(invalidated), [] if replacements is None else list(replacements), text or "", bool(boundary)


def hook_stream(events: DataFrame) -> DataFrame:
    """events, a session's in order of seq within and between batches -> SCHEMA."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        gate = Gate.restored(state.get) if state.exists else Gate()
        rows = [gate.row(key[0], int(r[1]), _event(r[2:])) for r in pd.concat(list(batches)).sort_values("seq")[COLUMNS].itertuples(index=False)]
        state.update(gate.saved())
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return events.select(*COLUMNS).groupBy("session_id").applyInPandasWithState(run, SCHEMA, "corrections string, compactions int", "append", "NoTimeout")


def answered(events: DataFrame) -> DataFrame:
    """The batch twin."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        sent = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])
        for session, group in groupby(rows, key=lambda r: r[0]):
            gate = Gate()
            for r in group:
                out.append(gate.row(session, r[1], _event(r[2:])))
                if len(out) == 4096:
                    yield sent()
                    out.clear()
        if out:
            yield sent()

    return events.select(*COLUMNS).repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, SCHEMA)


def barred(decisions: DataFrame, blocked: DataFrame) -> DataFrame:
    """decisions (checkpoint_hash, ...), a stream or a table, with must_interrupt, must_reproject and reason; blocked is the static
    index of corrections by checkpoint (operators.audit.blocked). A join with the index, so each batch sees the decisions it has."""
    index = blocked.select(F.col("hash").alias("checkpoint_hash"), "blocking", "interrupt")
    joined = decisions.join(index, "checkpoint_hash", "left")
    stands = F.coalesce(F.col("blocking") > 0, F.lit(False))
    reason = F.when(stands, "blocking correction requires fresh projection").otherwise("no blocking correction for active checkpoint")
    return joined.withColumns({"must_interrupt": stands & F.coalesce("interrupt", F.lit(False)), "must_reproject": stands, "reason": reason}).drop("blocking", "interrupt")
