"""What a user can register: model adapters, memory agents by condition, tools, constraints. All work on DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.state import rolling_summary
from . import evidence, runner


class Registry[T]:
    """Named entries; a name is taken once, an unknown one is an error that tells the known ones."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.entries: dict[str, T] = {}

    def add(self, name: str, entry: T) -> T:
        if not name or name in self.entries:
            raise ValueError(f"{self.kind} {name!r} is registered already, or has no name")
        self.entries[name] = entry
        return entry

    def get(self, name: str) -> T:
        if name not in self.entries:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self.entries)}")
        return self.entries[name]


#: (prompts with a column prompt, purpose, most characters) -> prompts with output.
Adapter = Callable[[DataFrame, str, int], DataFrame]
#: (log, directives, budget) -> session_id, memory, calls.
Agent = Callable[[DataFrame, DataFrame, int], DataFrame]

ADAPTERS: Registry[Adapter] = Registry("adapter")
AGENTS: Registry[Agent] = Registry("agent")


def _first_characters(prompts: DataFrame, purpose: str, most: int) -> DataFrame:
    """The deterministic stand-in: the prompt's first characters."""
    return prompts.withColumn("output", F.substring("prompt", 1, most))


ADAPTERS.add("stand_in", _first_characters)


def raw(log: DataFrame, directives: DataFrame, budget: int) -> DataFrame:
    """The whole log, whatever the budget; one call."""
    return log.groupBy("session_id").agg(F.expr("listagg(payload, '\n') WITHIN GROUP (ORDER BY event_index)").alias("memory"), F.lit(1).cast("long").alias("calls"))


def rolling(log: DataFrame, directives: DataFrame, budget: int) -> DataFrame:
    """A summary that is folded once a chunk, and the decision's call."""
    return rolling_summary(log, budget).select("session_id", F.col("summary").alias("memory"), (F.col("calls") + 1).alias("calls"))


def checkpoint(log: DataFrame, directives: DataFrame, budget: int) -> DataFrame:
    """A projection of the active evidence and the decision's call."""
    view = evidence.active_view(log, directives, ["session_id"])
    return runner.project(view, budget).select("session_id", "memory", F.lit(2).cast("long").alias("calls"))


def hybrid(log: DataFrame, directives: DataFrame, budget: int) -> DataFrame:
    """The rolling summary, unless it holds an invalidated fact: then the projection, at the calls of both."""
    facts = directives if "facts" in directives.columns else directives.withColumn("facts", F.array("fact"))
    facts = facts.select("session_id", F.explode("facts").alias("fact")).filter("fact <> ''").groupBy("session_id").agg(F.collect_list(F.lower("fact")).alias("facts"))
    both = rolling(log, directives, budget).join(facts, "session_id", "left").join(checkpoint(log, directives, budget).select("session_id", F.col("memory").alias("projected")), "session_id", "left")
    both = both.withColumn("stale", F.coalesce(F.exists("facts", lambda f: F.contains(F.lower("memory"), f)), F.lit(False)))
    chosen = F.when(F.col("stale"), F.coalesce("projected", F.lit(""))).otherwise(F.col("memory"))
    return both.select("session_id", chosen.alias("memory"), F.when(F.col("stale"), F.col("calls") + 1).otherwise(F.col("calls")).alias("calls"))


for _name, _agent in (("raw_oracle", raw), ("rolling_summary", rolling), ("dpm_phase3_checkpoint", checkpoint), ("rolling_summary_plus_dpm_gate", hybrid)):
    AGENTS.add(_name, _agent)


@dataclass(frozen=True)
class Tool:
    """A name, a schema of its arguments (DDL), and what it computes from a struct of them."""

    name: str
    schema: str
    execute: Callable[[Column], Column]


@dataclass
class Toolbox:
    tools: Registry[Tool] = field(default_factory=lambda: Registry("tool"))

    def run(self, calls: DataFrame) -> DataFrame:
        """calls (name, arguments as JSON) with result (text) and error: unknown_tool, bad_arguments, or null."""
        result, bad = F.lit(None).cast("string"), F.lit(False)
        for t in self.tools.entries.values():
            args = F.from_json("arguments", t.schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
            broken = args.isNull() | args["_bad"].isNotNull()
            result = F.when((F.col("name") == t.name) & ~broken, t.execute(args).cast("string")).otherwise(result)
            bad = F.when(F.col("name") == t.name, broken).otherwise(bad)
        known = F.col("name").isin(list(self.tools.entries))
        return calls.withColumn("result", result).withColumn("error", F.when(~known, "unknown_tool").when(bad, "bad_arguments"))


@dataclass(frozen=True)
class Constraint:
    """An automaton over token ids: what each state allows and where it leads; a match ends in one of ends."""

    start: int
    steps: dict[tuple[int, int], int]
    ends: frozenset[int]

    def allowed(self, state: int) -> list[int]:
        return sorted(t for s, t in self.steps if s == state)

    def run(self, tokens: Column) -> Column:
        """struct(state, accepted, ended, restarts): a token that the state does not allow stops the run; after an end the next
        token starts anew."""
        table = F.create_map(*[F.lit(x) for (s, t), to in self.steps.items() for x in (f"{s}:{t}", to)])
        ends = F.array(*[F.lit(e) for e in sorted(self.ends)])
        zero = F.struct(F.lit(self.start).alias("state"), F.lit(0).alias("accepted"), F.lit(0).alias("restarts"), F.lit(False).alias("dead"))

        def step(a: Column, t: Column) -> Column:
            over = F.array_contains(ends, a["state"])
            at = F.when(over, self.start).otherwise(a["state"])
            to = F.try_element_at(table, F.concat_ws(":", at.cast("string"), t.cast("string")))
            moved = F.struct(to.alias("state"), (a["accepted"] + 1).alias("accepted"), (a["restarts"] + over.cast("int")).alias("restarts"), F.lit(False).alias("dead"))
            stopped = F.struct(a["state"].alias("state"), a["accepted"].alias("accepted"), a["restarts"].alias("restarts"), F.lit(True).alias("dead"))
            return F.when(a["dead"] | to.isNull(), stopped).otherwise(moved)

        return F.aggregate(tokens, zero, step, lambda a: F.struct(a["state"].alias("state"), a["accepted"].alias("accepted"), a["restarts"].alias("restarts"), F.array_contains(ends, a["state"]).alias("ended")))
