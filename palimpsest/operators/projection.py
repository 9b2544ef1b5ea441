"""Projection of logs into memories: prompts, canonical answers, a bounded repair loop, and refusal.

A runner turns prompts into raw answers, one DataFrame into another; the engine knows nothing else of it. ``project`` asks once for
each session, checks the answers, and asks again only for those in which a corrected fact still stands, at most so often; each round
is a written table, so a lost executor costs a round's tasks. A session ends as accepted, repaired, refused (a fact stands after the
last round) or error (the log is too large, or an answer is no cited JSON within the budget), and only the first two have a memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import evidence as V
from . import eventlog as L
from .shared import written

#: (keys, prompt, attempt) -> the same rows with raw, the answer, in place of prompt; attempt is 0 for the first question.
Runner = Callable[[DataFrame], DataFrame]

# The words of prompts.
PREAMBLE = (
    "System. You are producing a decision-ready memory view over an event log for task T. Preserve every dollar amount, date, identifier, and policy limit verbatim. "
    "Cite the event index for each claim. Do not paraphrase numeric anchors. Output three sections in fixed order.\n\n"
    "Instructions:\n"
    "1. Facts (F): Extract specific anchors. If a required field is not derivable from the log, emit unknown.\n"
    "2. Reasoning (R): State the inferential steps taken so far based only on the log.\n"
    "3. Compliance (C): Note any regulatory provisions cited in the events.\n"
    "Constraints: Output MUST be valid JSON with fields Facts, Reasoning, and Compliance. Temperature 0.0. Reference every fact by its one-based Event Index [i] in the log. "
    "Treat correction events as superseding earlier conflicting facts.\n\n"
)
BOUNDARY = "[DPM PROJECTION PREFIX BOUNDARY v1]\n"
CORRECTIONS = (
    "[BLOCKING CORRECTIONS]\n"
    "The checkpoint gate refused stale memory. Apply every correction below before producing the projection. Suppress invalidated facts exactly; prefer replacement facts when provided; "
    "if a conflict remains, emit unknown instead of the old fact.\n"
)
RULES = "Rules: do not include invalidated facts in Facts, Reasoning, Compliance, or any decider-facing memory. Keep one-based event citations for replacement facts.\n\n"
EXPECTED = '[EXPECTED OUTPUT]\nReturn only a valid JSON object in this exact shape:\n{"Facts":["... [i]"],"Reasoning":["... [i]"],"Compliance":["... [i]"]}\n'
UNFENCED = "Do not wrap the JSON in markdown or code fences. The first output byte must be '{' and the last output byte must be '}'.\n"
REPAIR = (
    "System. CORRECTION REPAIR for DPM projected memory.\n"
    "The previous projection violated blocking correction directives. Remove the forbidden facts listed below while preserving valid JSON, one-based citations, and all non-conflicting replacement facts.\n\n"
)
REPAIRED = "The corrected JSON must not contain any forbidden substring.\n"
FIELDS = ("Facts", "Reasoning", "Compliance")


@dataclass(frozen=True)
class Config:
    schema_id: str
    schema_json: str
    model_id: str
    budget: int = 1338
    max_log: int = 0
    attempts: int = 1

    def __post_init__(self) -> None:
        if not self.model_id:
            raise ValueError("a projection requires a pinned model_id")
        if not self.schema_id or not self.schema_json:
            raise ValueError("a projection requires a schema_id and a task schema")
        json.loads(self.schema_json)
        if self.budget <= 0:
            raise ValueError("a projection requires a memory budget")

    @property
    def prefix(self) -> str:
        """What all prompts of a schema and budget begin with, so that it can be cached."""
        return f"{PREAMBLE}[SCHEMA ID]\n{self.schema_id}\n\n[TASK SCHEMA]\n{self.schema_json}\n\n[MEMORY BUDGET]\n{self.budget} characters\n\n{BOUNDARY}"


def correction_blocks(directives: DataFrame, keys: list[str]) -> DataFrame:
    """directives (correction_id, correction_index, scope, facts, replacements, correction_text, directive_index) -> keys, block,
    and facts, all distinct ones that are not empty, in order."""

    def listed(label: str, facts: str) -> Column:
        lines = F.transform(F.filter(F.col(facts), lambda f: f != ""), lambda f: F.concat(F.lit("    - "), f, F.lit("\n")))
        return F.concat(F.lit(f"  {label}:\n"), F.when(F.size(lines) > 0, F.array_join(lines, "")).otherwise("    - none declared\n"))

    said = F.coalesce("correction_text", F.lit(""))
    entry = F.concat(
        F.lit("- correction_id: "), F.when(F.coalesce("correction_id", F.lit("")) == "", "unknown").otherwise(F.col("correction_id")), F.lit("\n  correction_event: ["), (F.col("correction_index") + 1).cast("string"), F.lit("]\n  scope: "), F.col("scope"), F.lit("\n"),
        F.when(said != "", F.concat(F.lit("  correction_text: "), said, F.lit("\n"))).otherwise(""), listed("invalidated_facts", "facts"), listed("replacement_facts", "replacements"),
    )
    rows = directives.select(*keys, F.struct("directive_index", entry.alias("entry"), F.filter("facts", lambda f: f != "").alias("facts")).alias("d"))
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("d")).alias("ds"))  # a session's directives are few
    return held.select(*keys, F.concat(F.lit(CORRECTIONS), F.array_join(F.transform("ds", lambda d: d["entry"]), ""), F.lit(RULES)).alias("block"), F.array_distinct(F.flatten(F.transform("ds", lambda d: d["facts"]))).alias("facts"))


def prompts(view: DataFrame, directives: DataFrame | None, keys: list[str], config: Config) -> DataFrame:
    """view, a log or its active evidence -> keys, prompt, block, facts, error; a log over max_log bytes is an error, not cut."""
    logs = L.render(view, F.concat("type", F.lit(": "), "payload"), keys)
    blocks = logs.withColumns({"block": F.lit(""), "facts": F.array().cast("array<string>")}) if directives is None else logs.join(correction_blocks(directives, keys), keys, "left")
    rows = blocks.withColumn("block", F.coalesce("block", F.lit("")))
    size = F.octet_length("rendered")
    error = F.when((size > config.max_log) & F.lit(config.max_log > 0), F.concat(F.lit("log too large: "), size.cast("string"), F.lit(f" > {config.max_log} bytes")))
    prompt = F.concat(F.lit(config.prefix), "block", F.lit("[EVENT LOG]\n"), "rendered", F.lit("\n\n" + EXPECTED + UNFENCED))
    return rows.select(*keys, F.when(error.isNull(), prompt).alias("prompt"), "block", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"), error.alias("error"))


def repair_prompt(block: Column, forbidden: Column, previous: Column) -> Column:
    return F.concat(F.lit(REPAIR), block, F.lit("[FORBIDDEN SUBSTRINGS]\n- "), F.array_join(forbidden, "\n- "), F.lit("\n\n[PREVIOUS PROJECTION]\n"), previous, F.lit("\n\n" + EXPECTED + REPAIRED))


def decider_prompt(memory: Column, case_id: Column, options: str) -> Column:
    return F.concat(F.lit("Given the following Projected Memory M, provide a final verdict for Case ID "), case_id, F.lit(f".\nDecision options: {options}.\nBase the decision strictly on Facts and Compliance.\n\n[PROJECTED MEMORY]\n"), memory, F.lit("\n"))


def checked(answers: DataFrame, config: Config) -> DataFrame:
    """answers (raw, facts, ...) with canonical, error and hits, the facts that still stand.

    Valid is a JSON object with the three lists, each item cited, within the budget once it is written canonically."""
    parsed = F.from_json("raw", ", ".join(f"{f} STRING" for f in FIELDS))
    lists = F.from_json("raw", ", ".join(f"{f} ARRAY<STRING>" for f in FIELDS))
    rows = answers.withColumn("_as_text", parsed).withColumn("_lists", lists)
    no_object = F.col("_as_text").isNull() | ~F.try_parse_json("raw").isNotNull() | ~F.trim("raw").startswith("{")
    missing = F.coalesce(*[F.when(F.col(f"_as_text.{f}").isNull(), f"field {f} is missing") for f in FIELDS])
    no_list = F.coalesce(*[F.when(~F.startswith(F.col(f"_as_text.{f}"), F.lit("[")), f"field {f} must be an array") for f in FIELDS])
    uncited = F.coalesce(*[F.when(F.exists(f"_lists.{f}", lambda x: ~F.coalesce(T.cited(x), F.lit(False))), f"item in {f} is not cited") for f in FIELDS])
    canonical = F.to_json("_lists")
    too_large = F.when(F.octet_length(canonical) > config.budget, F.concat(F.lit("over budget: "), F.octet_length(canonical).cast("string"), F.lit(f" > {config.budget} bytes")))
    error = F.coalesce(F.when(no_object, "not a JSON object"), missing, no_list, uncited, too_large)
    rows = rows.withColumn("error", error).withColumn("canonical", F.when(error.isNull(), canonical))
    hits = F.filter("facts", lambda f: F.contains(T.ascii_lower(F.col("canonical")), T.ascii_lower(f)))
    return rows.withColumn("hits", F.coalesce(hits, F.array().cast("array<string>"))).drop("_as_text", "_lists", "raw")


def project(log: DataFrame, directives: DataFrame, runner: Runner, keys: list[str], config: Config) -> DataFrame:
    """keys, status, attempts (repairs asked for), memory, error, hits."""
    asked = written(prompts(V.active_view(log, directives, keys), directives, keys, config).withColumn("attempt", F.lit(0)), "prompts")
    columns = [*keys, "block", "facts", "attempt", "error", "canonical", "hits"]
    now = written(checked(runner(asked.filter("error IS NULL").drop("error")), config).select(*columns), "answers")
    rounds, open_ = [now], F.expr("error IS NULL AND size(hits) > 0")
    for attempt in range(1, config.attempts + 1):
        failing = now.filter(open_)
        if not failing.limit(1).count():
            break
        again = failing.select(*keys, repair_prompt(F.col("block"), F.col("hits"), F.col("canonical")).alias("prompt"), "block", "facts", F.lit(attempt).alias("attempt"))
        now = written(checked(runner(again), config).select(*columns), "answers")
        rounds.append(now)
    # a session's rows of the rounds: those before the last failed and went on
    ended = [r.filter(~open_) for r in rounds[:-1]] + [rounds[-1]]
    found = ended[0]
    for r in ended[1:]:
        found = found.unionByName(r)
    status = F.when(F.col("error").isNotNull(), "error").when(F.size("hits") > 0, "refused").when(F.col("attempt") > 0, "repaired").otherwise("accepted")
    ends = found.select(*keys, status.alias("status"), F.col("attempt").alias("attempts"), F.when(status.isin("accepted", "repaired"), F.col("canonical")).alias("memory"), "error", "hits")
    large = asked.filter("error IS NOT NULL").select(*keys, F.lit("error").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("memory"), "error", F.array().cast("array<string>").alias("hits"))
    return ends.unionByName(large)


def stand_in(rows: DataFrame) -> DataFrame:
    """A deterministic runner. First it cites the first line of three events each and says which corrections it applied, in their
    words, forbidden or not; asked to repair, it takes away one forbidden substring."""
    prompt = F.col("prompt")
    section = lambda head, end: F.substring_index(F.regexp_replace(prompt, rf"(?s)^.*?\n\[{head}\]\n", ""), end, 1)
    lines = F.filter(F.split(section("EVENT LOG", "\n\n[EXPECTED OUTPUT]"), "\n"), lambda x: x.rlike(r"^\[\d+\] \w+: "))
    facts = F.transform(F.slice(lines, 1, 3), lambda x: F.concat(F.regexp_replace(x, r"^\[\d+\] \w+: ", "").substr(1, 40), F.lit(" "), F.regexp_extract(x, r"^\[\d+\]", 0)))
    applied = F.transform(F.regexp_extract_all(prompt, F.lit(r"(?m)^    - (.+)$"), F.lit(1)), lambda x: F.concat(F.lit("applied "), x, F.lit(" [1]")))
    first = F.to_json(F.struct(facts.alias("Facts"), F.filter(applied, lambda x: x != "applied none declared [1]").alias("Reasoning"), F.array().cast("array<string>").alias("Compliance")))
    forbidden = F.substring_index(section("FORBIDDEN SUBSTRINGS", "\n"), "- ", -1)
    repaired = F.replace(section("PREVIOUS PROJECTION", "\n\n[EXPECTED OUTPUT]"), forbidden, F.lit("unknown"))
    return rows.withColumn("raw", F.when(prompt.startswith(REPAIR), repaired).otherwise(first)).drop("prompt")
