"""Prompts word by word, and the repair loop with runners that behave in known ways."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import projection as P

CONFIG = P.Config("s1", "{}", "m1", budget=200, max_log=1000, attempts=2)
LOG = "session_id string, event_index long, type string, payload string"
DIRECTIVES = "session_id string, correction_id string, correction_index long, scope string, directive_index int, facts array<string>, replacements array<string>, correction_text string"


@pytest.fixture(scope="module")
def log(spark):
    rows = [(s, 0, "user", "The sky is green") for s in "abcdefg"] + [(s, 1, "user", "blue then") for s in "abc"] + [("h", 0, "user", "x" * 2000)]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def directives(spark):
    rows = [("a", "c1", 1, "global", 0, ["GREEN", ""], ["blue"], "it is blue"), ("a", "", 2, "prior_events", 1, [], [], ""), *[(s, "c2", 1, "global", 0, ["green", "red"], [], None) for s in "bcdefg"]]
    return spark.createDataFrame(rows, DIRECTIVES)


def test_prompt_is_word_for_word(log, directives):
    rows = {r.session_id: r for r in P.prompts(log, directives, ["session_id"], CONFIG).collect()}
    want = (
        P.PREAMBLE + "[SCHEMA ID]\ns1\n\n[TASK SCHEMA]\n{}\n\n[MEMORY BUDGET]\n200 characters\n\n" + P.BOUNDARY + P.CORRECTIONS
        + "- correction_id: c1\n  correction_event: [2]\n  scope: global\n  correction_text: it is blue\n  invalidated_facts:\n    - GREEN\n  replacement_facts:\n    - blue\n"
        + "- correction_id: unknown\n  correction_event: [3]\n  scope: prior_events\n  invalidated_facts:\n    - none declared\n  replacement_facts:\n    - none declared\n"
        + P.RULES + "[EVENT LOG]\n[1] user: The sky is green\n[2] user: blue then\n\n" + P.EXPECTED + P.UNFENCED
    )
    assert rows["a"].prompt == want and rows["a"].facts == ["GREEN"] and rows["a"].error is None
    assert rows["h"].prompt is None and rows["h"].error == "log too large: 2010 > 1000 bytes" and rows["h"].block == ""


def answers(facts):
    return json.dumps({"Facts": [f"{f} [1]" for f in facts], "Reasoning": [], "Compliance": []})


def test_only_failing_sessions_are_asked_again(spark, log, directives):
    """The runner's answers by session and attempt; what it was asked is recorded in the answer's place."""
    table = {
        "a": [answers(["blue"])], "b": [answers(["Green", "red"]), answers(["red"]), answers(["ok"])], "c": [answers(["green"])] * 3, "d": [answers(["green"]), "no json"],
        "e": ['{"Facts": ["green [0]"], "Reasoning": [], "Compliance": []}'], "f": [answers(["y" * 300])], "g": [answers(["red"]), answers(["fine"])],
    }
    asked = []

    def runner(rows):
        got = rows.collect()
        asked.append({r.session_id: r.prompt for r in got})
        said = [(r.session_id, r.attempt, table[r.session_id][r.attempt]) for r in got]
        return rows.drop("prompt").join(spark.createDataFrame(said, "session_id string, attempt int, raw string"), ["session_id", "attempt"])

    out = {r.session_id: r for r in P.project(log, directives, runner, ["session_id"], CONFIG).collect()}
    assert {s: (r.status, r.attempts) for s, r in out.items()} == {"a": ("accepted", 0), "b": ("repaired", 2), "c": ("refused", 2), "d": ("error", 1), "e": ("error", 0), "f": ("error", 0), "g": ("repaired", 1), "h": ("error", 0)}
    assert [set(a) for a in asked] == [set("abcdefg"), set("bcdg"), set("bc")]
    assert out["b"].memory == '{"Facts":["ok [1]"],"Reasoning":[],"Compliance":[]}' and out["c"].memory is None and out["c"].hits == ["green"]
    assert out["e"].error == "item in Facts is not cited" and out["f"].error.startswith("over budget") and out["d"].error == "not a JSON object"
    first = asked[1]["b"]
    assert first.startswith(P.REPAIR + P.CORRECTIONS) and "[FORBIDDEN SUBSTRINGS]\n- green\n- red\n\n[PREVIOUS PROJECTION]\n" + '{"Facts":["Green [1]","red [1]"],' in first and first.endswith(P.REPAIRED)


@pytest.mark.parametrize(
    ("raw", "error"),
    [("", "not a JSON object"), ("[]", "not a JSON object"), ("{", "not a JSON object"), ('"x"', "not a JSON object"), ('{"Facts":[],"Reasoning":[]}', "field Compliance is missing"), ('{"Facts":{},"Reasoning":[],"Compliance":[]}', "field Facts must be an array"),
     ('{"Facts":["a"],"Reasoning":[],"Compliance":[]}', "item in Facts is not cited"), ('{"Facts":["a [0]"],"Reasoning":[],"Compliance":[]}', "item in Facts is not cited"), (' {"Facts": ["a [10]"], "Reasoning":[], "Compliance":[]} ', None)],
)
def test_answers_are_checked(spark, raw, error):
    [r] = P.checked(spark.createDataFrame([(raw, ["zz"])], "raw string, facts array<string>"), CONFIG).collect()
    assert r.error == error and (r.canonical is None) == (error is not None) and r.hits == []


def test_wrong_settings_are_errors():
    for bad in ({"model_id": ""}, {"schema_id": ""}, {"schema_json": ""}, {"schema_json": "{"}, {"budget": 0}):
        with pytest.raises(ValueError):
            P.Config(**({"schema_id": "s", "schema_json": "{}", "model_id": "m"} | bad))


def test_an_empty_log(spark, directives):
    assert P.project(spark.createDataFrame([], LOG), directives, P.stand_in, ["session_id"], CONFIG).count() == 0


def test_stand_in_repairs_one_fact_a_time(spark):
    prompt = P.repair_prompt(F.lit(""), F.array(F.lit("red"), F.lit("green")), F.lit('{"Facts":["red green [1]"]}'))
    [r] = P.stand_in(spark.range(1).select(prompt.alias("prompt"))).collect()
    assert r.raw == '{"Facts":["unknown green [1]"]}'
