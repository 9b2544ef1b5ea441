"""The engine's commands, and file sources and sinks."""

import pytest

from palimpsest.engine import Engine
from palimpsest.functions import protocol
from palimpsest.sources import files

BATCH = "tenant_id string, session_id string, seq long, type string, payload string, timestamp_us long, tool_call_id string"


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"))
    e.init()
    return e


def batch(spark, *rows):
    return spark.createDataFrame([("t", s, i, k, p, 1000 + i, None) for i, (s, k, p) in enumerate(rows)], BATCH)


def test_record_correct_prompt(spark, engine):
    assert engine.record(batch(spark, ("s", "user", "The sky is Blue"), ("s", "tool", "lookup"), ("z", "user", "hi"))) == 3
    assert engine.record(batch(spark, ("s", "correction", '{"correction_id":"c1","invalidated_facts":["blue"]}'), ("s", "model", "blue again"))) == 2
    status = {r.session_id: r for r in engine.status().collect()}
    assert (status["s"].events, status["s"].corrections, status["z"].events) == (4, 1, 1)
    rows = {r.event_index: r for r in engine.events().filter("session_id = 's'").collect()}
    assert sorted(rows) == [0, 1, 2, 3] and rows[1].tool_call_id == "tool-2" and rows[3].step_index == 4
    prompt = engine.prompt().filter("session_id = 's'").first().rendered.split("\n")
    assert prompt[0].startswith("[1] internal: REVOKED_BY_CORRECTION: this event contained 1 invalidated fact(s)") and "correction_id(s): c1. " in prompt[0] and prompt[3] == "[4] model: blue again"
    assert engine.events(since=2).count() == 2 and engine.events(most=1).count() == 2
    assert engine.memory(200).count() == 2


def test_corrections_of_several_facts(spark, engine):
    engine.record(batch(spark, ("s", "user", "Blue sky and green sea"), ("s", "user", "nothing")))
    schema = "tenant_id string, session_id string, correction_id string, invalidated_facts array<string>, replacement_facts array<string>, scope string, timestamp_us long"
    rows = [("t", "s", "c1", ["green", " Blue ", ""], ["red"], "global", 5), ("t", "s", "c2", ["SKY"], None, "prior_events", 6)]
    assert engine.correct(spark.createDataFrame(rows, schema)) == 2
    first = engine.view().filter("event_index = 0").first()
    assert first.revoked_by == "c1,c2" and first.revoked_facts == ["green", "Blue", "SKY"] and "contained 3 invalidated" in first.payload
    assert engine.view().filter("revoked_by IS NOT NULL").count() == 1
    with pytest.raises(ValueError):
        engine.correct(spark.createDataFrame([("t", "s", "c3", [" "], None, "global", 7)], schema))


def test_refuses(spark, engine):
    for row in (("a/b", "user", "x"), ("s", "user", ""), ("s", "other", "x")):
        with pytest.raises(ValueError):
            engine.record(batch(spark, row))


def test_verify_tells_what_changed(spark, engine):
    engine.record(batch(spark, ("s", "user", "one"), ("z", "user", "two")))
    bundles = engine.handoff().collect()
    frame = spark.createDataFrame(bundles, engine.handoff().schema)
    assert engine.verify(frame).filter("NOT verified").count() == 0
    engine.record(batch(spark, ("s", "user", "three")))
    got = {r.session_id: r.failed for r in engine.verify(frame).collect()}
    assert got == {"s": "trace_digest_match,event_count_match,event_range_match", "z": ""}


def test_project_and_audit(spark, engine, tmp_path):
    from palimpsest import catalog  # noqa: F401  plans import each other through it
    from palimpsest.operators import projection, replay, stores
    from palimpsest.plans.composites import _BOUND

    engine.record(batch(spark, ("s", "user", "The sky is Blue"), ("s", "user", "the rest"), ("z", "user", "hi"), ("s", "correction", '{"correction_id":"c1","invalidated_facts":["blue"]}'), ("z", "correction", '{"replacement_facts":["x"]}')))
    config = projection.Config("s1", "{}", "m1", attempts=2)
    found = {r.session_id: r for r in engine.project(projection.stand_in, config).collect()}
    # the stand-in repeats a correction's own words until it is asked not to, and the correction event keeps its fact
    assert found["s"].status == "repaired" and found["s"].attempts == 1 and "blue" not in found["s"].memory.lower() and found["z"].status == "accepted"
    by = replay.Auditor(config, "ab" * 32, "auditor", "v1")
    store, ledger, dag = stores.CheckpointStore(spark, str(tmp_path / "c")), stores.AuditLedger(spark, str(tmp_path / "l")), stores.ProvenanceStore(spark, str(tmp_path / "d"))
    made = replay.replayed(spark.createDataFrame([("h", "s", 0, 2)], "hash string, session_id string, range_start long, range_end long"), engine.log().drop("tenant_id"), projection.stand_in, config).first().replay
    rows = spark.createDataFrame([("s", 0, 2, made, 1), ("s", 0, 1, made, 2), ("s", 1, 9, made, 3)], "session_id string, range_start long, range_end long, body string, created_us long")
    bound = {n: v for n, v in _BOUND.items() if n != "kv_dtype"}
    store.put(rows.selectExpr("*", "'t' AS tenant_id", "0 AS level", "0 AS kv_dtype", "CAST(array() AS ARRAY<STRING>) AS parent_hashes", *[f"{v} AS {n}" for n, v in bound.items()]))
    audit = engine.audit(store, ledger, dag, projection.stand_in, by)
    assert sorted(str(r.verdict or r.error) for r in audit.results.collect()) == ["correction_emitted", "event range", "pass"]
    assert sorted(r.verdict for r in ledger.latest().collect()) == ["correction_emitted", "pass"] and dag.nodes.rows().count() == 2


def test_binary_logs(spark, tmp_path):
    good = protocol.framed([b'{"type":"user","tenant_id":"t","session_id":"s","payload":"x","timestamp_us":1}', b"not json"])
    (tmp_path / "a.log").write_bytes(good)
    (tmp_path / "b.log").write_bytes(good[:-2])
    rows = files.read_events(spark, str(tmp_path / "*.log")).collect()
    a = {r.event_index: r for r in rows if r.path.endswith("a.log")}
    assert a[0].payload == "x" and a[0].bad is None and a[1].bad == "not json"
    assert [r.error for r in rows if r.path.endswith("b.log") and r.error] == ["truncated record"]


def test_result_lines(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "schema_version int, mock boolean, score double"
    files.write_json_lines(spark.createDataFrame([(1, False, 0.5), (1, False, None)], schema), path)
    assert files.read_results(spark, path, schema).count() == 2
    assert files.markdown(files.read_results(spark, path, schema).orderBy("score")).count("\n") == 4
    files.write_json_lines(spark.createDataFrame([(1, True, 0.5)], schema), path)
    with pytest.raises(ValueError):
        files.read_results(spark, path, schema)


def test_corpus_files(spark, tmp_path):
    from palimpsest.sources import corpus

    (tmp_path / "a.yaml").write_text("case_id: x\nprobes:\n  - name: p\ntrajectory:\n  # one\n  - type: user\n    payload: >\n      two\n      lines\n\n  - type: tool\n    payload: |\n      kept\n        deeper\n\n      after\nground_truth:\n  - first\n  - 'second'\n")
    rows = sorted(corpus.read_corpus(spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert [(r.type, r.payload) for r in rows] == [("user", "two lines"), ("tool", "kept\n  deeper\n\nafter")]
    assert rows[0].case_id == "x" and rows[0].ground_truth == "first,second" and rows[0].seed == 0
