"""Hook loop, barrier and append as streams: restarts and repeated deliveries change nothing."""

from collections import Counter

from pyspark.sql import functions as F

from palimpsest import catalog  # noqa: F401  plans import each other through it
from palimpsest.operators.audit import blocked
from palimpsest.plans import hooks as Q
from palimpsest.sources import adapters as A
from palimpsest.streaming import append, hooks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(spark, frame, tmp_path):
    """Drains what is there into a table; the checkpoint stays for the next call."""
    q = frame.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.read.parquet(str(tmp_path / "out"))


def test_hook_stream_goes_on_after_a_restart(spark, sf, tmp_path):
    events = Q.events(spark, sf)
    want = rows(hooks.answered(events))
    stream = lambda: hooks.hook_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    for low, high in ((0, 1), (2, 4), (5, 9)):  # a query of its own for each part
        events.filter(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run(spark, stream(), tmp_path)
    assert rows(out) == want
    assert {"context", "registered", "refreshed", "deny", "allow", "none", "checkpoint", "current"} >= {r[2] for r in want} >= {"registered", "deny", "checkpoint", "context"}


def test_a_gate_step_by_step():
    g = hooks.Gate()
    step = lambda hook, **e: g.step(hook, **({"corrects": False, "correction_id": "", "invalidated": [], "replacements": [], "text": "", "boundary": False} | e))
    assert step("PreToolUse", text="git push", boundary=True) == ("none", "", "") and step("Stop") == ("current", "", "")
    assert step("UserPromptSubmit", corrects=True, correction_id="i", replacements=["only new"]) == ("registered", "", "") and step("PostToolUse") == ("none", "", "")
    assert step("UserPromptSubmit", corrects=True, correction_id="a", invalidated=["Old One"], replacements=["new"]) == ("registered", "", "Invalidated: `Old One`\nUse instead: `new`")
    assert step("UserPromptSubmit", corrects=True, correction_id="a", invalidated=["Old One", "two"]) == ("refreshed", "", "Invalidated: `Old One`; `two`")
    assert step("PermissionRequest", text="x OLD one TWO old one") == ("deny", "Old One, two", "") and step("PreToolUse", boundary=True)[0] == "allow" and step("PreToolUse")[0] == "none"
    for k in range(5):
        step("UserPromptSubmit", corrects=True, correction_id=str(k), invalidated=[f"fact {k}"])
    assert step("SessionStart") == ("context", "", "Invalidated: `fact 2`\nInvalidated: `fact 3`\nInvalidated: `fact 4`")
    for _ in range(30):
        step("PreCompact")
    assert g.compactions == hooks.REMEMBERED and step("unknown") == ("none", "", "")
    assert hooks.Gate.restored(g.saved()) == g


def test_odd_events(spark):
    schema = "session_id string, seq long, hook string, corrects boolean, correction_id string, invalidated array<string>, replacements array<string>, text string, boundary boolean, action string"
    df = spark.createDataFrame([("s", 0, None, None, None, None, None, None, None, "x"), (None, 1, "PreToolUse", True, "a", ["f"], None, None, True, "x"), ("s", 0, "Stop", None, None, None, None, None, None, "x")], schema)
    assert Counter(r.action for r in hooks.answered(df).collect()) == {"none": 2, "current": 1}
    assert hooks.answered(df.limit(0)).count() == 0


def test_barrier_as_a_stream(spark, sf, tmp_path):
    decisions = A.ckpt(spark, sf).select(F.col("hash").alias("checkpoint_hash"), "session_id")
    static = blocked(A.checkpoint_corrections(spark, sf))
    decisions.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(spark, hooks.barred(spark.readStream.schema(decisions.schema).parquet(str(tmp_path / "in")), static), tmp_path)
    assert rows(out.select("checkpoint_hash", "must_interrupt", "must_reproject", "reason")) == rows(hooks.barred(decisions, static).select("checkpoint_hash", "must_interrupt", "must_reproject", "reason"))
    assert {(r.must_interrupt, r.must_reproject) for r in out.collect()} == {(False, False), (False, True), (True, True)} or out.filter("must_reproject").count() > 0


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    frame = lambda rs: spark.createDataFrame(rs, "session_id string, event_index long, payload string")
    one, two = frame([("a", 0, "x"), ("a", 1, "y"), ("a", 1, "y")]), frame([("a", 1, "again"), ("a", 2, "z"), ("b", 0, "w"), ("b", 0, "v")])
    append.append_batch(one, 0, path)
    append.append_batch(two, 1, path)
    want = rows(append.read_log(spark, path))
    assert want == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "v")]
    append.append_batch(two, 1, path)  # the batch failed after its write
    append.append_batch(one, 0, path)
    assert rows(append.read_log(spark, path)) == want and rows(append.read_log(spark, path, 2)) == [("a", 2, "z")]


def test_append_stream_takes_what_is_new(spark, tmp_path):
    schema, log = "session_id string, event_index long, payload string", str(tmp_path / "log")
    for low, high in ((0, 10), (5, 20), (15, 30)):
        spark.range(low, high).selectExpr("CAST(id % 3 AS STRING) AS session_id", "id AS event_index", "concat('p', id) AS payload").write.mode("append").parquet(str(tmp_path / "in"))
        append.append_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), log, str(tmp_path / "state")).awaitTermination(180)
    assert rows(append.read_log(spark, log)) == sorted(((str(i % 3), i, f"p{i}") for i in range(30)), key=repr)
