"""Streaming operators against their batch twins."""

from pyspark.sql import functions as F

from palimpsest.sources import adapters as A
from palimpsest.streaming import state as S


def drained(spark, frame, name, tmp_path):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_trigger_stream(spark, sf, tmp_path):
    log = A.ev_stream(spark, sf).filter("user_id < 6")
    for k, part in enumerate((log.filter("event_index < 30"), log.filter("event_index >= 30"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in drained(spark, S.trigger_stream(stream), "triggers_out", tmp_path).collect()}
    want = {tuple(r) for r in S.triggers(log).collect()}
    assert got == want and want


def test_channel_stream(spark, sf, tmp_path):
    """Pieces of seven characters, through a stream, give what one pass over the text gives."""
    c = A.table(spark, sf, "conversations").filter("turn = 0").selectExpr("CAST(conv_id AS STRING) AS session_id", "concat(left(text, 20), '<think>', substr(text, 21, 20), '</think>', substr(text, 41, 20)) AS t")
    rows = [(r.session_id, k, r.t[at : at + 7], at + 7 >= len(r.t)) for r in c.collect() for k, at in enumerate(range(0, len(r.t), 7))]
    spark.createDataFrame(rows, "session_id string, seq long, piece string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, seq long, piece string, last boolean").parquet(str(tmp_path / "in"))
    out = drained(spark, S.channel_stream(stream), "channels_out", tmp_path)
    got = {(r.session_id, r.channel): r.t for r in out.groupBy("session_id", "channel").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY seq)").alias("t")).collect()}
    for r in c.collect():
        text, _, rest = r.t.partition("<think>")
        inner, _, after = rest.partition("</think>")
        assert got[(r.session_id, "channel")] == inner
        assert got[(r.session_id, "text")] == text + after


def test_partial_marks_are_held():
    assert S.held_back("abc<th", "<think>") == 3
    parts, rest, inside = S.split_channels("abc<th", False, "<think>", "</think>", False)
    assert (parts, rest, inside) == ([("text", "abc")], "<th", False)
    assert S.split_channels("abc<th", False, "<think>", "</think>", True)[0] == [("text", "abc<th")]


def test_watermarked_window(spark, sf, tmp_path):
    A.table(spark, sf, "events").select("ts", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    agg = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    assert drained(spark, agg, "windows_out", tmp_path).count() > 0


def test_stop_stream(spark, tmp_path):
    """Matches go on from one batch to the next, as in one fold over all tokens."""
    from palimpsest.functions import arrays as V

    rows = [(str(s), i, i // (s + 1) % 3) for s in range(6) for i in range(20)]
    frame = spark.createDataFrame(rows, "session_id string, seq long, token int")
    for part in (frame.filter("seq < 7"), frame.filter("seq >= 7")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.session_id: r.hit for r in drained(spark, S.stop_stream(stream, [1, 2]), "stops_out", tmp_path).collect()}
    whole = frame.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]).alias("t")).select("session_id", V.stop_detector(F.col("t"), [1, 2]).alias("hit"))
    assert got == {r.session_id: r.hit for r in whole.collect() if r.hit >= 0} and got
