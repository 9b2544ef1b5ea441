import json

from palimpsest.sources import transcripts as T


def lines(spark, values):
    rows = [("s", k, v if isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "session_id string, line_no int, line string")


def got(df):
    return [(r.kind, r.text, r.tool_name, r.tool_args) for r in sorted(df.collect(), key=lambda r: r.idx)]


def test_blocks_of_mixed_types(spark):
    block = lambda **b: {"type": "assistant", "message": {"content": [b]}}
    call = lambda **i: block(type="tool_use", name="T", input=i)
    values = [
        {"type": "user", "message": {"content": "[1] looks like a list"}}, {"type": "user", "message": {"content": [{"type": "text", "text": "a"}, 3, None, "b", {"type": "tool_result", "content": [{"text": "c"}, {"n": 1}, {"text": "d"}]}]}}, {"type": "user", "message": {"content": 5}}, {"type": "user"},
        {"type": "assistant", "message": {"content": " "}}, {"type": "assistant", "message": {"content": {"type": "text"}}}, call(command="", file_path="f"), call(path=1, query="q"), call(other="o" * 300), call(other=1, command=2), call(), block(type="thinking", thinking="t"),
        {"type": "system", "content": ["x"]}, {"type": "system", "content": "y"}, "{", "", "7", {"type": "snapshot"}, {"type": "user", "message": {"content": "[Request interrupted by user] <x>"}}, {"type": "user", "message": {"content": "  1\tx\n  2\ty"}},
    ]
    tool = lambda args: ("tool_call", f"[tool_use T({args})]", "T", args)
    assert got(T.typed_blocks(lines(spark, values))) == [
        ("user", "[1] looks like a list", "", ""), ("user", "a", "", ""), ("user", "c  d", "", ""), tool("command="), tool("q"), tool("other=" + "o" * 100), tool(""), tool(""), ("assistant_thinking", "t", "", ""), ("system", "y", "", ""), ("user", "[Request interrupted by user] <x>", "", ""),
    ]


def test_items_and_orphans(spark):
    item = lambda **p: {"timestamp": "t", "payload": p}
    values = [item(type="message", content=[{"text": "a"}, "b", {"x": 1}]), item(type="message", role="assistant", content="  "), item(type="tool_call", name="f", arguments={"k": 1}, call_id="1"), item(type="tool_result", output=[{"text": "p"}, {"text": "q"}], call_id="1"),
              item(type="function_call", name="g", arguments="x" * 500, call_id="2"), item(type="function_call_output", output="z" * 3000, call_id="3"), item(type="other"), {"payload": [1]}, "no"]
    found = T.response_items(lines(spark, values))
    assert got(found) == [("user", "a b ", "", ""), ("tool_call", '[tool_call f({"k":1})]', "f", '{"k":1}'), ("tool_result", "p q", "", ""), ("tool_call", f"[tool_call g({'x' * 200})]", "g", "x" * 200), ("tool_result", "z" * 2000, "", "")]
    assert {(r.call_id, r.call_idx, r.result_idx) for r in T.paired_calls(found).collect()} == {("1", 1, 2), ("2", 3, None), ("3", None, 4)}


def test_files_of_lines(spark, tmp_path):
    (tmp_path / "one.jsonl").write_bytes(b'{"type":"user","message":{"content":"x"}}\r\n\n{"type":"system","content":"y"}')
    (tmp_path / "two.jsonl").write_bytes(b"")
    rows = T.typed_blocks(T.read_lines(spark, str(tmp_path))).collect()
    assert sorted((r.session_id, r.idx, r.text) for r in rows) == [("one", 0, "x"), ("one", 1, "y")]
    assert T.typed_blocks(lines(spark, ["{}"]).limit(0)).count() == 0


def test_rubric_pairs_share_their_events(spark):
    messages = [{"role": "system", "content": "s"}, {"role": "user", "content": [{"text": "a"}, "b", None]}, {"role": "model", "content": "", "tool_calls": [{"function": {"name": "f", "arguments": {"k": [1]}}}, {"name": "g", "arguments": "x" * 600}, 5]}, {"role": "tool", "content": "t" * 3000, "name": "f"}, {"role": "user", "content": " "}, 3, {"role": "other", "content": "x"}, {"role": "user"}]
    rows = [("r1", json.dumps(messages), "sys", "usr"), ("r2", "{", " ", "usr"), ("r3", "[]", None, None), (None, "7", "sys", "usr"), ("l" * 80, None, "sys", "usr")]
    got = {r.case_id: r for r in T.rubric_cases(spark.createDataFrame(rows, "id string, messages_json string, system string, user string")).collect()}
    assert len(got) == 10 and all(got[r.paired_case_id].paired_case_id == c and got[r.paired_case_id].events == r.events for c, r in got.items())
    one = got["r1:normal"]
    assert (one.n_events, one.probe_t) == (5, 4) and [(e.kind, e.text, len(e.tool_args)) for e in one.events] == [("system", "s", 0), ("user", "a b None", 0), ("tool_call", '[tool_use f({"k":[1]})]', 9), ("tool_call", f"[tool_use g({'x' * 120})]", 500)]
    assert [(e.kind, e.text) for e in got["unknown:hack"].events] == [("system", "sys")] and got["r2:hack"].n_events == 1 and got["r2:hack"].events == [] and got["r3:normal"].n_events == got["r3:normal"].probe_t == 0
    assert got["l" * 64 + ":hack"].n_events == 2
