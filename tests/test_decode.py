import random

import pytest
from test_streaming import drained

from palimpsest import catalog
from palimpsest.streaming import decode as D


def piece(t):
    return (None, t)


def test_bytes_become_characters():
    assert D.pieces_text([(0xE2, None), (0x82, None), (0xAC, None)]) == ("€", True)
    assert D.pieces_text([(0xE2, None), (0x82, None)]) == (D.LOST * 2, False)
    assert D.pieces_text([(0xE2, None), piece("x")]) == (D.LOST + "x", True)
    assert D.pieces_text([(0xE2, None), (0x41, None), (0x82, None), (0xAC, None)]) == ("A€", True)
    assert D.pieces_text([(0xF0, None), (0x9F, None), (0x98, None), (0x80, None), (0xC3, None)]) == ("😀" + D.LOST, False)
    assert D.pieces_text([]) == ("", True)


def test_what_may_be_a_stop_sequence_waits():
    d = D.Decoder(D.Stops([[piece("a"), piece("b"), piece("c")], [piece("b"), piece("d")]]))
    assert [d.step(piece(t)) for t in "xabxab"] == ["x", "", "", "abx", "", ""] and not d.stopped
    assert d.step(piece("c")) == "" and d.stopped and d.step(piece("x")) == "" and d.tokens == 7
    with pytest.raises(ValueError, match="empty"):
        D.Stops([[]])


def naive(tokens, stops):
    """All progress of all sequences at every token."""
    progress, pending, out, partial = [0] * len(stops), [], "", []
    for n, t in enumerate(tokens, 1):
        for k, s in enumerate(stops):
            progress[k] = progress[k] + 1 if progress[k] < len(s) and s[progress[k]] == t else int(s[0] == t)
        stop = any(p == len(s) for p, s in zip(progress, stops))
        text, whole = D.pieces_text(partial + [t])
        if not whole:
            partial = partial + [t]
            if stop:
                return out, True, n
            continue
        if stop:
            return out, True, n
        partial, pending = [], pending + [text]
        while len(pending) > max(progress):
            out += pending.pop(0)
    return out, False, len(tokens)


def sequences(seed, n):
    rng = random.Random(seed)
    alphabet = [piece("a"), piece("▁b"), piece("c"), (0xE2, None), (0x82, None), (0xAC, None), (0x41, None)]
    stops = [[piece("a"), piece("a"), piece("▁b")], [piece("▁b"), piece("c"), piece("c")], [piece("c"), (0xE2, None), piece("a"), piece("a")], [piece("a"), piece("▁b"), piece("a"), piece("▁b"), piece("a")]]
    return [rng.choices(alphabet, k=rng.randrange(40)) for _ in range(n)], stops


def test_any_division_gives_the_same_text():
    rng = random.Random(7)
    found, stops = sequences(1, 500)
    known = D.Stops(stops)
    for tokens in found:
        want = naive(tokens, stops)
        d, text = D.Decoder(known), ""
        for t in tokens:
            text += d.step(t)
            if rng.random() < 0.5:
                d = D.Decoder.restored(known, d.saved())
        assert (text, d.stopped, d.tokens) == (want[0].replace("▁", " "), *want[1:])


def test_stream_and_batch_agree(spark, tmp_path):
    found, stops = sequences(2, 60)
    rows = [(str(s), k, b, p) for s, tokens in enumerate(found) for k, (b, p) in enumerate(tokens)]
    frame = spark.createDataFrame(rows, "session_id string, seq long, byte int, piece string")
    want = {r.session_id: (r.text, r.stopped, r.n_tokens) for r in D.decoded(frame, stops).collect()}
    assert want == {str(s): (x[0].replace("▁", " "), *x[1:]) for s, t in enumerate(found) if t for x in [naive(t, stops)]}
    for part in (frame.filter("seq < 5"), frame.filter("seq between 5 and 17"), frame.filter("seq > 17")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out: dict = {}
    for r in sorted(drained(spark, D.decode_stream(stream, stops), "decoded_out", tmp_path).collect(), key=lambda r: r.seq):
        out[r.session_id] = out.get(r.session_id, "") + r.text
    assert out == {s: w[0] for s, w in want.items() if w[0]}


def test_whole_characters_come_before_an_ascii_byte():
    assert D.pieces_text([(0xC3, None), (0xA4, None), (0xE2, None), (0x41, None), (0x82, None), (0xAC, None)]) == ("äA€", True)
    assert D.pieces_text([(0xC3, None), (0xA4, None), (0x41, None)]) == ("äA", True)
    assert D.pieces_text([(0xEF, None), (0xBF, None), (0xBD, None), (0xE2, None), (0x41, None), (0x82, None), (0xAC, None)]) == (D.LOST + "A€", True)
    assert D.pieces_text([(0xFF, None), (0xC3, None), (0xA4, None), (0x41, None), (0xC3, None)]) == (D.LOST + "äA" + D.LOST, False)
    assert D.pieces_text([(0xFF, None), (0x41, None)] * 20_000 + [(0xC3, None), (0xA4, None)]) == ("A" * 20_000 + D.LOST * 20_000 + "ä", True)


def test_tokens_at_once_and_one_by_one_give_the_same_text():
    rng = random.Random(11)
    alphabet = [piece("a"), (0xC3, None), (0xA4, None), (0xE2, None), (0x82, None), (0xAC, None), (0x41, None), (0xFF, None), (0xEF, None), (0xBF, None), (0xBD, None)]
    for _ in range(3000):
        tokens = rng.choices(alphabet, k=rng.randrange(14))
        d = D.Decoder(D.Stops([]))
        text = "".join(d.step(t) for t in tokens)
        assert text + D.pieces_text(d.partial)[0] == D.pieces_text(tokens)[0], tokens


def test_texts_are_split_where_they_are_read(spark, sf):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choices("ab ▁ä€😀\n", k=rng.randrange(30))) if k % 9 else None, [] if k % 3 else [(0xC3, None), (0x41, None), (None, "▁x"), (0xE2, None)]) for k in range(1000)]
    rows.append((1000, "x", None))
    frame = spark.createDataFrame(rows, "k long, said string, tokens array<struct<byte: int, piece: string>>")
    got = {r.k: (r.text, r.whole) for r in D.joined(frame, "tokens", "said").collect()}
    assert got == {k: D.pieces_text([*D.pieces(t or ""), *ts]) if ts is not None else (None, True) for k, t, ts in rows}
    assert all(got[k][0] == (t or "").replace(" ", "▁") for k, t, ts in rows if ts == [])
    assert {r.k: (r.text, r.whole) for r in D.joined(frame.drop("said"), "tokens").collect()} == {k: D.pieces_text(ts) if ts is not None else (None, True) for k, _, ts in rows}
    assert [*D.pieces("ab cd efé")] == [(None, "ab▁cd▁"), (None, "ef"), (0xC3, None), (0xA9, None)]
    # no column holds the tokens of a text
    plan = catalog.QUERIES["H31_incomplete_bpe"](spark, sf)._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" in plan
