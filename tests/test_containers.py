import struct
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import containers as C

ITEMS = [("model_type", "StringValue", "drafter ü"), ("n", "Int32", -5), ("x", "Float32", 0.5), ("on", "Bool", True), ("big", "UInt64", 2**63), ("d", "Double", -1.25), ("b", "UInt8", 255), ("s", "Int16", -300)]
SECTIONS = [("TFLiteModel", ITEMS, b"abc" * 10_000), ("HF_Tokenizer_Zlib", [], b'{"a": 1}' * 5000), ("GenericBinaryData", [], b""), ("LlmMetadataProto", [("k", "StringValue", "")], b"x")]


def read(spark, path):
    return sorted(C.read_containers(spark, str(path)).collect(), key=lambda r: (r.path, -1 if r.section is None else r.section, r.chunk))


def test_sections_come_back(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(C.container([("made", "StringValue", "today")], SECTIONS))
    rows = read(spark, tmp_path)
    assert [(r.section, r.data_type, r.error) for r in rows] == [(k, s[0], "empty" if not s[2] else None) for k, s in enumerate(SECTIONS)]
    assert [bytes(r.content or b"") for r in rows] == [s[2] for s in SECTIONS]
    assert all(r.begin_offset % C.BLOCK == 0 for r in rows)
    assert [(i.key, i.kind, i.value) for i in rows[0]["items"]] == [(k, t, str(v)) for k, t, v in ITEMS]
    bare = C.read_containers(spark, str(tmp_path), content=False).collect()
    assert len(bare) == 4 and all(r.content is None for r in bare)


def test_long_sections_come_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 1000)
    body = bytes(range(256)) * 20
    (tmp_path / "m.bin").write_bytes(C.container([], [("TFLiteWeights", [], body)]))
    pieces = list(C._pieces(str(tmp_path / "m.bin")))
    assert [p.first - p.section.begin for p in pieces] == list(range(0, len(body), 1000))
    rows = [r for p in pieces for r in C.SectionReader({"path": str(tmp_path)}).read(p)]
    assert [r[6] for r in rows] == list(range(6)) and b"".join(r[7] for r in rows) == body
    s = C.Section("HF_Tokenizer_Zlib")
    (tmp_path / "z").write_bytes(data := struct.pack("<Q", len(body)) + zlib.compress(body))
    s.end = len(data)
    with C._opened(str(tmp_path / "z"))[0].open_input_file(str(tmp_path / "z")) as f:
        chunks = list(C._inflated(f, s))
    assert b"".join(chunks) == body and max(map(len, chunks)) <= 1000


def test_damage_is_a_row(spark, tmp_path):
    good = C.container([], SECTIONS)
    end = struct.unpack_from("<Q", good, C.HEADER_END_AT)[0]
    two = [s for s in C.parsed(good[C.HEADER_AT : end], len(good))[1]][1]
    cases = {
        "a-empty": (b"", "magic"), "b-magic": (b"X" + good[1:], "magic"), "c-short": (good[:20], "truncated header"), "d-version": (good[:8] + struct.pack("<I", 2) + good[12:], "version"),
        "e-header": (good[: end - 1], "truncated header"), "f-end": (good[:24] + struct.pack("<Q", 3) + good[32:], "header end"), "g-far": (good[:24] + struct.pack("<Q", 1 << 60) + good[32:], "header end"),
        "h-offset": (good[:32] + struct.pack("<I", 1 << 30) + good[36:], "header offsets"),
    }
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    assert [(r.path.rsplit("/", 1)[1], r.section, r.error) for r in read(spark, tmp_path)] == [(n, None, e) for n, (_, e) in sorted(cases.items())]
    other = tmp_path / "sections"
    other.mkdir()
    (other / "cut").write_bytes(good[:-1])
    (other / "size").write_bytes(good[: two.begin] + struct.pack("<Q", 1 << 31) + good[two.begin + 8 :])
    (other / "less").write_bytes(good[: two.begin] + struct.pack("<Q", 7) + good[two.begin + 8 :])
    (other / "zlib").write_bytes(good[: two.begin + 12] + bytes(8) + good[two.begin + 20 :])
    got = {(r.path.rsplit("/", 1)[1], r.section): r.error for r in read(spark, other) if r.error}
    assert got == {(n, 2): "empty" for n in ("cut", "size", "less", "zlib")} | {("cut", 3): "truncated", ("size", 1): "inflated size", ("less", 1): "inflated size", ("zlib", 1): "compressed data"}


def test_any_wrong_byte_of_a_header_is_survived():
    good = C.container([("made", "StringValue", "x")], SECTIONS)
    end = struct.unpack_from("<Q", good, C.HEADER_END_AT)[0]
    for at in range(C.HEADER_AT, end):
        for byte in (0, 1, 0x7F, 0xFF):
            bad = good[:at] + bytes([byte]) + good[at + 1 : end]
            try:
                C.parsed(bad[C.HEADER_AT :], len(good))
            except C.Damaged:
                pass


def test_a_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFound"):
        read(spark, tmp_path / "none")


def test_small_files_share_tasks_and_long_ones_are_divided(spark, tmp_path, monkeypatch):
    (tmp_path / "small").mkdir()
    for k in range(600):
        (tmp_path / "small" / f"m{k}").write_bytes(C.container([], [("TFLiteModel", [], b"x" * k), ("LlmMetadataProto", [], b"y")]))
    for data, most in (("true", 20), ("false", 3)):
        assert 1 < len(C.SectionReader({"path": str(tmp_path / "small"), "content": data}).partitions()) <= most
    assert C.read_containers(spark, str(tmp_path / "small")).rdd.getNumPartitions() <= 20
    got = sorted((int(r.path.rsplit("/m", 1)[1]), r.section, len(r.content or b"")) for r in read(spark, tmp_path / "small"))
    assert got == [(k, s, n) for k in range(600) for s, n in ((0, k), (1, 1))]
    monkeypatch.setattr(C, "CHUNK", 20_000)
    monkeypatch.setattr(C, "OPENING", 0)
    (tmp_path / "long").mkdir()
    body = bytes(range(256)) * 400
    whole = C.container([], [("TFLiteWeights", [], body), ("HF_Tokenizer_Zlib", [], body), ("LlmMetadataProto", [], b"y")])
    (tmp_path / "long" / "a").write_bytes(whole)
    (tmp_path / "long" / "b").write_bytes(whole[:60_000])  # sections begin beyond the file's end
    (tmp_path / "long" / "c").write_bytes(b"")
    reader = C.SectionReader({"path": str(tmp_path / "long")})
    packs = reader.partitions()
    assert len(packs) > 5
    rows = [(r[0].rsplit("/", 1)[1], r[1], r[6], r[7], r[8]) for p in packs for r in reader.read(p)]
    a = sorted(r for r in rows if r[0] == "a")
    assert [r[1:3] for r in a if r[1] == 0] == [(0, k) for k in range(6)] and max(len(r[3]) for r in a) <= 20_000
    assert b"".join(r[3] for r in a if r[1] == 0) == body == b"".join(r[3] for r in a if r[1] == 1) and [r[3] for r in a if r[1] == 2] == [b"y"]
    assert sorted(r[:3] + r[4:] for r in rows if r[0] == "b") == [("b", k, 0, "truncated") for k in range(3)]
    assert [r for r in rows if r[0] == "c"] == [("c", None, 0, None, "magic")]


def test_padding_takes_no_room_and_is_read_as_zeros(tmp_path):
    data = C.container([], [("LlmMetadataProto", [], b"y")] * 50)
    C._put(C.fs.LocalFileSystem(), str(tmp_path / "a"), data)
    assert (tmp_path / "a").read_bytes() == data and (tmp_path / "a").stat().st_blocks * 512 < len(data) / 2
    for odd in (b"", b"\0", b"\0" * 9000, b"x" * 4097):
        C._put(C.fs.LocalFileSystem(), str(tmp_path / "a"), odd)
        assert (tmp_path / "a").read_bytes() == odd


def test_small_containers_are_written_by_many_tasks(spark, sf, monkeypatch):
    """Their rows are few bytes, so what Spark deals by size would be written by one task; the scan then reads headers of many files a task."""
    from palimpsest import catalog
    from palimpsest.plans import containers as plan

    seen, write = [], C.write_containers

    def kept(rows, folder, *change):
        seen.append((rows, folder))
        return write(rows, folder, *change)

    monkeypatch.setattr(plan.C, "write_containers", kept)
    found = catalog.QUERIES["A38_capability_scan"](spark, sf)
    [(rows, folder)] = seen
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = rows.select("name", F.spark_partition_id().alias("p")).distinct().collect()
    assert rows.rdd.getNumPartitions() == parts and len({r.p for r in names}) > parts // 2 and len({r.name for r in names}) == len(names)
    assert len(C.SectionReader({"path": folder, "content": "false"}).partitions()) == 1 and found.count() == len(names)
