"""Model containers: a data source that reads sections, and a writer.

A container is a magic number, three version numbers, the place where the header ends, the header, a flatbuffer with metadata and
the byte range and type of each section, and the sections at multiples of 16 KiB. ``read_containers`` plans from the listing of files
alone: a partition is a range of CHUNK bytes of a long file, or many small files of about as many bytes. Its task reads the headers
and then the sections, or chunks of CHUNK bytes of long ones, that begin in its ranges. Compressed sections are
inflated as they are read, up to a bound; so no row is larger than CHUNK. What cannot be read is a row with ``error``, and the
other sections still come. Files are opened by Arrow's file systems, local or object stores, in the workers.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The format.
MAGIC, VERSION = b"LITERTLM", (1, 5, 0)
HEADER_END_AT, HEADER_AT, BLOCK = 24, 32, 16 * 1024
#: Types of sections, by number.
TYPES = ["NONE", "GenericBinaryData", "Deprecated", "TFLiteModel", "SP_Tokenizer", "LlmMetadataProto", "HF_Tokenizer_Zlib", "TFLiteWeights"]
#: Kinds of values in metadata, by number, and how struct packs them.
VALUES = ["NONE", "UInt8", "Int8", "UInt16", "Int16", "UInt32", "Int32", "Float32", "Bool", "StringValue", "UInt64", "Int64", "Double"]
PACKED = {"UInt8": "<B", "Int8": "<b", "UInt16": "<H", "Int16": "<h", "UInt32": "<I", "Int32": "<i", "Float32": "<f", "Bool": "<?", "UInt64": "<Q", "Int64": "<q", "Double": "<d"}
#: What a compressed section may inflate to.
MOST = 1 << 30

COMPRESSED = "HF_Tokenizer_Zlib"
CHUNK = 64 << 20
#: What opening a small file costs, in bytes read meanwhile.
OPENING = 256 << 10
#: Blocks of local file systems.
PAGE = 4096
#: Headers are small; a larger one is taken as damage.
HEADER_MOST = 64 << 20


class Damaged(ValueError):
    """What is wrong with a file or section, as the error column says it."""


@dataclass
class Section:
    kind: str
    begin: int = 0
    end: int = 0
    items: list[tuple[str, str, str]] = field(default_factory=list)  # key, kind of value, value
    error: str = ""


# --- flatbuffers: tables of optional fields behind offsets; every read is bounded by the buffer ---


class Table:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at
        vtable = at - self._get("<i", at)
        size = self._get("<H", vtable)
        self.fields = [self._get("<H", vtable + k) for k in range(4, size - 1, 2)]

    def _get(self, kind: str, at: int) -> int | float:
        if at < 0 or at + struct.calcsize(kind) > len(self.data):
            raise Damaged("header offsets")
        return struct.unpack_from(kind, self.data, at)[0]

    def _place(self, k: int) -> int | None:
        return self.at + self.fields[k] if k < len(self.fields) and self.fields[k] else None

    def scalar(self, k: int, kind: str) -> int | float:
        at = self._place(k)
        return 0 if at is None else self._get(kind, at)

    def _target(self, at: int) -> int:
        return at + self._get("<I", at)

    def table(self, k: int) -> Table | None:
        at = self._place(k)
        return None if at is None else Table(self.data, self._target(at))

    def tables(self, k: int) -> list[Table]:
        at = self._place(k)
        if at is None:
            return []
        at = self._target(at)
        n = self._get("<I", at)
        if at + 4 + 4 * n > len(self.data):
            raise Damaged("header offsets")
        return [Table(self.data, self._target(at + 4 + 4 * i)) for i in range(n)]

    def string(self, k: int) -> str | None:
        at = self._place(k)
        if at is None:
            return None
        at = self._target(at)
        n = self._get("<I", at)
        if at + 4 + n > len(self.data):
            raise Damaged("header offsets")
        return self.data[at + 4 : at + 4 + n].decode("utf-8", "replace")


def _pair(t: Table) -> tuple[str, str, str]:
    number = int(t.scalar(1, "<B"))
    kind = VALUES[number] if number < len(VALUES) else "Unknown"
    held = t.table(2)
    value = "" if held is None else (held.string(0) or "") if kind == "StringValue" else str(held.scalar(0, PACKED[kind])) if kind in PACKED else ""
    return t.string(0) or "", kind, value


def header_end(start: bytes) -> int:
    """Where the header ends, from a file's first HEADER_AT bytes."""
    if start[: len(MAGIC)] != MAGIC:
        raise Damaged("magic")
    if len(start) < HEADER_AT:
        raise Damaged("truncated header")
    if struct.unpack_from("<I", start, 8)[0] != VERSION[0]:
        raise Damaged("version")
    end = struct.unpack_from("<Q", start, HEADER_END_AT)[0]
    if not HEADER_AT <= end <= HEADER_MOST:
        raise Damaged("header end")
    return end


def parsed(header: bytes, size: int) -> tuple[list[tuple[str, str, str]], list[Section]]:
    """Metadata of the file and its sections; a section that is empty, backward or beyond size bytes has an error."""
    if len(header) < 4:
        raise Damaged("truncated header")
    root = Table(header, struct.unpack_from("<I", header)[0])
    system, listed = root.table(0), root.table(1)
    out = []
    for s in listed.tables(0) if listed else []:
        number, begin, end = int(s.scalar(3, "<B")), int(s.scalar(1, "<Q")), int(s.scalar(2, "<Q"))
        error = "offsets" if begin > end else "empty" if begin == end else "truncated" if end > size else ""
        out.append(Section(TYPES[number] if number < len(TYPES) else "Unknown", begin, end, [_pair(p) for p in s.tables(0)], error))
    return [_pair(p) for p in system.tables(0)] if system else [], out


# --- the writer ---


def _aligned(out: bytearray, to: int = 8) -> int:
    out.extend(bytes(-len(out) % to))
    return len(out)


def _table(out: bytearray, fields: list[tuple[int, str, int | float]]) -> int:
    """Appends a table of (field number, struct kind, value); an offset's value is a place, and may be before or after: it is patched by
    the caller through the returned places."""
    count = max([k for k, _, _ in fields], default=-1) + 1
    vtable = _aligned(out, 2)
    offsets, size = [0] * count, 4
    for k, kind, _ in fields:
        n = struct.calcsize(kind)
        size += -size % n
        offsets[k], size = size, size + n
    out.extend(struct.pack(f"<HH{count}H", 4 + 2 * count, size, *offsets))
    at = _aligned(out)
    out.extend(struct.pack("<i", at - vtable) + bytes(size - 4))
    for k, kind, value in fields:
        struct.pack_into(kind, out, at + offsets[k], value)
    return at


def _point(out: bytearray, table: int, k: int, target: int) -> None:
    vtable = table - struct.unpack_from("<i", out, table)[0]
    at = table + struct.unpack_from("<H", out, vtable + 4 + 2 * k)[0]
    struct.pack_into("<I", out, at, target - at)


def _string(out: bytearray, s: str) -> int:
    at = _aligned(out)
    data = s.encode()
    out.extend(struct.pack("<I", len(data)) + data + b"\0")
    return at


def _vector(out: bytearray, count: int) -> int:
    at = _aligned(out)
    out.extend(struct.pack("<I", count) + bytes(4 * count))
    return at


def _pairs(out: bytearray, items: list[tuple[str, str, object]]) -> int:
    at = _vector(out, len(items))
    for i, (key, kind, value) in enumerate(items):
        pair = _table(out, [(0, "<I", 0), (1, "<B", VALUES.index(kind)), (2, "<I", 0)])
        held = _table(out, [(0, "<I" if kind == "StringValue" else PACKED[kind], 0 if kind == "StringValue" else value)])
        if kind == "StringValue":
            _point(out, held, 0, _string(out, str(value)))
        _point(out, pair, 0, _string(out, key))
        _point(out, pair, 2, held)
        struct.pack_into("<I", out, at + 4 + 4 * i, pair - (at + 4 + 4 * i))
    return at


def _header(system: list[tuple[str, str, object]], sections: list[Section]) -> bytes:
    out = bytearray(4)
    root = _table(out, [(0, "<I", 0), (1, "<I", 0)])
    struct.pack_into("<I", out, 0, root)
    meta = _table(out, [(0, "<I", 0)])
    _point(out, root, 0, meta)
    _point(out, meta, 0, _pairs(out, system))
    listed = _table(out, [(0, "<I", 0)])
    _point(out, root, 1, listed)
    at = _vector(out, len(sections))
    _point(out, listed, 0, at)
    for i, s in enumerate(sections):
        t = _table(out, [(0, "<I", 0), (1, "<Q", s.begin), (2, "<Q", s.end), (3, "<B", TYPES.index(s.kind))])
        _point(out, t, 0, _pairs(out, s.items))
        struct.pack_into("<I", out, at + 4 + 4 * i, t - (at + 4 + 4 * i))
    return bytes(out)


def container(system: list[tuple[str, str, object]], sections: list[tuple[str, list[tuple[str, str, object]], bytes]]) -> bytes:
    """sections: type, items (key, kind of value, value), and bytes, compressed here where the type says so."""
    bodies = [struct.pack("<Q", len(b)) + zlib.compress(b) if kind == COMPRESSED else b for kind, _, b in sections]
    placed = [Section(kind, items=items) for kind, items, _ in sections]
    end = HEADER_AT + len(_header(system, placed))  # places are of fixed width: the size holds
    at = end
    for s, body in zip(placed, bodies):
        s.begin = -(-at // BLOCK) * BLOCK
        s.end = at = s.begin + len(body)
    out = bytearray(MAGIC + struct.pack("<IIIIQ", *VERSION, 0, end) + _header(system, placed))
    for s, body in zip(placed, bodies):
        out.extend(bytes(s.begin - len(out)) + body)
    return bytes(out)


# --- the data source ---


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    found = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return found[0], found[1]


def _files(path: str) -> list[tuple[str, int]]:
    """The files at a path, or below a folder, with their sizes; hidden ones are left out."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    if info.is_file:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


@dataclass
class Piece(InputPartition):
    """A section, or a chunk of one; number is -1 for a file whose header is damaged."""

    path: str
    number: int
    section: Section
    first: int = 0

    def __post_init__(self) -> None:
        InputPartition.__init__(self, (self.path, self.number, self.first))


@dataclass
class Pack(InputPartition):
    """Ranges (path, from, to) of files that one task reads; to is None for a file's last range."""

    ranges: list[tuple[str, int, int | None]]

    def __post_init__(self) -> None:
        InputPartition.__init__(self, tuple(self.ranges))


def _packs(files: list[tuple[str, int]], data: bool) -> Iterator[Pack]:
    """All ranges of the files, dealt by the bytes to read, or by headers alone without data, and what opening a file costs."""
    held, cost = [], 0
    for path, size in files:
        for start in range(0, max(size, 1) if data else 1, CHUNK):
            own = OPENING + (min(CHUNK, size - start) if data else 0)
            if held and cost + own > CHUNK:
                yield Pack(held)
                held, cost = [], 0
            held.append((path, start, start + CHUNK if data and start + CHUNK < size else None))
            cost += own
    if held:
        yield Pack(held)


def _planned(path: str, f: pa.NativeFile) -> Iterator[Piece]:
    size = f.size()
    try:
        end = header_end(f.read_at(min(size, HEADER_AT), 0))
        if end > size:
            raise Damaged("truncated header")
        _, sections = parsed(f.read_at(end - HEADER_AT, HEADER_AT), size)
    except Damaged as e:
        yield Piece(path, -1, Section("", error=str(e)))
        return
    for k, s in enumerate(sections):
        step = s.end - s.begin if s.error or s.kind == COMPRESSED else CHUNK
        for first in range(s.begin, max(s.end, s.begin + 1), max(step, 1)):
            yield Piece(path, k, s, first)


def _pieces(path: str) -> Iterator[Piece]:
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        yield from _planned(path, f)


def _inflated(f: pa.NativeFile, s: Section) -> Iterator[bytes]:
    if s.end - s.begin < 8:
        raise Damaged("compressed size")
    want = struct.unpack("<Q", f.read_at(8, s.begin))[0]
    if want > MOST:
        raise Damaged("inflated size")
    inflate, made = zlib.decompressobj(), 0
    try:
        for at in range(s.begin + 8, s.end, CHUNK):
            data = f.read_at(min(CHUNK, s.end - at), at)
            while data and not inflate.eof:
                out = inflate.decompress(data, CHUNK)
                data, made = inflate.unconsumed_tail, made + len(out)
                if made > want:
                    raise Damaged("inflated size")
                if out:
                    yield out
    except zlib.error as e:
        raise Damaged("compressed data") from e
    if not inflate.eof or made != want:
        raise Damaged("compressed data")


SCHEMA = "path string, section int, data_type string, begin_offset long, end_offset long, items array<struct<key: string, kind: string, value: string>>, chunk int, content binary, error string"


class SectionReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.data = options["path"], options.get("content", "true").lower() != "false"

    def partitions(self) -> list[Pack]:
        return list(_packs(_files(self.path), self.data))

    def read(self, partition: Pack | Piece) -> Iterator[tuple]:
        ranges = [(partition.path, 0, None)] if isinstance(partition, Piece) else partition.ranges
        for path, start, end in ranges:
            system, at = _opened(path)
            with system.open_input_file(at) as f:
                for p in [partition] if isinstance(partition, Piece) else _planned(path, f):
                    # a damaged header may name any place: what lies beyond the file is its last range's
                    if p.first >= start and (end is None or p.first < end) or isinstance(partition, Piece):
                        yield from self._rows(f, p)

    def _rows(self, f: pa.NativeFile, p: Piece) -> Iterator[tuple]:
        s = p.section
        items = [{"key": k, "kind": v, "value": x} for k, v, x in s.items]
        if p.number < 0:
            yield p.path, None, None, None, None, [], 0, None, s.error
            return
        row = (p.path, p.number, s.kind, s.begin, s.end, items)
        if s.error or not self.data:
            if p.first == s.begin:
                yield *row, 0, None, s.error or None
            return
        chunk = (p.first - s.begin) // CHUNK
        try:
            if s.kind != COMPRESSED:
                yield *row, chunk, f.read_at(min(CHUNK, s.end - p.first), p.first), None
                return
            for chunk, out in enumerate(_inflated(f, s)):
                yield *row, chunk, out, None
        except Damaged as e:
            yield *row, chunk, None, str(e)


class Sections(DataSource):
    """``spark.read.format("container_sections").load(path)``; option content=false reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "container_sections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SectionReader:
        return SectionReader(self.options)


def read_containers(spark: SparkSession, path: str, *, content: bool = True) -> DataFrame:
    """SCHEMA: a row for each chunk of each section of the containers at a path, a file's own row where its header is damaged."""
    spark.dataSource.register(Sections)
    return spark.read.format("container_sections").option("content", str(content)).load(path)


def has_model(sections: DataFrame, model_type: str) -> DataFrame:
    """path, found: whether a container holds a model whose item model_type is this one; sections of other types do not count."""
    own = (F.col("data_type") == "TFLiteModel") & F.exists("items", lambda i: (i["key"] == "model_type") & (i["value"] == model_type))
    return sections.groupBy("path").agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("found"))


def _put(system: fs.FileSystem, at: str, data: bytes) -> None:
    """A file of these bytes; local file systems keep no blocks for the zeros between sections."""
    if not isinstance(system, fs.LocalFileSystem):
        with system.open_output_stream(at) as f:
            f.write(data)
        return
    zeros = bytes(PAGE)
    with open(at, "wb", buffering=0) as f:
        f.truncate(len(data))
        for first in range(0, len(data), PAGE):
            page = memoryview(data)[first : first + PAGE]
            if page != zeros[: len(page)]:
                os.pwrite(f.fileno(), page, first)


def write_containers(rows: DataFrame, folder: str, change: Callable[[str, bytes], bytes] | None = None) -> DataFrame:
    """rows (name, section, data_type, key, content, and model_type if there is one) -> (name, size), a container each name, whose sections are held in one task:
    callers bound them. A file that a lost task wrote is replaced by the same bytes. change gets name and bytes, to damage some."""

    def write(t: pa.Table) -> pa.Table:
        made = sorted(t.to_pylist(), key=lambda r: r["section"])
        data = container([("name", "StringValue", made[0]["name"]), ("sections", "UInt32", len(made))], [(r["data_type"], [("key", "Int64", r["key"])] + [("model_type", "StringValue", r.get("model_type"))] * bool(r.get("model_type")), r["content"]) for r in made])
        data = change(made[0]["name"], data) if change else data
        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        _put(system, f"{at}/{made[0]['name']}", data)
        return pa.table({"name": [made[0]["name"]], "size": [len(data)]})

    return rows.groupBy("name").applyInArrow(write, "name string, size long")
