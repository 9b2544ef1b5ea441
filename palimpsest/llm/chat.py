"""Chat formatting: spans of turns, found by rendering prefixes of a conversation with a black-box template.

A template is any function from turns (role, text) to a string. ``located`` renders the first 1, 2, 3 ... turns and compares
consecutive outputs: what an output adds to the one before is the span of its last turn; where an output does not begin with
the one before, the turn has rewritten history, and its number is returned in ``rewritten``. Inside a span the text lies
between the common beginning and the common end of two renderings in which the text is one of two characters that nothing else
holds. After a rewrite these two renderings are made of the whole conversation for each turn, as only places in the last
output count; a turn whose text the template dropped or that cannot be told apart then has no place and no loss.

Cost. n prefixes of n turns take the square of n. A template may say of how many preceding turns a turn's output depends
(``context``): then a conversation is rendered in runs of RUN turns or RUN_CHARS characters, each after its context alone, and comes out in parts, so
time is in proportion to the turns and memory holds a run. Each run's end is rendered from the shorter beginning too; an output
that differs, or a rewrite, refutes the declared context and is an error. Without it (None) a conversation is one part.

Rows are shuffled by conv_id and sorted, spilling to disk, by (turn, role, text), null turns first; a task streams its
conversations. A conversation is a sequence whose digests are sequential, so one task reads it, with bounded memory. A null role
or text becomes empty, a null conv_id is a conversation of its own, rows equal in turn come in order of role and text and
repeated rows are turns each, an empty table gives no rows (but the planted conversation), other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
#: Turns that are rendered after one beginning, and characters after which a run ends sooner.
RUN, RUN_CHARS = 32, 4 << 20
#: Two characters of the private use area.
PROBES = ("\ue000", "\ue001")
#: Characters of parts that are sent on together.
BATCH = 4 << 20


@dataclass(frozen=True)
class Template:
    """render: turns -> output. read: the output of one turn -> (role, text). plain: an escaped text -> the text."""

    render: Callable[[Sequence[Turn]], str]
    read: Callable[[str], Turn]
    plain: Callable[[str], str]
    context: int | None = None


@dataclass
class Span:
    turn: int
    start: int
    end: int
    text_start: int | None
    text_end: int | None
    loss: bool


@dataclass
class Part:
    text: str
    spans: list[Span]
    rewritten: list[int] = field(default_factory=list)


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the first hi characters may differ, the first lo do not
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def text_place(render: Callable[[Sequence[Turn]], str], turns: list[Turn], k: int, out: str) -> tuple[int, int] | None:
    """Where turn k's text lies in out, the rendering of turns."""
    a, b = (render([*turns[:k], (turns[k][0], p), *turns[k + 1 :]]) for p in PROBES)
    if a == b:
        return None
    head = shared(a, b)
    foot = shared(a[head:][::-1], b[head:][::-1])
    end = len(out) - foot
    return (head, end) if head <= end and out.startswith(a[:head]) and out.endswith(a[len(a) - foot :]) else None


def located(turns: Iterator[Turn], template: Template, loss: frozenset[str]) -> Iterator[Part]:
    """The parts of one conversation; concatenated texts are its output, places count from a part's own start."""
    render, context = template.render, template.context
    held: list[Turn] = []
    known = 0  # turns of held that earlier parts have
    out, begin, number = "", 0, 0
    spans: list[Span] = []
    rewritten: list[int] = []
    for turn in turns:
        held.append(turn)
        now = render(held)
        same = shared(out, now)
        if same < len(out):
            if context is not None:
                raise ValueError(f"turn {number} rewrites history, but the template declares a context of {context} turns")
            rewritten.append(number)
        elif not rewritten:
            at = text_place(render, held, len(held) - 1, now)
            spans.append(Span(number, len(out) - begin, len(now) - begin, *((x - begin for x in at) if at else (None, None)), turn[0] in loss))
        out, number = now, number + 1
        if context is not None and (len(held) - known >= RUN or len(out) - begin >= RUN_CHARS):
            yield Part(out[begin:], spans)
            tail = held[-1 - context :]
            if render(tail)[len(render(tail[:-1])) if len(tail) > 1 else 0 :] != out[begin + spans[-1].start :]:
                raise ValueError(f"the output of turn {number - 1} depends on more than the {context} turns before it")
            held = held[-context:] if context else []
            out = render(held) if held else ""
            begin, known, spans = len(out), len(held), []
    if rewritten:
        spans = []
        for k, (role, _) in enumerate(held):
            at = text_place(render, held, k, out)
            if at:
                spans.append(Span(k, *at, *at, role in loss))
    if len(held) > known:
        yield Part(out[begin:], spans, rewritten)


# --- the template of the query: user and assistant turns as in Llama's first chat models, other roles by name ---

# a bracket, backslashes or none, and the rest of a control string; the second with one backslash at least
_BARE = re.compile(r"<\\*+(?=/?s>)|\[\\*+(?=(?:/?INST|/?ROLE|TEXT)\])")
_ESCAPED = re.compile(r"<\\++(?=/?s>)|\[\\++(?=(?:/?INST|/?ROLE|TEXT)\])")


def escaped(s: str) -> str:
    """One backslash more after the bracket of all that reads as a control string, with or without backslashes there."""
    return _BARE.sub(lambda m: m[0] + "\\", s)


def plain(s: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], s)


def _piece(role: str, text: str) -> str:
    if role == "user":
        return f"[INST] {escaped(text)} [/INST]"
    if role == "assistant":
        return f"{escaped(text)}</s>"
    return f"[ROLE] {escaped(role)} [TEXT] {escaped(text)} [/ROLE]"


def _render(turns: Sequence[Turn]) -> str:
    return "<s>" + "".join(_piece(r, t) for r, t in turns)


def _read(piece: str) -> Turn:
    piece = piece.removeprefix("<s>")
    if piece.startswith("[INST] "):
        return "user", plain(piece[len("[INST] ") : -len(" [/INST]")])
    if piece.startswith("[ROLE] "):
        role, _, text = piece[len("[ROLE] ") : -len(" [/ROLE]")].partition(" [TEXT] ")
        return plain(role), plain(text)
    return "assistant", plain(piece[: -len("</s>")])


INSTRUCT = Template(_render, _read, plain, context=1)

PART = "conv_id long, planted boolean, part int, offset long, text string, rewritten array<int>, turns array<struct<turn: int, start: int, end: int, text_start: int, text_end: int, loss: boolean>>"
_KINDS = pa.schema([
    ("conv_id", pa.int64()), ("planted", pa.bool_()), ("part", pa.int32()), ("offset", pa.int64()), ("text", pa.string()), ("rewritten", pa.list_(pa.int32())),
    ("turns", pa.list_(pa.struct([("turn", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_())]))),
])


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Like itertools.groupby over (conv_id, planted), which leads each row."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[:2])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def formatted(conversations: DataFrame, template: Template = INSTRUCT, loss: tuple[str, ...] = ("assistant",), planted: Sequence[tuple[int, Sequence[Turn]]] = ()) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> PART; a conversation's parts stand in one partition, in order.

    offset: characters of the conversation's output before the part. planted: further conversations by number."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.lit(False).alias("planted"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    if planted:
        rows = rows.unionByName(spark.createDataFrame([(c, True, k, r, t) for c, ts in planted for k, (r, t) in enumerate(ts)], rows.schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for (conv, own), group in _grouped(_rows(batches)):
            offset = 0
            for k, p in enumerate(located(((r[3], r[4]) for r in group), template, frozenset(loss))):
                held.append({"conv_id": conv, "planted": own, "part": k, "offset": offset, "text": p.text, "rewritten": p.rewritten, "turns": [vars(s) for s in p.spans]})
                offset += len(p.text)
                size += len(p.text) + 200
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(held, _KINDS)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _KINDS)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "planted", "turn", "role", "text").mapInArrow(run, PART)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_parts long, n_rewritten long"


def read_back(parts: DataFrame, template: Template = INSTRUCT, *, ordered: bool = False) -> DataFrame:
    """PART -> READ, a row for each conversation, from the outputs and spans alone.

    ordered: parts are as formatted() left them; otherwise they are brought together and sorted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        for (conv, _), group in _grouped(_rows(batches)):
            turns, masked = hashlib.sha256(), hashlib.sha256()
            n = under = chars = count = rewrites = 0
            for _, _, _, _, text, rewritten, spans in group:
                count, chars, rewrites = count + 1, chars + len(text), rewrites + len(rewritten)
                for s in spans:
                    role, said = template.read(text[s["start"] : s["end"]])
                    turns.update(f"{role}\n{said}\n".encode(errors="surrogatepass"))
                    n += 1
                    if s["loss"] and s["text_start"] is not None:
                        own = template.plain(text[s["text_start"] : s["text_end"]])
                        masked.update(own.encode(errors="surrogatepass"))
                        under += len(own)
            found.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": under, "loss_sha256": masked.hexdigest(), "formatted_chars": chars, "n_parts": count, "n_rewritten": rewrites})
            if len(found) == 4096:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in READ.split(", ")])
    rows = parts if ordered else parts.repartition("conv_id").sortWithinPartitions("conv_id", "planted", "part")
    return rows.select(*(c.split()[0] for c in PART.split(", ")[:6]), "turns").mapInArrow(run, READ)
