"""Streaming decoding: byte pieces are merged into characters, and what may become a stop sequence is held back.

A token is a byte (0 to 255) or, where that is null, a piece of text, in which ▁ stands for a space. ``Decoder`` is the state of one
session and its step; the streaming operator keeps it between triggers, the batch operator folds it over a session's tokens, which
arrive sorted and stream through a task, so any division of a token stream into batches gives the same text.

Rules. Bytes from 128 wait for the next piece, and are then decoded together, an invalid one as U+FFFD; one below 128 is text at
once, after the whole characters before it. Tokens that end in an incomplete character are kept and decoded again with the next. A
stop sequence's progress goes on with its next token, else restarts at its first or at none; as many texts as the longest progress
are held back, and dropped if it completes. Only sequences in progress and those that begin with the token are looked at, so there
may be many.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Token = tuple[int | None, str | None]
LOST = "�"


def _decoded(data: bytes | bytearray) -> tuple[str, int]:
    """UTF-8, each byte that begins no whole character as U+FFFD, and where the last whole character ends."""
    out, at, end, view = [], 0, 0, memoryview(data)
    while at < len(data):
        try:
            out.append(str(view[at:], "utf-8"))
            return "".join(out), len(data)
        except UnicodeDecodeError as e:
            if e.start:
                end = at + e.start
                out.append(str(view[at:end], "utf-8"))
            out.append(LOST)
            at += e.start + 1
    return "".join(out), end


def bytes_text(data: bytes | bytearray) -> str:
    """UTF-8, each byte that begins no whole character as U+FFFD."""
    return _decoded(data)[0]


def pieces_text(tokens: Iterable[Token]) -> tuple[str, bool]:
    """The text, and whether it is whole: not ending in bytes that need more. A byte below 128 comes after the whole characters
    before it, and before bytes that may still become one."""
    out, held, lost = [], bytearray(), 0  # lost: so many bytes at the start of held began no character when last looked at
    for byte, piece in tokens:
        if byte is None:
            if held:
                out.append(bytes_text(held))
                held, lost = bytearray(), 0
            out.append(piece or "")
        elif byte >= 128:
            held.append(byte)
        else:
            if len(held) > lost:
                sure = max(0, lost - 3)  # a character has four bytes at most
                text, end = _decoded(held[sure:])
                if end:
                    rest = len(held) - sure - end
                    out.append(LOST * sure + text[: len(text) - rest])
                    held = held[sure + end :]
                lost = len(held)
            out.append(chr(byte))
    last = bytes_text(held)
    out.append(last)
    return "".join(out), not last.endswith(LOST)


@dataclass
class Stops:
    sequences: list[list[Token]]
    first: dict[Token, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not all(self.sequences):
            raise ValueError("a stop sequence is empty")
        for k, s in enumerate(self.sequences):
            self.first.setdefault(s[0], []).append(k)

    def step(self, progress: dict[int, int], token: Token) -> tuple[dict[int, int], bool]:
        """Progress of the sequences that have any, and whether one is complete. A complete one starts anew with the next token."""
        out = {k: 1 for k in self.first.get(token, ())}
        for k, n in progress.items():
            if n < len(self.sequences[k]) and self.sequences[k][n] == token:
                out[k] = n + 1
        return out, any(n == len(self.sequences[k]) for k, n in out.items())


@dataclass
class Decoder:
    stops: Stops
    partial: list[Token] = field(default_factory=list)
    progress: dict[int, int] = field(default_factory=dict)
    pending: list[str] = field(default_factory=list)
    stopped: bool = False
    tokens: int = 0

    def step(self, token: Token) -> str:
        """The text that is safe now."""
        if self.stopped:
            return ""
        self.tokens += 1
        self.progress, self.stopped = self.stops.step(self.progress, token)
        merged = [*self.partial, token]
        text, whole = pieces_text(merged)
        if not whole:
            self.partial = merged
            return ""
        if self.stopped:
            return ""
        self.partial = []
        self.pending.append(text)
        # a text may be of several tokens, so there may be fewer than the progress counts
        safe = max(0, len(self.pending) - max(self.progress.values(), default=0))
        out, self.pending = self.pending[:safe], self.pending[safe:]
        return "".join(out).replace("▁", " ")

    def saved(self) -> tuple[str, bool, int]:
        return json.dumps([self.partial, list(self.progress.items()), self.pending]), self.stopped, self.tokens

    @classmethod
    def restored(cls, stops: Stops, saved: tuple[str, bool, int]) -> Decoder:
        partial, progress, pending = json.loads(saved[0])
        return cls(stops, [tuple(t) for t in partial], dict(map(tuple, progress)), pending, saved[1], saved[2])


def decode_stream(tokens: DataFrame, stops: list[list[Token]]) -> DataFrame:
    """tokens (session_id, seq, byte, piece), a session's in order of seq within and between batches -> session_id, seq, text."""
    known = Stops(stops)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        d = Decoder.restored(known, state.get) if state.exists else Decoder(known)
        rows = []
        for t in pd.concat(list(batches)).sort_values("seq").itertuples():
            text = d.step((None if pd.isna(t.byte) else int(t.byte), None if t.piece is None or pd.isna(t.piece) else t.piece))
            if text:
                rows.append((key[0], int(t.seq), text))
        state.update(d.saved())
        yield pd.DataFrame(rows, columns=["session_id", "seq", "text"])

    return tokens.groupBy("session_id").applyInPandasWithState(run, "session_id string, seq long, text string", "held string, stopped boolean, tokens long", "append", "NoTimeout")


def decoded(tokens: DataFrame, stops: list[list[Token]]) -> DataFrame:
    """The batch twin: session_id, text, stopped, n_tokens up to the stop, held (texts held back at the end)."""
    known = Stops(stops)
    schema = pa.schema([("session_id", pa.string()), ("text", pa.string()), ("stopped", pa.bool_()), ("n_tokens", pa.int64()), ("held", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[dict] = []
        for session, group in groupby(rows, key=lambda r: r[0]):
            d = Decoder(known)
            text = "".join(d.step((byte, piece)) for _, byte, piece in group)
            out.append({"session_id": session, "text": text, "stopped": d.stopped, "n_tokens": d.tokens, "held": len(d.pending)})
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = tokens.repartition("session_id").sortWithinPartitions("session_id", "seq").select("session_id", F.col("byte").cast("int"), "piece")
    return rows.mapInArrow(run, "session_id string, text string, stopped boolean, n_tokens long, held int")


#: Rows whose texts are put together before they go back to Spark.
JOINED_ROWS = 256


def pieces(text: str, size: int = 6) -> Iterator[Token]:
    """Tokens of a text: pieces of up to size ASCII characters, spaces as ▁, and the bytes of every other character."""
    for run in re.finditer(rf"[^\x00-\x7F]+|[\x00-\x7F]{{1,{size}}}", text):
        if (t := run[0]).isascii():
            yield None, t.replace(" ", "▁")
        else:
            yield from ((byte, None) for byte in t.encode())


def joined(rows: DataFrame, tokens: str, text: str | None = None) -> DataFrame:
    """rows with text and whole (whether it ends in a whole character) in place of tokens, array<struct<byte, piece>>. Where text
    names a column, the tokens of its texts come first: they are made where they are read, one text's at a time."""
    names = [c for c in rows.columns if c not in (tokens, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, JOINED_ROWS):
                b = whole.slice(first, JOINED_ROWS)
                said = b.column(text) if text else pa.nulls(b.num_rows)
                texts, wholes = [], []
                for ts, t in zip(b.column(tokens), said):
                    own, before = ts.as_py(), t.as_py()
                    if own is None:
                        found = None, True
                    else:
                        found = pieces_text(chain(pieces(before) if before is not None else (), ((x["byte"], x["piece"]) for x in own)))
                    texts.append(found[0])
                    wholes.append(found[1])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array(wholes, pa.bool_())], names=[*names, "text", "whole"])

    kinds = "".join(f"`{c}` {k}, " for c, k in rows.dtypes if c in names)
    return rows.mapInArrow(run, f"{kinds}text string, whole boolean")
