"""Canonical bytes of manifests and certificates: little-endian numbers, length-prefixed strings and lists, hashes, in a fixed order."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the bytes begin with, and the version after it.
MAGIC, VERSION = b"DPMMANIFEST\n", 2
#: Fields and kinds in order: u32 and u64 numbers, f64, str, a list of strings, hash, and a list of hashes.
MANIFEST = [
    ("tenant_id", "str"), ("session_id", "str"), ("branch_id", "str"), ("level", "u32"), ("compaction_interval", "u32"), ("parent_hashes", "hashes"), ("architecture_tag", "str"), ("producer_id", "str"), ("runtime_version", "str"),
    ("artifact_hash", "hash"), ("model_id", "str"), ("schema_id", "str"), ("schema_hash", "hash"), ("model_class", "u32"), ("num_layers", "u32"), ("num_kv_heads", "u32"), ("head_dim", "u32"), ("kv_dtype", "u32"),
    ("range_start", "u64"), ("range_end", "u64"), ("base_event_index", "u64"), ("body_hash", "hash"), ("body_size", "u32"), ("created_us", "u64"),
]


CERTIFICATE_VERSION = 1
CERTIFICATE = [
    ("checkpoint_manifest_hash", "hash"), ("checkpoint_body_hash", "hash"), ("tenant_id", "str"), ("session_id", "str"), ("branch_id", "str"), ("event_range_start", "u64"), ("event_range_end", "u64"), ("log_generation", "u64"),
    ("schema_id", "str"), ("model_artifact_hash", "hash"), ("projection_model_id", "str"), ("auditor_model_id", "str"), ("audit_policy_version", "str"), ("verdict", "str"), ("drift_score", "f64"), ("drift_fields", "strs"),
    ("correction_event_ids", "strs"), ("provenance_root_hash", "hash"), ("created_unix_micros", "u64"), ("expires_unix_micros", "u64"),
]
VERDICTS = ("pending", "pass", "correction_emitted", "inconclusive")
ZERO = "0" * 64


def number(value: Column, size: int) -> Column:
    """As hexadecimal digits, the lowest byte first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def double_bits(x: Column) -> Column:
    """The bits of a double that is not negative, as a long: exponent and fraction, each exact."""
    near = F.floor(F.log2(x))
    e = near - (x < F.pow(F.lit(2.0), near)).cast("long") + (x >= F.pow(F.lit(2.0), near + 1)).cast("long")
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((x / F.pow(F.lit(2.0), e) - 1) * 2.0**52).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when(x < 2.0**-1022, (x * 2.0**537 * 2.0**537).cast("long")).otherwise(normal)


def string(c: Column) -> Column:
    return F.concat(number(F.octet_length(c), 4), F.hex(F.encode(c, "utf-8")))


def encoded(fields: list[tuple[str, str]], head: bytes = MAGIC + struct.pack("<I", VERSION)) -> Column:
    """The canonical bytes of a row with these columns."""

    def part(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "str":
            return string(c)
        if kind in ("hashes", "strs"):
            return F.concat(number(F.size(c), 4), F.array_join(c if kind == "hashes" else F.transform(c, string), ""))
        return c if kind == "hash" else number(double_bits(c) if kind == "f64" else c, 4 if kind == "u32" else 8)

    return F.unhex(F.concat(F.lit(head.hex()), *[part(n, k) for n, k in fields]))


def certificate() -> Column:
    """The canonical bytes of a certificate; its id is their hash."""
    return encoded(CERTIFICATE, struct.pack("<I", CERTIFICATE_VERSION))


def envelope(canonical: Column, signatures: Column) -> Column:
    """A certificate's bytes and signatures (algorithm, key_id, signature) as stored."""
    signed = F.transform(signatures, lambda s: F.concat(string(s["algorithm"]), string(s["key_id"]), string(s["signature"])))
    return F.unhex(F.concat(F.lit(struct.pack("<I", CERTIFICATE_VERSION).hex()), number(F.octet_length(canonical), 4), F.hex(canonical), number(F.size(signatures), 4), F.array_join(signed, "")))


class _Reader:
    """Bytes from front to back; what is not there is an EOFError."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def one(self, kind: str) -> object:
        if kind in ("u32", "u64", "f64"):
            code, size = {"u32": ("<I", 4), "u64": ("<Q", 8), "f64": ("<d", 8)}[kind]
            return struct.unpack(code, self.take(size))[0]
        if kind == "hash":
            return self.take(32).hex()
        if kind == "str":
            return self.take(self.one("u32")).decode("utf-8", "replace")
        return [self.one("hash" if kind == "hashes" else "str") for _ in range(self.one("u32"))]

    @property
    def over(self) -> bool:
        return self.at == len(self.data)


def decoded(data: bytes, fields: list[tuple[str, str]], magic: bytes = MAGIC, version: int = VERSION) -> tuple[dict, str]:
    """Fields and the error: magic, version, truncated or trailing, else empty."""
    if not data.startswith(magic):
        return {}, "magic"
    r = _Reader(data[len(magic) :])
    try:
        if r.one("u32") != version:
            return {}, "version"
        out = {name: r.one(kind) for name, kind in fields}
    except EOFError:
        return {}, "truncated"
    return (out, "") if r.over else ({}, "trailing")


def certificate_fault(f: dict) -> str:
    """Why a certificate is not valid, else empty."""
    if f["verdict"] not in VERDICTS:
        return "verdict"
    if ZERO in (f["checkpoint_manifest_hash"], f["checkpoint_body_hash"]):
        return "checkpoint"
    if not (f["tenant_id"] and f["session_id"] and f["branch_id"]):
        return "identity"
    if f["event_range_end"] < f["event_range_start"]:
        return "range"
    if f["model_artifact_hash"] == ZERO or not (f["schema_id"] and f["projection_model_id"] and f["auditor_model_id"] and f["audit_policy_version"]):
        return "binding"
    if not 0.0 <= f["drift_score"] <= 1.0:
        return "drift"
    return "" if 0 < f["created_unix_micros"] < 2**63 else "created"


def decoded_certificate(data: bytes) -> tuple[dict, str]:
    f, error = decoded(data, CERTIFICATE, b"", CERTIFICATE_VERSION)
    error = error or certificate_fault(f)
    return ({}, error) if error else (f, "")


def decoded_envelope(data: bytes) -> tuple[dict, str]:
    """A stored certificate with its signatures."""
    r = _Reader(data)
    try:
        if r.one("u32") != CERTIFICATE_VERSION:
            return {}, "version"
        f, error = decoded_certificate(r.take(r.one("u32")))
        if error:
            return {}, error
        f["signatures"] = [tuple(r.one("str") for _ in range(3)) for _ in range(r.one("u32"))]
    except EOFError:
        return {}, "truncated"
    if not r.over:
        return {}, "trailing"
    return (f, "") if all(all(s) for s in f["signatures"]) else ({}, "signature")


def decode_envelopes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, data) -> key, error, session_id, verdict, drift_score, corrections, algorithms."""
    for b in batches:
        rows = []
        for k, data in zip(b["key"], b["data"]):
            f, error = decoded_envelope(bytes(data))
            rows.append((k, error, f.get("session_id"), f.get("verdict"), f.get("drift_score"), ",".join(f.get("correction_event_ids", [])), ",".join(s[0] for s in f.get("signatures", []))))
        yield pd.DataFrame(rows, columns=["key", "error", "session_id", "verdict", "drift_score", "corrections", "algorithms"])


def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(hash, data) -> hash, error, session_id, parents, range_end, created_us."""
    for b in batches:
        rows = []
        for h, data in zip(b["hash"], b["data"]):
            f, error = decoded(bytes(data), MANIFEST)
            rows.append((h, error, f.get("session_id"), ",".join(f.get("parent_hashes", [])), f.get("range_end", -1), f.get("created_us", -1)))
        yield pd.DataFrame(rows, columns=["hash", "error", "session_id", "parents", "range_end", "created_us"])
