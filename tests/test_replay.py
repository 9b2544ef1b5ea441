"""Certificates' bytes against a plain writer, and what an audit returns beside its verdicts."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog  # noqa: F401  plans import each other through it
from palimpsest.functions import codec as K
from palimpsest.operators import projection as P
from palimpsest.operators import replay as R
from palimpsest.plans import checkpoints as C
from palimpsest.plans import replay as Q
from palimpsest.sources import adapters as A

GOOD = {
    "checkpoint_manifest_hash": "11" * 32, "checkpoint_body_hash": "22" * 32, "tenant_id": "t", "session_id": "sé", "branch_id": "main", "event_range_start": 3, "event_range_end": 9, "log_generation": 12, "schema_id": "s", "model_artifact_hash": "33" * 32,
    "projection_model_id": "m", "auditor_model_id": "a", "audit_policy_version": "v", "verdict": "pass", "drift_score": 0.3, "drift_fields": ["a", "", "ü"], "correction_event_ids": [], "provenance_root_hash": "44" * 32, "created_unix_micros": 5, "expires_unix_micros": 0,
}


def written(f):
    out = struct.pack("<I", 1)
    for name, kind in K.CERTIFICATE:
        v = f[name]
        s = lambda x: struct.pack("<I", len(x.encode())) + x.encode()
        out += bytes.fromhex(v) if kind == "hash" else s(v) if kind == "str" else struct.pack("<I", len(v)) + b"".join(map(s, v)) if kind == "strs" else struct.pack("<d" if kind == "f64" else "<Q", v)
    return out


def test_bytes_equal_a_plain_writer(spark):
    rows = [GOOD | {"drift_score": d, "session_id": s} for d, s in ((0.0, "x"), (1.0, "y"), (0.1, "z"), (2**-1022, "w"), (5e-324, "v"))]
    schema = ", ".join(f"{n} {'string' if k in ('hash', 'str') else 'array<string>' if k == 'strs' else 'double' if k == 'f64' else 'long'}" for n, k in K.CERTIFICATE)
    df = spark.createDataFrame([tuple(r[n] for n, _ in K.CERTIFICATE) for r in rows], schema)
    got = {r.session_id: bytes(r.c) for r in df.select("session_id", K.certificate().alias("c")).collect()}
    assert got == {r["session_id"]: written(r) for r in rows}
    signed = df.select("session_id", K.envelope(K.certificate(), F.array(F.struct(F.lit("ed25519").alias("algorithm"), F.lit("k").alias("key_id"), F.lit("ß").alias("signature")))).alias("e"))
    for r in signed.collect():
        f, error = K.decoded_envelope(bytes(r.e))
        assert error == "" and f["signatures"] == [("ed25519", "k", "ß")] and f["session_id"] == r.session_id


def test_bits_of_doubles(spark):
    rng = random.Random(1)
    xs = [rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(3000)] + [2.0**k for k in range(-1074, 1024, 7)] + [1 - 2**-53, 1 + 2**-52, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("bits", K.double_bits(F.col("x")))
    assert all(r.bits == struct.unpack("<q", struct.pack("<d", r.x))[0] for r in df.collect())


def test_only_whole_and_valid_certificates_are_read():
    data = written(GOOD)
    assert K.decoded_certificate(data) == (GOOD, "")
    assert all(K.decoded_certificate(data[:n])[1] == "truncated" for n in range(len(data)))
    assert K.decoded_certificate(data + b"\0")[1] == "trailing" and K.decoded_certificate(b"\2" + data[1:])[1] == "version"
    faults = [("verdict", "verdict", "other"), ("checkpoint", "checkpoint_body_hash", K.ZERO), ("identity", "branch_id", ""), ("range", "event_range_end", 2), ("binding", "model_artifact_hash", K.ZERO), ("binding", "schema_id", ""), ("drift", "drift_score", float("nan")), ("drift", "drift_score", -0.1), ("created", "created_unix_micros", 0)]
    for error, name, value in faults:
        assert K.decoded_certificate(written(GOOD | {name: value})) == ({}, error)
    empty = struct.pack("<II", 1, len(data)) + data + struct.pack("<I", 1) + struct.pack("<I", 0) * 3
    assert K.decoded_envelope(empty)[1] == "signature" and K.decoded_envelope(empty[:-1])[1] == "truncated"


@pytest.fixture(scope="module")
def audit(spark, sf):
    log = A.ev_stream(spark, sf)
    return R.audit(Q.stored(spark, sf, log), log, C._edges(spark, sf), P.stand_in, Q.AUDITOR)


def test_certificates_are_what_the_results_say(audit):
    results = {r.hash: r for r in audit.results.collect()}
    for c in audit.certificates.collect():
        f, error = K.decoded_certificate(bytes(c.canonical))
        assert error == "" and f["verdict"] == results[c.checkpoint_manifest_hash].verdict and f["provenance_root_hash"] == c.checkpoint_manifest_hash
    nodes = {r.hash: r for r in audit.nodes.collect()}
    assert nodes.keys() == {r.certificate_id for r in results.values() if r.certificate_id} and all("verdict=" in r.annotations for r in nodes.values())
    assert {r.error for r in results.values()} == {None, "manifest bytes", "manifest hash", "manifest body hash", "payload missing", "payload hash", "event range"}


def test_corrections_list_what_was_built_on_a_drifted_checkpoint(spark, sf, audit):
    edges = {}
    for e in C._edges(spark, sf).collect():
        edges.setdefault(e.src, set()).add(e.dst)
    n = 0
    for c in audit.corrections.collect():
        seen, todo = set(), [c.target]
        while todo:
            if (h := todo.pop()) not in seen:
                seen.add(h)
                todo += edges.get(h, ())
        assert c.invalidates == sorted(seen) and c.severity == "blocking" and c.must_interrupt and c.correction_id.startswith("corr-")
        assert c.drift_fields == (["projection_replay_error"] if c.correction_text.startswith("projection replay failed") else ["projected_memory_hash"])
        n += len(seen) > 1
    assert n > 5 and {tuple(c.drift_fields) for c in audit.corrections.collect()} == {("projection_replay_error",), ("projected_memory_hash",)}


def test_an_empty_store(spark, sf):
    log = A.ev_stream(spark, sf)
    none = Q.stored(spark, sf, log).limit(0)
    found = R.audit(none, log, C._edges(spark, sf), P.stand_in, Q.AUDITOR)
    assert found.results.count() == found.corrections.count() == found.certificates.count() == 0
