import pytest
from pyspark.sql import functions as F

from palimpsest import catalog  # noqa: F401  plans import each other through it
from palimpsest.operators import projection as P
from palimpsest.operators import replay as R
from palimpsest.operators import stores as S
from palimpsest.plans import replay as Q
from palimpsest.plans.composites import _BOUND
from palimpsest.sources import adapters as A


def checkpoints(spark, sf, log):
    c = A.ckpt(spark, sf).filter("level = 0 AND user_id < 6").selectExpr("* EXCEPT (body_hash, body_size)", *[f"{v} AS {n}" for n, v in _BOUND.items()])
    made = c.join(R.replayed(c, log, P.stand_in, Q.CONFIG), "hash").withColumn("body", F.coalesce("replay", F.lit("{}")))
    return made.withColumn("body", F.when(F.col("w") == 1, F.concat("body", F.lit(" "))).otherwise(F.col("body"))).drop("hash", "replay", "replay_error")


def test_checkpoints_are_audited_from_the_store(spark, sf, tmp_path):
    log = A.ev_stream(spark, sf)
    rows = checkpoints(spark, sf, log)
    n = rows.count()
    store = S.CheckpointStore(spark, str(tmp_path / "s"))
    bodies, manifests = store.put(rows)
    assert manifests == n and 0 < bodies <= n
    assert store.put(rows) == (0, 0) and store.manifests.rows().count() == n  # again changes nothing
    assert store.read().filter("fault IS NOT NULL").count() == 0
    found = R.audit(store.read().drop("fault", "session_id", "parent_hashes"), log, store.edges(), P.stand_in, Q.AUDITOR)
    assert {r.verdict for r in found.results.collect()} == {"pass", "correction_emitted"} and found.results.count() == n
    ledger = S.AuditLedger(spark, str(tmp_path / "l"))
    signed = found.certificates.withColumn("signatures", F.array(F.struct(F.lit("ed25519").alias("algorithm"), F.lit("k").alias("key_id"), F.lit("s").alias("signature"))))
    assert ledger.put(signed) == n and ledger.put(signed) == 0
    assert {(r.checkpoint_hash, r.verdict) for r in ledger.latest().collect()} == {(r.hash, r.verdict) for r in found.results.collect()}
    dag = S.ProvenanceStore(spark, str(tmp_path / "d"))
    assert dag.put(found.nodes) == n and dag.put(found.nodes) == 0 and dag.unknown().count() == n  # checkpoints are no nodes yet
    dag.put(store.manifests.rows().select("hash", "parent_hashes", "created_us", F.lit("checkpoint").alias("annotations")))
    assert dag.unknown().count() == 0
    one = found.nodes.limit(1).select("hash", "parent_hashes").first()
    seeds = spark.createDataFrame([(one.hash,)], "hash string")
    assert {(r.node, r.level) for r in dag.ancestors(seeds).collect()} == {(one.hash, 0), (one.parent_hashes[0], 1)}


def test_damage_is_told(spark, tmp_path):
    store = S.CheckpointStore(spark, str(tmp_path))
    row = {"tenant_id": "t", "session_id": "s", "level": 0, "parent_hashes": [], "range_start": 0, "range_end": 1, "created_us": 1} | {"branch_id": "m", "compaction_interval": 1, "architecture_tag": "a", "producer_id": "p", "runtime_version": "1", "artifact_hash": "ab" * 32, "model_id": "m", "schema_id": "s", "schema_hash": "cd" * 32}
    row |= {"model_class": 1, "num_layers": 1, "num_kv_heads": 1, "head_dim": 1, "kv_dtype": 0, "base_event_index": 0}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in row.items())
    rows = spark.createDataFrame([(*row.values(), b) for b in ("one", "two")], schema + ", body string")
    assert store.put(rows) == (2, 2)
    assert {r.fault for r in store.read().collect()} == {None} and store.dependents(store.manifests.rows().select("hash")).count() == 0
    good = store.read().filter("body = 'one'").first()
    bad = spark.createDataFrame([("x" * 64, "s", bytes(good.data), good.body_hash, [good.hash], 1), ("y" * 64, "s", b"", "0" * 64, [], 1)], "hash string, session_id string, data binary, body_hash string, parent_hashes array<string>, created_us long")
    store.manifests.put(bad, "session_id")
    store.payloads.put(spark.createDataFrame([("0" * 64, "not it")], "body_hash string, body string"), "body_hash")
    faults = {r.hash: r.fault for r in store.read().collect()}
    assert faults["x" * 64] == faults["y" * 64] == "manifest hash" and [r.dependent for r in store.dependents(spark.createDataFrame([(good.hash,)], "hash string")).collect()] == ["x" * 64]


def test_refusals(spark, tmp_path):
    dag = S.ProvenanceStore(spark, str(tmp_path))
    node = "hash string, parent_hashes array<string>, created_us long, annotations string"
    for bad in ((None, [], 1, ""), ("a", ["a"], 1, "")):
        with pytest.raises(ValueError):
            dag.put(spark.createDataFrame([bad], node))
    assert dag.nodes.rows().count() == 0 and dag.unknown().count() == 0
    ledger = S.AuditLedger(spark, str(tmp_path), verifier=lambda rows: rows.withColumn("valid", F.filter("signatures", lambda s: s["algorithm"] == "ed25519")))
    with pytest.raises(ValueError, match="valid certificate"):
        ledger.put(spark.createDataFrame([(b"no", [])], "canonical binary, signatures array<struct<algorithm: string, key_id: string, signature: string>>"))
    assert ledger.read().count() == 0 and ledger.latest().count() == 0
