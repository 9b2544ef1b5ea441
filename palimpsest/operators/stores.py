"""Stores of checkpoints, provenance and certificates: tables under one path, addressed by content.

Everything is keyed by a hash of itself, so a put is an append of what is not there yet: putting twice, or again after a failure, changes
nothing, and what a task wrote twice reads as one. Reads verify: a row whose hash does not fit its content is returned as such, never as
good. Puts read keys only; a store is partitioned by session bucket, so a session's reads prune.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec as K
from . import audit, graph
from .shared import written

BUCKETS = 64
#: Parents that a node may have.
PARENTS = 65_535

#: rows (certificate_id, canonical, signatures) -> the same rows with valid, the signatures that hold.
Verifier = Callable[[DataFrame], DataFrame]


class _Table:
    """An append-only table of rows that key names."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.columns = spark.createDataFrame([], schema).columns

    def rows(self) -> DataFrame:
        found = self.spark.read.schema(self.schema + ", bucket INT").parquet(self.path) if self._there() else self.spark.createDataFrame([], self.schema + ", bucket INT")
        return found.drop("bucket").dropDuplicates([self.key])

    def _there(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def put(self, rows: DataFrame, by: str) -> int:
        """How many were new. by: the column whose buckets are the partitions."""
        new = rows.dropDuplicates([self.key])
        if self._there():
            new = new.join(self.spark.read.schema(self.schema + ", bucket INT").parquet(self.path).select(self.key), self.key, "left_anti")
        # written first: what is appended was decided once
        new = written(new.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(BUCKETS)).cast("int")).select(*self.columns, "bucket"), "put")
        n = new.count()
        if n:
            new.write.mode("append").partitionBy("bucket").parquet(self.path)
        return n


class CheckpointStore:
    """Payloads by the hash of their body, manifests by the hash of their canonical bytes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.payloads = _Table(spark, f"{path}/payloads", "body_hash STRING, body STRING", "body_hash")
        self.manifests = _Table(spark, f"{path}/manifests", "hash STRING, session_id STRING, data BINARY, body_hash STRING, parent_hashes ARRAY<STRING>, created_us LONG", "hash")

    def put(self, checkpoints: DataFrame) -> tuple[int, int]:
        """checkpoints with body and the columns of a manifest but body_hash and body_size -> new payloads and manifests. Payloads go
        first: a manifest never stands without one."""
        rows = checkpoints.withColumns({"body_hash": F.sha2("body", 256), "body_size": F.octet_length("body")}).withColumn("data", K.encoded(K.MANIFEST)).withColumn("hash", F.sha2("data", 256))
        rows = written(rows, "checkpoints")
        return self.payloads.put(rows.select("body_hash", "body"), "body_hash"), self.manifests.put(rows.select("hash", "session_id", "data", "body_hash", "parent_hashes", "created_us"), "session_id")

    def read(self) -> DataFrame:
        """hash, session_id, data, digest, body_hash, body, parent_hashes, created_us, fault: what replay audits take. Faults: manifest hash,
        payload missing, payload hash."""
        rows = self.manifests.rows().join(self.payloads.rows(), "body_hash", "left").withColumn("digest", F.sha2("data", 256))
        c = F.col
        return rows.withColumn("fault", audit.refusal((c("digest") != c("hash"), "manifest hash"), (c("body").isNull(), "payload missing"), (F.sha2("body", 256) != c("body_hash"), "payload hash")))

    def edges(self) -> DataFrame:
        """(src, dst): dst was built on src."""
        return self.manifests.rows().select(F.explode("parent_hashes").alias("src"), F.col("hash").alias("dst"))

    def dependents(self, hashes: DataFrame) -> DataFrame:
        """hashes (hash) -> hash, dependent: manifests that name it as a parent."""
        return hashes.join(self.edges(), F.col("hash") == F.col("src")).select("hash", F.col("dst").alias("dependent"))


class ProvenanceStore:
    """A graph of nodes (hash, parent_hashes, created_us, annotations)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.nodes = _Table(spark, f"{path}/nodes", "hash STRING, parent_hashes ARRAY<STRING>, created_us LONG, annotations STRING", "hash")

    def put(self, nodes: DataFrame) -> int:
        """Refuses nodes without a hash, with themselves as a parent, or with too many."""
        bad = nodes.filter(F.col("hash").isNull() | F.array_contains("parent_hashes", F.col("hash")) | (F.size("parent_hashes") > PARENTS))
        if bad.limit(1).count():
            raise ValueError("a node needs a hash, and other nodes as parents, at most 65535")
        return self.nodes.put(nodes, "hash")

    def ancestors(self, seeds: DataFrame) -> DataFrame:
        """seeds (hash) -> seed, node, level; ancestors that are not stored are listed too."""
        up = written(self.nodes.rows().select(F.col("hash").alias("src"), F.explode("parent_hashes").alias("dst")), "edges")
        return graph.reachable(up, seeds.select(F.col("hash").alias("seed"), F.col("hash").alias("node")))

    def unknown(self) -> DataFrame:
        """Parents that are no nodes."""
        rows = self.nodes.rows()
        return rows.select(F.explode("parent_hashes").alias("hash")).distinct().join(rows.select("hash"), "hash", "left_anti")


def _certificates(batches):
    for b in batches:
        rows = []
        for key, data in zip(b["certificate_id"], b["canonical"]):
            f, error = K.decoded_certificate(bytes(data))
            rows.append((key, error, f.get("checkpoint_manifest_hash"), f.get("session_id"), f.get("verdict"), f.get("drift_score"), f.get("event_range_start"), f.get("event_range_end"), f.get("created_unix_micros")))
        yield pd.DataFrame(rows, columns=["certificate_id", "error", "checkpoint_hash", "session_id", "verdict", "drift_score", "covered_start", "covered_end", "created_us"]).astype({c: "Int64" for c in ("covered_start", "covered_end", "created_us")})


class AuditLedger:
    """Certificates as canonical bytes with their signatures."""

    FIELDS = "certificate_id string, error string, checkpoint_hash string, session_id string, verdict string, drift_score double, covered_start long, covered_end long, created_us long"

    def __init__(self, spark: SparkSession, path: str, verifier: Verifier | None = None) -> None:
        self.table = _Table(spark, f"{path}/certificates", "certificate_id STRING, canonical BINARY, signatures ARRAY<STRUCT<algorithm: STRING, key_id: STRING, signature: STRING>>", "certificate_id")
        self.verifier = verifier

    def put(self, certificates: DataFrame) -> int:
        """certificates (canonical, signatures); refuses bytes that are no valid certificate. Ids are computed here."""
        rows = written(certificates.select(F.sha2("canonical", 256).alias("certificate_id"), "canonical", "signatures"), "certificates")
        if rows.select("certificate_id", "canonical").mapInPandas(_certificates, self.FIELDS).filter("error <> ''").limit(1).count():
            raise ValueError("not a valid certificate")
        return self.table.put(rows, "certificate_id")

    def read(self) -> DataFrame:
        """FIELDS, signatures, and valid, those that the verifier accepts (all, if there is none); error is also ``id`` where the stored id
        is not the bytes' own."""
        rows = self.table.rows()
        held = self.verifier(rows) if self.verifier else rows.withColumn("valid", F.col("signatures"))
        fields = rows.select("certificate_id", "canonical").mapInPandas(_certificates, self.FIELDS)
        joined = fields.join(held.select("certificate_id", "canonical", "signatures", "valid"), "certificate_id")
        return joined.withColumn("error", F.when(F.sha2("canonical", 256) != F.col("certificate_id"), "id").otherwise(F.col("error"))).drop("canonical")

    def latest(self) -> DataFrame:
        """The newest sound certificate of each checkpoint, ties by id."""
        return audit.latest(self.read().filter("error = ''").withColumn("issued", F.col("certificate_id")))
