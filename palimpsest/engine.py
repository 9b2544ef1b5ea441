"""The engine's commands over one log table: record, correct, status, events, prompt, project, audit, handoff, verify."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .functions.text import valid_identity
from .operators import eventlog, evidence, projection, replay, runner, stores

SCHEMA = "tenant_id STRING, session_id STRING, event_index LONG, type STRING, payload STRING, timestamp_us LONG, step_index LONG, tool_call_id STRING"
CORRECTION = "correction_id STRING, invalidated_facts ARRAY<STRING>, replacement_facts ARRAY<STRING>, scope STRING"
KEYS = ["tenant_id", "session_id"]


class Engine:
    """An append-only log under one path, partitioned by tenant. Appends of a batch get the next indexes of their session;
    one writer at a time, as with the reference's locks."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def init(self) -> None:
        self.spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("tenant_id").parquet(self.path)

    def log(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def record(self, events: DataFrame) -> int:
        """events (tenant_id, session_id, seq, type, payload, timestamp_us, tool_call_id); refuses bad identities and empty records."""
        bad = events.filter(~valid_identity(F.col("tenant_id")) | ~valid_identity(F.col("session_id")) | (F.octet_length("payload") == 0) | ~F.col("type").isin("user", "model", "tool", "internal", "correction"))
        if bad.limit(1).count():
            raise ValueError("identity, type or payload is not acceptable")
        ends = self.log().groupBy(*KEYS).agg((F.max("event_index") + 1).alias("_next"))
        order = F.row_number().over(_order("seq")) - 1
        new = events.withColumn("_nth", order).join(ends, KEYS, "left").withColumn("event_index", (F.coalesce("_next", F.lit(0)) + F.col("_nth")).cast("long"))
        new = eventlog.traced(new.withColumn("step_index", F.lit(0).cast("long"))).select("tenant_id", "session_id", "event_index", "type", "payload", "timestamp_us", "step_index", "tool_call_id").cache()
        n = new.count()
        new.write.mode("append").partitionBy("tenant_id").parquet(self.path)
        new.unpersist()
        return n

    def correct(self, corrections: DataFrame) -> int:
        """corrections (tenant_id, session_id, correction_id, invalidated_facts, replacement_facts, scope, timestamp_us) as events
        of their sessions, in order of id; refuses those without an id or a fact."""
        facts = F.filter("invalidated_facts", lambda f: F.trim(f) != "")
        if corrections.filter((F.coalesce("correction_id", F.lit("")) == "") | (F.coalesce(F.size(facts), F.lit(0)) < 1)).limit(1).count():
            raise ValueError("a correction needs an id and a fact that it invalidates")
        payload = F.to_json(F.struct("correction_id", facts.alias("invalidated_facts"), "replacement_facts", "scope"))
        seq = F.row_number().over(_order("correction_id")).cast("long")
        return self.record(corrections.select(*KEYS, seq.alias("seq"), F.lit("correction").alias("type"), payload.alias("payload"), "timestamp_us", F.lit(None).cast("string").alias("tool_call_id")))

    def directives(self) -> DataFrame:
        """Directives of all correction events, at their own places; JSON fields are optional."""
        c = self.log().filter("type = 'correction'").withColumn("j", F.from_json("payload", CORRECTION))
        facts = F.transform("j.invalidated_facts", lambda f: F.trim(f))
        more = [F.coalesce("j.replacement_facts", F.array().cast("array<string>")).alias("replacements"), F.lit("").alias("correction_text")]
        return c.select(*KEYS, F.coalesce("j.correction_id", F.concat(F.lit("event-"), "event_index")).alias("correction_id"), F.col("event_index").alias("correction_index"), F.col("event_index").alias("directive_index"), F.coalesce("j.scope", F.lit("prior_events")).alias("scope"), F.coalesce(facts, F.array().cast("array<string>")).alias("facts"), *more)

    def view(self) -> DataFrame:
        return evidence.active_view(self.log(), self.directives(), KEYS)

    def status(self) -> DataFrame:
        return self.log().groupBy(*KEYS).agg(F.count("*").alias("events"), F.count_if(F.col("type") == "correction").alias("corrections"), F.max("timestamp_us").alias("last_us"))

    def events(self, since: int = 0, most: int = 0) -> DataFrame:
        return eventlog.tail(eventlog.in_range(self.log(), since), most)

    def prompt(self, most: int = 0) -> DataFrame:
        """The active evidence, rendered, of each session."""
        return eventlog.render(eventlog.tail(self.view(), most), F.concat("type", F.lit(": "), "payload"))

    def memory(self, budget: int, run: runner.Runner = runner.heuristic) -> DataFrame:
        return runner.project(self.view(), budget, run)

    def project(self, run: projection.Runner, config: projection.Config) -> DataFrame:
        """Each session's memory from its active evidence, repaired within config.attempts, or why there is none."""
        return projection.project(self.log(), self.directives(), run, KEYS, config)

    def audit(self, store: stores.CheckpointStore, ledger: stores.AuditLedger, dag: stores.ProvenanceStore, run: projection.Runner, by: replay.Auditor) -> replay.Audit:
        """Replays the stored checkpoints against the log; certificates go to the ledger and, as nodes, to the provenance."""
        rows = store.read().drop("fault", "session_id", "parent_hashes")
        found = replay.audit(rows, self.log().drop("tenant_id"), store.edges(), run, by)
        unsigned = F.array().cast("array<struct<algorithm: string, key_id: string, signature: string>>")
        ledger.put(found.certificates.withColumn("signatures", unsigned))
        dag.put(found.nodes)
        return found

    def handoff(self) -> DataFrame:
        """A bundle of each session: range, digests, counts."""
        line = self.log().withColumn("_line", F.concat("type", F.lit(":"), "payload"))
        return line.groupBy(*KEYS).agg(
            F.lit(1).alias("bundle_version"), F.count("*").alias("event_count"), F.min("event_index").alias("range_start"), (F.max("event_index") + 1).alias("range_end"),
            F.expr("sha2(listagg(_line, '\n') WITHIN GROUP (ORDER BY event_index), 256)").alias("trace_digest"), F.count_if(F.col("type") == "correction").alias("corrections"),
        )

    def verify(self, bundles: DataFrame) -> DataFrame:
        """The names of the checks that fail for each bundle, against the log as it is now."""
        both = bundles.alias("b").join(self.handoff().alias("l"), KEYS, "left")
        same = lambda *names: reduce(lambda a, b: a & b, [F.col(f"b.{n}").eqNullSafe(F.col(f"l.{n}")) for n in names])
        checks = {"bundle_version": same("bundle_version"), "event_log_readable": F.col("l.event_count").isNotNull(), "trace_digest_match": same("trace_digest"), "event_count_match": same("event_count"), "event_range_match": same("range_start", "range_end"), "correction_count_match": same("corrections")}
        failed = F.array_compact(F.array(*[F.when(~holds, n) for n, holds in checks.items()]))
        return both.select(*KEYS, F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("verified"))


def _order(column: str) -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy(column)
