"""Queries of model containers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.shared import fresh
from ..sources import adapters as A
from ..sources import containers as C

#: Documents in a container.
HELD = 16


def _damaged(name: str, data: bytes) -> bytes:
    """Of five containers one is cut, one has another magic number, and one a wrong byte at its end."""
    rest = int(name[1:]) % 5
    return data[:-1] if rest == 1 else b"X" + data[1:] if rest == 2 else data[:-1] + bytes([data[-1] ^ 0xFF]) if rest == 3 else data


@query(
    "A31_container_read",
    f"""WITH d AS (SELECT doc_id // {HELD} AS b, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
raw AS (SELECT b, row_number() OVER w - 1 AS section, doc_id, text, ceil(strlen(text) / {C.BLOCK}) * {C.BLOCK} AS room FROM d WINDOW w AS (PARTITION BY b ORDER BY doc_id)),
s AS (SELECT b, section, 'GenericBinaryData' AS data_type, doc_id AS key, text AS content, CASE WHEN text = '' THEN 'empty' END AS error, coalesce(sum(room) OVER (PARTITION BY b ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM raw
  UNION ALL SELECT b, max(section) + 1, 'HF_Tokenizer_Zlib', -1, any_value(l.langs), CASE b % 5 WHEN 1 THEN 'truncated' WHEN 3 THEN 'compressed data' END, sum(room) FROM raw JOIN (SELECT b, string_agg(lang, ',' ORDER BY doc_id) AS langs FROM d GROUP BY b) l USING (b) GROUP BY b)
SELECT 'c' || b AS name, section::INTEGER AS section, data_type, key::VARCHAR AS key, begin::BIGINT AS begin, CASE WHEN error IS NULL THEN strlen(content) END::BIGINT AS n_bytes, CASE WHEN error IS NULL THEN md5(content) END AS digest, error FROM s WHERE b % 5 <> 2
UNION ALL SELECT DISTINCT 'c' || b, NULL, NULL, NULL, NULL, NULL, NULL, 'magic' FROM d WHERE b % 5 = 2""",
)
def container_read(spark, sf):
    """Containers of a few documents each, written as files and read back by sections; some are damaged."""
    docs = A.table(spark, sf, "documents").select(F.expr(f"concat('c', doc_id div {HELD})").alias("name"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    order = Window.partitionBy("name").orderBy("doc_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = docs.withColumns({"section": F.row_number().over(order), "held": F.count("*").over(whole).cast("int"), "langs": F.array_join(F.collect_list("lang").over(whole), ",")})

    def section(place, kind, key, text):
        return F.struct(place.alias("section"), F.lit(kind).alias("data_type"), key.cast("long").alias("key"), F.encode(text, "utf-8").alias("content"))

    # the languages follow a container's last text: so the rows stay where the window dealt them
    own, last = section(F.col("section"), "GenericBinaryData", F.col("doc_id"), F.col("text")), section(F.col("section") + 1, C.COMPRESSED, F.lit(-1), F.col("langs"))
    rows = placed.select("name", F.explode(F.when(F.col("section") == F.col("held"), F.array(own, last)).otherwise(F.array(own))).alias("s")).select("name", "s.*")
    folder = fresh(spark, "containers")
    C.write_containers(rows, folder, _damaged).write.format("noop").mode("overwrite").save()
    read = C.read_containers(spark, folder)
    # digests first: what meets the other sections of a file are then small rows
    found = read.select("path", "section", "data_type", "begin_offset", F.get("items", F.lit(0))["value"].alias("key"), F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"), "error")
    first = F.min("begin_offset").over(Window.partitionBy("path"))
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "section", "data_type", "key", (F.col("begin_offset") - first).alias("begin"), "n_bytes", "digest", "error")


@query("A38_capability_scan", f"SELECT DISTINCT 'c' || doc_id // {HELD} AS name, doc_id // {HELD} % 5 = 0 AS drafter FROM documents")
def capability_scan(spark, sf):
    """Which containers hold a drafter model, told from their headers alone; tokenizers may carry the same item."""
    docs = A.table(spark, sf, "documents").selectExpr(f"doc_id div {HELD} AS b", "doc_id").groupBy("b").agg(F.min("doc_id").alias("key"))
    model = docs.selectExpr("concat('c', b) AS name", "0 AS section", "'TFLiteModel' AS data_type", "key", "IF(b % 5 = 0, 'drafter', 'main') AS model_type", "CAST('m' AS BINARY) AS content")
    other = docs.selectExpr("concat('c', b) AS name", "1 AS section", "'SP_Tokenizer' AS data_type", "key", "'drafter' AS model_type", "CAST('t' AS BINARY) AS content")
    folder = fresh(spark, "containers")
    # dealt by number: the rows are small, a container each is not, and few tasks would be left of them
    rows = model.unionByName(other).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    C.write_containers(rows, folder).write.format("noop").mode("overwrite").save()
    found = C.has_model(C.read_containers(spark, folder, content=False), "drafter")
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("found").alias("drafter"))
