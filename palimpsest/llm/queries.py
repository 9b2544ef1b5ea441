"""The queries of this folder's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, digest, langid, media, mixing, packing, pii, sharding, simhash, substring, suffix, trie, variants
from .common import documents


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality weights from labels: 2 for good, 0.5 for bad documents; mixing gives the others 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality IS NOT NULL")
    return labels.groupBy("doc_id").agg(F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("grade"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), grades=graded(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH lab AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END AS grade FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / coalesce(lab.grade, 1.0) AS key
  FROM documents d LEFT JOIN lab USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 2.0 * source_size::DOUBLE AS cap FROM r),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS goal, coalesce(sum(cap) OVER pre, 0) AS cap_before, coalesce(sum(weight) OVER pre, 0) AS weight_before, sum(weight) OVER () AS weight_all
  FROM w WINDOW pre AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap <= weight * (goal - cap_before) / (weight_all - weight_before)::DOUBLE AS capped FROM o),
l AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * ((goal - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE) END AS target FROM c),
e AS (SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS epochs FROM l),
b AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size
    - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM b
"""


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(documents(spark, sf_dir))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_neighbours(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 16).drop("group_md5")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    marked = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(marked, langid.train(docs), ["doc_id", "held_out"])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir).select("doc_id", "text"), "palimpsest", counts=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(documents(spark, sf_dir))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, unnest(generate_series(1, len(ws) - 34)) AS k, ws FROM w WHERE len(ws) >= 35),
n AS (SELECT r, k, md5(array_to_string(ws[k:k + 34], ' ')) AS name FROM p),
hit AS (SELECT r, k FROM n WHERE name IN (SELECT name FROM n GROUP BY name HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(generate_series(k, k + 34)) AS k FROM hit),
g AS (SELECT r, list(k) AS ks FROM gone GROUP BY r),
one AS (SELECT r, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS k FROM w),
kept AS (SELECT o.r, string_agg(o.word, ' ' ORDER BY o.k) AS t FROM one o LEFT JOIN gone x ON x.r = o.r AND x.k = o.k WHERE x.k IS NULL GROUP BY o.r)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(len(g.ks), 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""

OP9_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(generate_series(0, length(x) // 2 - 100)) AS k, x FROM h WHERE length(x) >= 200),
n AS (SELECT doc_id, k, md5(substr(x, 2 * k + 1, 200)) AS name FROM p),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY name ORDER BY doc_id, k) > 1 AS again FROM n),
e AS (SELECT doc_id, k AS pos, 1 AS step FROM f WHERE again UNION ALL SELECT doc_id, k + 100, -1 FROM f WHERE again),
s AS (SELECT doc_id, pos, sum(sum(step)) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM e GROUP BY doc_id, pos),
t AS (SELECT doc_id, pos, depth, lag(depth, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s),
edge AS (SELECT doc_id, pos, depth > 0 AS opens FROM t WHERE (depth > 0) <> (before > 0)),
span AS (SELECT doc_id, pos AS lo, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS hi, opens FROM edge),
gap AS (SELECT h.doc_id, 0 AS lo, coalesce(min(span.lo), length(any_value(h.x)) // 2) AS hi FROM h LEFT JOIN span ON span.doc_id = h.doc_id GROUP BY h.doc_id
  UNION ALL SELECT span.doc_id, span.lo, coalesce(span.hi, length(h.x) // 2) FROM span JOIN h USING (doc_id) WHERE NOT opens),
kept AS (SELECT gap.doc_id, string_agg(substr(h.x, 2 * gap.lo + 1, 2 * (gap.hi - gap.lo)), '' ORDER BY gap.lo) AS x FROM gap JOIN h USING (doc_id) GROUP BY gap.doc_id),
c AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM span WHERE opens GROUP BY doc_id)
SELECT h.doc_id, (length(h.x) // 2)::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM h LEFT JOIN c USING (doc_id) JOIN kept USING (doc_id)
"""

def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


#: A conversation whose texts are made of the template's control strings.
PLANTED = (-1, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.formatted(conversations(spark, sf_dir), planted=[PLANTED]), ordered=True).drop("n_parts")


OP11_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS planted FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]', true FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)((?:/?INST|/?ROLE|TEXT)\])', '\1\\\2', 'g')) AS n,
  length(regexp_replace(regexp_replace(role, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)((?:/?INST|/?ROLE|TEXT)\])', '\1\\\2', 'g')) AS role_n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  (3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 23 + role_n END))::BIGINT AS formatted_chars,
  0::BIGINT AS n_rewritten
FROM e GROUP BY conv_id, planted
"""


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(conversations(spark, sf_dir))


#: CRC-32's table of 256, and the checksum of the bytes of a string x with it.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce([4294967295] || list_transform(range(strlen({x})), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"

OP12_SQL = rf"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations),
ids AS (SELECT DISTINCT conv_id FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, coalesce({_CRC.format(x="conv_id::VARCHAR")} % 6, 0) AS h FROM ids, crc),
r AS (SELECT h.conv_id, 0 AS own, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, 1, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id IS NOT DISTINCT FROM h.conv_id AND t.pos > h.h),
k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS pos, md5(length(role) || ':' || role || text) AS turn, length(text) AS chars FROM r),
p AS (SELECT h.conv_id, coalesce(list(k.turn ORDER BY k.pos) FILTER (k.pos IS NOT NULL), []) AS turns, coalesce(list(k.chars ORDER BY k.pos) FILTER (k.pos IS NOT NULL), []) AS chars FROM h LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM h.conv_id GROUP BY h.conv_id),
x AS (SELECT conv_id, turns, chars, unnest(range(len(turns) + 1)) AS depth FROM p),
n AS (SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '') AS ends FROM x GROUP BY ALL),
c AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, path)),
s AS (SELECT a.depth, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved FROM m a JOIN m b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (depth, path) LEFT JOIN m up ON up.depth = m.depth - 1 AND up.path = m.path[1:m.depth - 1]
"""


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(documents(spark, sf_dir))


OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS x, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_CRC.format(x="x")} AS h FROM counted, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM made GROUP BY word HAVING length(word) >= 7 AND sum(made.n) >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.rest, c.word, c.n FROM cut c JOIN v ON v.word = c.rest UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.rest),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
form AS (SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN best.top >= 10 * v.n THEN best.top END AS form_n FROM v LEFT JOIN best USING (word)),
forms AS (SELECT form.*, min(near.other) AS form FROM form LEFT JOIN near ON near.word = form.word AND near.n = form.form_n GROUP BY ALL),
chain AS (SELECT word, word AS place, 0 AS steps FROM forms UNION ALL SELECT chain.word, forms.form, steps + 1 FROM chain JOIN forms ON forms.word = chain.place WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, r.root, forms.n, forms.n_near::BIGINT AS n_near, forms.form_n::BIGINT AS form_n FROM forms JOIN (SELECT word, arg_max(place, steps) AS root FROM chain GROUP BY word) r USING (word)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_media": op2_media,
    "op3_fingerprint": op3_fingerprint,
    "op4_sharding": op4_sharding,
    "op5_langid": op5_langid,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_substring": op8_substring,
    "op9_suffix": op9_suffix,
    "op10_simhash": op10_simhash,
    "op11_chat": op11_chat,
    "op12_trie": op12_trie,
    "op13_variants": op13_variants,
}
ORACLE: dict[str, str] = {"op1_mixing": OP1_SQL, "op8_substring": OP8_SQL, "op9_suffix": OP9_SQL, "op11_chat": OP11_SQL, "op12_trie": OP12_SQL, "op13_variants": OP13_SQL}
