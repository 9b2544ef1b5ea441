"""A trie of conversations: every prefix with its members, from Spark SQL's ROLLUP over positional turn columns.

A conversation is cut into blocks of WIDTH turns, a row each with columns t1 ... tWIDTH. A turn is a struct of the MD5 of its role
and text and the characters of its text; a block's key is the node in which the block before it ended, as two 64-bit XORs over
hashes of (position, turn). ``GROUP BY block, key, ROLLUP(t1 ... tWIDTH)`` then aggregates the prefixes of all lengths of all
blocks in one shuffle, after partial aggregation; grouping_id() tells the length. So depth costs blocks, not rounds, and a
prefix that a third of all conversations share is one row a task before the shuffle.

Subtrees. The smallest member of a node owns it. A conversation owns the end of its path, from a depth on: whom it is smallest
of at one depth it is smallest of below. What a subtree sums is therefore a sum over members again, which a second ROLLUP
takes: a leaf counts at its owner; the characters saved from depth d on are, for each member, those of its turns from d on that it
does not own. No node is paired with its ancestors.

Positions come from ranges of (conv_id, turn, turn hash): rows are numbered inside a range, and a conversation that goes on in the
next range adds the counts before, one small row a range. Members that end at a node are joined into chunks of CHUNK characters
by ranges before one task hashes a node's chunks in order, as SHA-256 is sequential.

Nulls: null roles and texts are empty, null turns first, equal turns in order of the hash; repeated rows are turns each. A null
conv_id is one conversation without a number: it keeps its own turns, names a node only if nobody else is a member, and is written
as nothing in ends_sha256, before all numbers. An empty table gives no node. Other columns are ignored. A text is hashed whole.
False equality has the chance n^2 / 2^129 over n turns or prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WIDTH = 8
CHUNK = 1 << 16
#: Numbers of conversations of which one gives the others their beginning, and the lengths of that.
SHARE, HEADS = 100, 6
_T = [f"t{i}" for i in range(1, WIDTH + 1)]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id, chars."""
    spark = conversations.sparkSession
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turn_id = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id.alias("id"), F.length(text).cast("long").alias("chars"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows.repartitionByRange(ranges, "conv_id", "turn", "id").withColumn("at", F.spark_partition_id()), "turns")
    counts = rows.groupBy("conv_id", "at").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # a range continues one conversation at most: as many rows as ranges
    earlier = counts.select("conv_id", "at", F.sum("n").over(before).alias("earlier")).filter("earlier > 0")
    local = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "at").orderBy("turn", "id")).cast("long"))
    own, c = local.alias("o"), F.broadcast(earlier).alias("c")
    joined = own.join(c, (F.col("o.at") == F.col("c.at")) & F.col("o.conv_id").eqNullSafe(F.col("c.conv_id")), "left")
    return joined.select("o.conv_id", (F.col("pos") + F.coalesce("earlier", F.lit(0))).alias("pos"), "id", "chars")


def rebuilt(turns: DataFrame, share: int = SHARE, heads: int = HEADS) -> DataFrame:
    """Turns (conv_id, pos, id, chars) in which conversation c begins with the first h turns of c - c % share, instead of its own
    first h; h = crc32 of c's decimals, modulo heads. Each conversation also has a row of pos 0 without a turn."""
    conv = F.col("conv_id")
    h = F.coalesce(F.crc32(conv.cast("string").cast("binary")) % heads, F.lit(0))
    base = conv - conv % share
    first = turns.filter((conv % share == 0) & (F.col("pos") < heads)).select(conv.alias("base"), "pos", "id", "chars")
    there = first.groupBy("base").agg(F.max("pos").alias("there"))
    all_of = turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("pos"))
    own = turns.filter(F.col("pos") > h).withColumn("base", base).join(there, "base", "left")
    own = own.select("conv_id", (F.col("pos") - h + F.least(h, F.coalesce("there", F.lit(0)))).alias("pos"), "id", "chars")
    lead = all_of.select("conv_id", base.alias("base"), h.alias("h")).join(first, "base").filter("pos <= h").select("conv_id", "pos", "id", "chars")
    none = all_of.select("conv_id", "pos", F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(lead).unionByName(none)


def _hash(seed: int, pos: Column, turn_id: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos.cast("long"), turn_id)


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, k1, k2 and base (characters) of what is before, t1 ... tWIDTH."""
    pos, real = F.col("pos"), F.col("pos") > 0
    slot = (pos - 1) % WIDTH + 1
    rows = turns.groupBy("conv_id", F.floor(F.greatest(pos - 1, F.lit(0)) / WIDTH).alias("block")).agg(
        *[F.max(F.when(real & (slot == i), F.struct("id", "chars"))).alias(t) for i, t in enumerate(_T, 1)],
        *[F.bit_xor(F.when(real, _hash(s, pos, F.col("id")))).alias(f"x{s}") for s in (1, 2)],
        F.sum("chars").alias("sum"),
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select("conv_id", "block", zero(F.bit_xor("x1").over(before)).alias("k1"), zero(F.bit_xor("x2").over(before)).alias("k2"), zero(F.sum("sum").over(before)).alias("base"), *_T)


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def _path(seed: int, of: int) -> Column:
    """The node in which the first ``of`` turns of a block's row end."""
    return _xor([F.col(f"k{seed}"), *[F.when(F.col(t).isNotNull(), _hash(seed, F.col("block") * WIDTH + i, F.col(f"{t}.id"))).otherwise(F.lit(0).cast("long")) for i, t in enumerate(_T[:of], 1)]])


def rolled(rows: DataFrame, aggregates: str) -> DataFrame:
    """A row for each node: depth, d1 and d2 (the node), p1 and p2 (its parent), chars of its last turn, path (chars of all) and
    the aggregates over its members' blocks."""
    keys = ", ".join(_T)
    found = rows.sparkSession.sql(f"SELECT block, k1, k2, base, {keys}, {WIDTH} - bit_count(grouping_id()) AS level, {aggregates} FROM {{rows}} GROUP BY block, k1, k2, base, ROLLUP({keys})", rows=rows)
    last = F.get(F.array(*_T), F.col("level") - 1)
    # what a block begins with is the end of the one before; a turn that is null is not there
    found = found.filter(((F.col("level") == 0) & (F.col("block") == 0)) | ((F.col("level") > 0) & last.isNotNull()))
    depth = (F.col("block") * WIDTH + F.col("level")).alias("depth")
    zero = F.lit(0).cast("long")
    chars = F.when(F.col("level") > 0, last["chars"]).otherwise(zero)
    path = F.col("base") + reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{t}.chars"), zero) for t in _T])
    parent = lambda s: F.when(F.col("level") > 0, _path(s, WIDTH).bitwiseXOR(_hash(s, F.col("block") * WIDTH + F.col("level"), last["id"])))
    return found.select(depth, *[_path(s, WIDTH).alias(f"d{s}") for s in (1, 2)], *[parent(s).alias(f"p{s}") for s in (1, 2)], chars.alias("chars"), path.alias("path"), *[c for c in found.columns if c not in ("block", "k1", "k2", "base", "level", *_T)], "level")


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, d1, d2) -> (d1, d2, ends_sha256): of the decimal numbers of each node's members, ascending, comma-joined."""
    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def sent(found: list[tuple], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["d1", "d2", "first", "text"][: len(kinds)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, group in groupby(rows(batches), key=lambda r: r[:2]):
            held: list[str] = []
            first, size = None, 0
            for _, _, conv in group:
                first = conv if not held else first
                held.append("" if conv is None else str(conv))
                size += len(held[-1]) + 1
                if size > CHUNK:
                    yield sent([(*node, first, ",".join(held))], [pa.int64(), pa.int64(), pa.int64(), pa.string()])
                    held, size = [], 0
            if held:
                yield sent([(*node, first, ",".join(held))], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, group in groupby(rows(batches), key=lambda r: r[:2]):
            h = hashlib.sha256()
            for k, (_, _, _, text) in enumerate(group):
                h.update(("," * (k > 0) + text).encode())
            yield sent([(*node, h.hexdigest())], [pa.int64(), pa.int64(), pa.string()])

    chunks = ends.select("d1", "d2", "conv_id").repartitionByRange(ranges, "d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(join, "d1 long, d2 long, first long, text string")
    return chunks.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def nodes(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, id, chars; pos 0 for each conversation) -> a row for each node."""
    rows = stored(blocks(turns), "turn-blocks")
    found = stored(rolled(rows, "min(conv_id) AS conv_id, count(*) AS n_convs"), "nodes")
    kids = found.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    # what each conversation owns: from which depth, the characters before it, and whether a leaf is among it
    owned = found.join(kids, ["d1", "d2"], "left").groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.min(F.col("path") - F.col("chars")).alias("before"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf"))
    filled = [F.when(F.col(t).isNotNull(), F.col(f"{t}.chars")).otherwise(F.lit(0).cast("long")) for t in _T]
    ends = rows.groupBy("conv_id").agg(
        F.max_by(F.struct(_path(1, WIDTH).alias("d1"), _path(2, WIDTH).alias("d2"), (F.col("base") + reduce(lambda a, b: a + b, filled)).alias("total")), "block").alias("end")
    ).select("conv_id", "end.*")
    members = ends.alias("e").join(owned.alias("w"), F.col("e.conv_id").eqNullSafe(F.col("w.conv_id")), "left").select(F.col("e.conv_id").alias("member"), F.coalesce("before", "total").alias("until"), "own_from", F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    marked = rows.join(members, F.col("conv_id").eqNullSafe(F.col("member")))
    sums = []
    for i in range(WIDTH + 1):
        # the turns from this depth on that the member does not own
        at, start = F.col("block") * WIDTH + max(i, 1), F.col("base") + reduce(lambda a, b: a + b, filled[: max(i - 1, 0)], F.lit(0).cast("long"))
        marked = marked.withColumn(f"u{i}", F.when(F.col("own_from").isNull() | (at < F.col("own_from")), F.col("until") - start).otherwise(F.lit(0).cast("long")))
        sums.append(f"sum(u{i})")
    whole = rolled(marked, f"min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, array({', '.join(sums)}) AS saved").withColumn("saved_tokens", F.get("saved", F.col("level")))
    names = found.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(kids, ["d1", "d2"], "left").join(end_digests(ends), ["d1", "d2"], "left").join(names, ["p1", "p2"], "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def trie(conversations: DataFrame, *, rebuild: bool = True) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> nodes; rebuild: with beginnings shared as rebuilt() says."""
    turns = numbered(conversations)
    if rebuild:
        return nodes(rebuilt(turns))
    none = turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("chars"))
    return nodes(turns.unionByName(none))
