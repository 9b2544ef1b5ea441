"""Correction directives and the active evidence view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

#: The words around the number of facts and the ids in what replaces a revoked event.
MARKER = ("REVOKED_BY_CORRECTION: this event contained ", " invalidated fact(s) and is not active evidence for the projection. Apply correction_id(s): ", ". Do not reconstruct the original revoked wording from this marker.")


def _prepared(directives: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each fact that is not empty, with its place; directives have fact, or facts and directive_index."""
    d = directives if "facts" in directives.columns else directives.withColumn("facts", F.array("fact"))
    order = F.col("directive_index") if "directive_index" in directives.columns else F.lit(0)
    named = F.when(F.col("correction_id") == "", "unknown").otherwise(F.col("correction_id"))
    d = d.select(*keys, named.alias("correction_id"), "correction_index", "scope", order.cast("long").alias("directive_index"), F.posexplode("facts").alias("fact_index", "fact"))
    return d.filter("fact <> ''")


def matches(log: DataFrame, directives: DataFrame, keys: list[str]) -> DataFrame:
    """(event, fact of a directive) where the directive is in scope and the event holds the fact. Sessions are an equality, so
    the substring is a residual of a hash join, not a nested loop. Only prior_events looks at the place."""
    in_scope = (F.col("scope") != "prior_events") | (F.col("event_index") < F.col("correction_index"))
    # folded once a row of each side, not once a pair
    events = log.filter("type <> 'correction'").withColumn("_low", ascii_lower(F.col("payload")))
    facts = _prepared(directives, keys).withColumn("_fact_low", ascii_lower(F.col("fact")))
    return events.join(facts, keys).filter(in_scope & F.contains("_low", "_fact_low")).drop("_low", "_fact_low")


def active_view(log: DataFrame, directives: DataFrame, keys: list[str]) -> DataFrame:
    """log with revoked events replaced, not removed; revoked_by lists the directives once each and revoked_facts the facts, in
    their order; original is what was there."""
    place = F.struct("directive_index", "correction_index", "correction_id", "fact_index", "fact")
    hit = matches(log, directives, keys).groupBy(*keys, "event_index").agg(F.array_sort(F.collect_list(place)).alias("_hits"))  # as many as a session's facts
    hit = hit.select(*keys, "event_index", F.array_join(F.array_distinct(F.transform("_hits", lambda h: h["correction_id"])), ",").alias("revoked_by"), F.transform("_hits", lambda h: h["fact"]).alias("revoked_facts"))
    joined = log.join(hit, [*keys, "event_index"], "left")
    revoked = F.col("revoked_by").isNotNull()
    marker = F.concat(F.lit(MARKER[0]), F.size("revoked_facts"), F.lit(MARKER[1]), "revoked_by", F.lit(MARKER[2]))
    joined = joined.withColumn("original", F.when(revoked, F.col("payload")))
    return joined.withColumn("payload", F.when(revoked, marker).otherwise(F.col("payload"))).withColumn("type", F.when(revoked, "internal").otherwise(F.col("type")))


def revoked_log(view: DataFrame) -> DataFrame:
    """The second output: one line for each revoked event of active_view()."""
    line = F.concat(F.lit("["), F.col("event_index") + 1, F.lit("] revoked_by="), "revoked_by", F.lit(" invalidated_facts="), F.array_join("revoked_facts", " | "), F.lit(" original="), "original")
    return view.filter("revoked_by IS NOT NULL").withColumn("line", line)


def first_seen(items: DataFrame, keys: list[str], item: str, place: str) -> DataFrame:
    """Distinct trimmed items in order of first appearance, compared without ASCII case."""
    rows = items.withColumn(item, F.trim(item)).filter(F.col(item) != "")
    firsts = rows.groupBy(*keys, ascii_lower(F.col(item)).alias("_folded")).agg(F.min_by(item, place).alias(item), F.min(place).alias(place))
    return firsts.drop("_folded")
