"""Queries of nested literals: function-call values, tool declarations, ledger entries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..catalog import query
from ..functions import protocol as P
from ..sources import adapters as A

TAG = '<|"|>'


def _mapped(rows: DataFrame, key: str, make: Callable[[object], dict], schema: str) -> DataFrame:
    """rows (key, value as JSON) -> key and what make gives of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(json.loads(v)) for v in b.column("value").to_pylist()]
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(key), *[pa.array([m[n] for m in made], k) for n, k in zip(names, kinds)]], names=[key, *names])

    return rows.select(key, "value").mapInArrow(run, f"{key} long, {schema}")


@query("H20_fc_values", f"""SELECT event_id, '{{k:' || CAST(json_extract(props, '$.k') AS BIGINT) || ',user:{TAG}u' || user_id || '{TAG},ok:' || CASE WHEN value > 20 THEN 'true' ELSE 'false' END || ',list:[1,null,{TAG}' || event_type || '{TAG},-2.5],deep:{{x:{{y:[{{}},[]]}}}}}}' AS literal FROM events""")
def fc_values(spark, sf):
    """Nested arguments as function-call literals."""
    e = A.table(spark, sf, "events").selectExpr("event_id", """concat('{"k":', get_json_object(props, '$.k'), ',"user":"u', user_id, '","ok":', value > 20, ',"list":[1,null,"', event_type, '",-2.5],"deep":{"x":{"y":[{},[]]}}}') AS value""")
    return _mapped(e, "event_id", lambda v: {"literal": P.fc_literal(v, TAG)}, "literal string")


@query("H20_tool_declarations", f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'declaration:' || event_type || '{{description:{TAG}does ' || user_id || '{TAG},parameters:{{type:{TAG}OBJECT{TAG},properties:{{type:{{type:{TAG}STRING{TAG}}},n:{{type:{TAG}other{TAG},anyOf:[{{type:{TAG}INTEGER{TAG}}}]}}}},required:[{TAG}n{TAG}]}}}}' END AS declaration, CASE WHEN event_id % 7 = 0 THEN 'no name' ELSE '' END AS error FROM events""")
def tool_declarations(spark, sf):
    """Tools as declarations, with or without the function around them; some have no name."""
    function = """concat('{', IF(event_id % 7 = 0, '', concat('"name":"', event_type, '",')), '"description":"does ', user_id, '","parameters":{"type":"object","properties":{"type":{"type":"string"},"n":{"type":"other","anyOf":[{"type":"integer"}]}},"required":["n"]}}')"""
    e = A.table(spark, sf, "events").selectExpr("event_id", f"""IF(event_id % 2 = 0, concat('{{"type":"function","function":', {function}, '}}'), {function}) AS value""")
    return _mapped(e, "event_id", lambda v: dict(zip(("declaration", "error"), P.fc_declaration(v, TAG))), "declaration string, error string")


@query("A30_ledger_entries", """SELECT doc_id, CASE WHEN length(text) > 4000 THEN 4014 ELSE length(text) END AS command_chars, CASE WHEN length(text) > 4000 THEN md5(left(text, 4000) || '...<truncated>') ELSE md5(text) END AS command, least(doc_id % 30, 20) AS items, least(doc_id % 50, 40) AS keys FROM documents""")
def ledger_entries(spark, sf):
    """Tool inputs as a ledger keeps them: long texts marked, lists of twenty, objects of forty."""
    d = A.table(spark, sf, "documents").selectExpr("doc_id", "to_json(struct(text AS command, slice(sequence(1L, 50L), 1, CAST(doc_id % 30 AS INT)) AS items, map_from_entries(transform(slice(sequence(1L, 60L), 1, CAST(doc_id % 50 AS INT)), i -> struct(concat('k', i), i))) AS keys)) AS value")

    def make(v):
        s = P.scrubbed(v)
        return {"command_chars": len(s["command"]), "command": _md5(s["command"]), "items": len(s["items"]), "keys": len(s["keys"])}

    return _mapped(d, "doc_id", make, "command_chars long, command string, items long, keys long")


def _md5(s: str) -> str:
    import hashlib

    return hashlib.md5(s.encode()).hexdigest()
