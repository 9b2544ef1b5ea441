"""Session transcripts in JSON lines, of two dialects, as events.

Lines are parsed once, as VARIANT values, so one line may hold a string where another holds blocks of several types; what decides is
the value's own type. A line that is no JSON, and lines and blocks of other types, give no event. Events are numbered by
session in the order of lines, and of pieces in a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What of a tool's output is kept, and of its arguments.
OUTPUT, ARGUMENT, FIRST, CALL = 2000, 120, 100, 200
#: Arguments that name what a tool was called for, the first one that is a text.
NAMED = ("command", "path", "file_path", "pattern", "url", "query")
_PIECE = "struct<kind: string, text: string, tool_name: string, tool_args: string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """session_id (the file's name), line_no, line."""
    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.\w+)?$", 1).alias("session_id"), F.split(F.col("content").cast("string"), "\r\n|\n|\r").alias("lines"))
    return rows.select("session_id", F.posexplode("lines").alias("line_no", "line"))


def _str(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _list(v: Column, path: str = "$") -> Column:
    """The elements, or null if it is no list."""
    return F.when(F.schema_of_variant(F.coalesce(F.try_variant_get(v, path, "variant"), F.parse_json(F.lit("0")))).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _is_text(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))


def _joined(v: Column, path: str) -> Column:
    """A text, or the texts of a list's objects with spaces between."""
    parts = F.transform(F.filter(_list(v, path), lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x: F.coalesce(_str(x, "$.text"), F.lit("")))
    return F.coalesce(F.array_join(parts, " "), _str(v, path), F.lit(""))


def _piece(kind: str, text: Column, name: Column | None = None, args: Column | None = None) -> Column:
    empty = F.lit("")
    # named_struct, as aliases are lost in nested lambdas
    return F.named_struct(F.lit("kind"), F.lit(kind), F.lit("text"), text, F.lit("tool_name"), empty if name is None else name, F.lit("tool_args"), empty if args is None else args)


def _arguments(block: Column, raw: Column) -> Column:
    """What the tool was called for; else its first argument with its name, if that is a text. raw: the block as JSON, which keeps the
    order of names."""
    named = F.coalesce(*[F.when(_is_text(block, f"$.input.{k}"), F.substring(_str(block, f"$.input.{k}"), 1, ARGUMENT)) for k in NAMED], F.lit(""))
    given = F.get_json_object(raw, "$.input")
    name = F.get(F.json_object_keys(given), F.lit(0))
    values = F.try_variant_get(block, "$.input", "map<string, variant>")
    value = F.try_element_at(values, name)
    first = F.when(F.schema_of_variant(value) == "STRING", F.concat(name, F.lit("="), F.substring(F.try_variant_get(value, "$", "string"), 1, FIRST)))
    return F.when(named != "", named).otherwise(F.coalesce(first, F.lit("")))


def meta(t: Column) -> Column:
    """Messages that no user wrote."""
    pasted = t.rlike(r"^\s*1\t.+\n\s*2\t") | t.startswith("Tool ran without output") | t.startswith("<tool_use_error>")
    return F.when((t == "") | F.contains(t, F.lit("<local-command-caveat>")) | t.startswith("<system-reminder>"), True).when(t.startswith("[Request interrupted by user"), False).otherwise(pasted)


def _numbered(pieces: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("line_no", "place")
    return pieces.select("session_id", (F.row_number().over(order) - 1).alias("idx"), "kind", "role", "text", "timestamp", "tool_name", "tool_args")


def typed_blocks(lines: DataFrame) -> DataFrame:
    """lines (session_id, line_no, line) of the dialect with typed content blocks -> session_id, idx, kind, role, text, timestamp,
    tool_name, tool_args. Kinds: user, assistant_text, assistant_thinking, tool_call, tool_result, system."""
    rows = lines.filter(F.trim("line") != "").withColumn("v", F.try_parse_json("line")).filter("v IS NOT NULL")
    v = F.col("v")
    content = "$.message.content"
    rows = rows.withColumns({"type": _str(v, "$.type"), "timestamp": F.coalesce(_str(v, "$.timestamp"), F.lit("")), "blocks": _list(v, content), "said": F.when(_is_text(v, content), _str(v, content))})
    raw = F.from_json(F.get_json_object("line", content), "array<string>")  # blocks as they were written
    none = F.array().cast(f"array<{_PIECE}>")
    kind = lambda x: F.coalesce(_str(x, "$.type"), F.lit(""))
    of = lambda x, name: F.coalesce(_str(x, f"$.{name}"), F.lit(""))

    def user(x: Column) -> Column:
        return F.when(kind(x) == "text", _piece("user", of(x, "text"))).when(kind(x) == "tool_result", _piece("user", F.substring(_joined(x, "$.content"), 1, OUTPUT)))

    def assistant(x: Column, i: Column) -> Column:
        name, args = of(x, "name"), _arguments(x, F.get(raw, i))
        return (
            F.when((kind(x) == "text") & (of(x, "text") != ""), _piece("assistant_text", of(x, "text"))).when((kind(x) == "thinking") & (of(x, "thinking") != ""), _piece("assistant_thinking", of(x, "thinking")))
            .when(kind(x) == "tool_use", _piece("tool_call", F.concat(F.lit("[tool_use "), name, F.lit("("), args, F.lit(")]")), name, args)).when(kind(x) == "tool_result", _piece("tool_result", F.substring(_joined(x, "$.content"), 1, OUTPUT), None, of(x, "tool_use_id")))
        )

    said = F.col("said")
    users = F.filter(F.coalesce(F.when(said.isNotNull(), F.array(_piece("user", said))), F.transform("blocks", user), none), lambda p: p.isNotNull() & ~meta(p["text"]))
    assistants = F.filter(F.coalesce(F.when(F.trim(said) != "", F.array(_piece("assistant_text", said))), F.transform("blocks", assistant), none), lambda p: p.isNotNull())
    systems = F.when(_is_text(v, "$.content") & (F.trim(_str(v, "$.content")) != ""), F.array(_piece("system", _str(v, "$.content")))).otherwise(none)
    pieces = F.when(F.col("type") == "user", users).when(F.col("type") == "assistant", assistants).when(F.col("type") == "system", systems)
    return _numbered(rows.select("session_id", "line_no", F.col("type").alias("role"), "timestamp", F.posexplode(pieces).alias("place", "p")).select("session_id", "line_no", "role", "timestamp", "place", "p.*"))


def response_items(lines: DataFrame) -> DataFrame:
    """lines of the dialect with a payload each (message, call, output) -> the same columns, and call_id, by which outputs find calls."""
    rows = lines.filter(F.trim("line") != "").withColumn("v", F.try_parse_json("line")).filter("v IS NOT NULL")
    v = F.col("v")
    get = lambda name: F.coalesce(_str(v, f"$.payload.{name}"), F.lit(""))
    kind, role = get("type"), F.coalesce(_str(v, "$.payload.role"), F.lit("user"))
    # a list's texts; other elements as they are
    words = lambda name: F.coalesce(F.array_join(F.transform(_list(v, f"$.payload.{name}"), lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.coalesce(_str(x, "$.text"), F.lit(""))).otherwise(F.coalesce(_str(x, "$"), F.lit("None")))), " "), get(name))
    args = F.substring(get("arguments"), 1, CALL)
    piece = (
        F.when((kind == "message") & (F.trim(words("content")) != ""), F.struct(F.when(role == "user", "user").otherwise("assistant_text").alias("kind"), role.alias("role"), words("content").alias("text"), F.lit("").alias("tool_name"), F.lit("").alias("tool_args")))
        .when(kind.isin("function_call", "tool_call"), F.struct(F.lit("tool_call").alias("kind"), F.lit("assistant").alias("role"), F.concat(F.lit("[tool_call "), get("name"), F.lit("("), args, F.lit(")]")).alias("text"), get("name").alias("tool_name"), args.alias("tool_args")))
        .when(kind.isin("function_call_output", "tool_result"), F.struct(F.lit("tool_result").alias("kind"), F.lit("tool").alias("role"), F.substring(words("output"), 1, OUTPUT).alias("text"), F.lit("").alias("tool_name"), F.lit("").alias("tool_args")))
    )
    found = rows.select("session_id", "line_no", F.coalesce(_str(v, "$.timestamp"), F.lit("")).alias("timestamp"), piece.alias("p"), get("call_id").alias("call_id")).filter("p IS NOT NULL")
    order = Window.partitionBy("session_id").orderBy("line_no")
    return found.select("session_id", (F.row_number().over(order) - 1).alias("idx"), "p.kind", "p.role", "p.text", "timestamp", "p.tool_name", "p.tool_args", "call_id")


def paired_calls(events: DataFrame) -> DataFrame:
    """Calls and results of response_items() by call_id: session_id, call_id, call_idx, result_idx; orphans have null on one side.
    Of calls that share an id the first counts, of results too."""
    side = lambda kind, name: events.filter((F.col("kind") == kind) & (F.col("call_id") != "")).groupBy("session_id", "call_id").agg(F.min("idx").alias(name))
    return side("tool_call", "call_idx").join(side("tool_result", "result_idx"), ["session_id", "call_id"], "full")


def message_pieces(messages: Column) -> Column:
    """A list of messages (role, content, tool_calls, name) as VARIANT -> array<struct<kind, text, tool_name, tool_args>>, in order. A
    content of parts is their texts with spaces between; arguments that are no text are compact JSON."""
    none = F.array().cast(f"array<{_PIECE}>")

    def calls(m: Column) -> Column:
        def call(t: Column) -> Column:
            fn = F.coalesce(F.try_variant_get(t, "$.function", "variant"), t)
            name, args = F.coalesce(_str(fn, "$.name"), F.lit("")), F.substring(F.coalesce(_str(fn, "$.arguments"), F.lit("")), 1, 500)
            return _piece("tool_call", F.concat(F.lit("[tool_use "), name, F.lit("("), F.substring(args, 1, ARGUMENT), F.lit(")]")), name, args)

        return F.coalesce(F.transform(F.filter(_list(m, "$.tool_calls"), lambda t: F.schema_of_variant(t).startswith("OBJECT")), call), none)

    def of(m: Column) -> Column:
        role = F.coalesce(_str(m, "$.role"), F.lit(""))
        parts = F.transform(_list(m, "$.content"), lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.coalesce(_str(x, "$.text"), F.lit(""))).otherwise(F.coalesce(_str(x, "$"), F.lit("None"))))
        text = F.coalesce(F.array_join(parts, " "), _str(m, "$.content"), F.lit(""))
        said = lambda kind: F.when(F.trim(text) != "", F.array(_piece(kind, text))).otherwise(none)
        return (
            F.when(role == "user", said("user")).when(role.isin("assistant", "model"), F.concat(said("assistant_text"), calls(m)))
            .when(role == "tool", F.array(_piece("tool_result", F.substring(text, 1, OUTPUT), F.coalesce(_str(m, "$.name"), F.lit(""))))).when(role == "system", said("system")).otherwise(none)
        )

    return F.flatten(F.transform(F.filter(messages, lambda m: F.schema_of_variant(m).startswith("OBJECT")), of))


def rubric_cases(rows: DataFrame) -> DataFrame:
    """rows (id, messages_json, system, user) -> two linked cases of each: case_id, paired_case_id, pair_role, n_events, probe_t, events, those
    before the probe. Where messages_json is no list, or gives no event, the texts of system and user are events."""
    none = F.array().cast(f"array<{_PIECE}>")
    given = F.coalesce(message_pieces(_list(F.try_parse_json("messages_json"))), none)
    own = F.filter(F.array(*[F.when(F.trim(c) != "", _piece(c, F.col(c))) for c in ("system", "user")]), lambda p: p.isNotNull())
    base = F.substring(F.coalesce(F.col("id").cast("string"), F.lit("unknown")), 1, 64)
    found = rows.select(base.alias("base"), F.when(F.size(given) > 0, given).otherwise(own).alias("all"), F.explode(F.array(F.lit("normal"), F.lit("hack"))).alias("pair_role"))
    found = found.withColumn("n_events", F.size("all")).withColumn("probe_t", F.greatest(F.lit(0), F.col("n_events") - 1))
    other = F.when(F.col("pair_role") == "normal", "hack").otherwise("normal")
    return found.select(F.concat_ws(":", "base", "pair_role").alias("case_id"), F.concat_ws(":", F.col("base"), other).alias("paired_case_id"), "pair_role", "n_events", "probe_t", F.slice("all", F.lit(1), F.col("probe_t")).alias("events"))
