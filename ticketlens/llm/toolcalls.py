"""Tool-call linking with DataFrame functions only: calls and results joined by identifier, ordered along their
dependencies, checked against schemas and serialised as canonical JSON.

Rows that repeat an identifier are aggregated before the join, so no identifier can multiply or gather rows in one
task. The order is the level in the forest of dependencies, found by pointer jumping in a number of rounds that grows
with the logarithm of the longest chain; no conversation is gathered, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.session import settle

# Types of a schema, and the first words of the types that JSON values have.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
MOST_ROUNDS = 64


def levels(calls: DataFrame) -> DataFrame:
    """Adds level to calls (conv, id, after): how many calls lie before it; null for a call in or after a cycle.

    A call whose after is null or names no call of its conversation starts a chain.
    """
    nodes = calls.select("conv", "id", "after")
    known = calls.select("conv", F.col("id").alias("after"), F.lit(True).alias("known"))
    state = nodes.join(known, ["conv", "after"], "left").select(
        "conv", "id", F.when(F.col("known"), F.col("after")).alias("to"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level")
    )
    state = settle(state)
    left = state.agg(F.count("to").alias("n"), F.count("*").alias("rows")).first()
    open_, rounds = left["n"], 0
    # A chain has at most as many calls as there are, so beyond the logarithm what is open is in a cycle.
    while open_ and rounds <= min(MOST_ROUNDS, int(left["rows"]).bit_length()):
        hop = state.select("conv", F.col("id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        state = settle(state.join(hop, ["conv", "to"], "left").select("conv", "id", F.col("next").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        open_, rounds = state.agg(F.count("to").alias("n")).first()["n"], rounds + 1
    return state.select("conv", "id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))


def schema_map(schemas: DataFrame) -> DataFrame:
    """One row for each tool: its parameters as a map to (type, required), and the required ones in order."""
    entry = F.struct("param", F.struct("type", "required"))
    own = schemas.filter("tool is not null and param is not null").groupBy("tool", "param").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    return own.groupBy("tool").agg(F.map_from_entries(F.collect_list(entry)).alias("params"), F.sort_array(F.collect_list(F.when(F.col("required"), F.col("param")))).alias("needed"))


def problems(params: Column, needed: Column, arguments: Column) -> Column:
    """What is wrong with a call's arguments, sorted: missing, unknown and mistyped parameters."""
    values = F.from_json(arguments, "map<string,variant>")
    kinds = F.transform_values(values, lambda _, v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    names = F.map_keys(kinds)
    fits = F.create_map(*[x for t, own in TYPES.items() for x in (F.lit(t), F.array(*map(F.lit, own)))])
    missing = F.transform(F.array_except(needed, names), lambda p: F.concat(F.lit("missing:"), p))
    unknown = F.transform(F.array_except(names, F.map_keys(params)), lambda p: F.concat(F.lit("unknown:"), p))
    wrong = F.filter(F.array_intersect(names, F.map_keys(params)), lambda p: ~F.coalesce(F.array_contains(fits[params[p]["type"]], kinds[p]), F.lit(False)))
    return F.array_sort(F.concat(missing, unknown, F.transform(wrong, lambda p: F.concat(F.lit("type:"), p))))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each identifier of a conversation that has a call or a result.

    calls: conv, id, tool, arguments (JSON text), after (identifier of the call it needs, or null); results: conv, id,
    content; schemas: tool, param, type, required. The row has tool, level, n_calls, n_results, status, errors and json.
    Status is the first that applies of no_call, repeated (calls that differ), cycle, unknown_tool, malformed (arguments
    are no JSON object, or name a key twice), invalid, no_result and linked. Of repeated calls the smallest row counts,
    of repeated results the smallest content. Rows without conv or id are left out, since nothing can refer to them;
    null contents are results. json has sorted keys and no blanks; level orders a conversation, ties by identifier.
    Empty tables give no rows, and other columns are left out, whatever their names.
    """
    named = "conv is not null and id is not null"
    row = F.struct("tool", "arguments", "after")
    calls = calls.select("conv", "id", "tool", "arguments", "after").filter(named)
    calls = calls.groupBy("conv", "id").agg(F.min(row).alias("call"), F.max(row).alias("other"), F.count("*").alias("n_calls"))
    calls = settle(calls.select("conv", "id", "call.*", "n_calls", (~F.col("call").eqNullSafe(F.col("other"))).alias("differ")))
    results = results.select("conv", "id", "content").filter(named)
    results = results.groupBy("conv", "id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))

    rows = calls.join(levels(calls), ["conv", "id"]).join(results.hint("shuffle_hash"), ["conv", "id"], "full")
    rows = rows.join(schema_map(schemas), "tool", "left")
    parsed = F.try_parse_json("arguments")
    object_ = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("is_object", object_).withColumn("errors", F.when(F.col("is_object") & F.col("params").isNotNull(), problems(F.col("params"), F.col("needed"), F.col("arguments"))).otherwise(F.array().cast("array<string>")))
    status = (
        F.when(F.col("n_calls").isNull(), "no_call").when(F.col("differ"), "repeated").when(F.col("level").isNull(), "cycle")
        .when(F.col("params").isNull(), "unknown_tool").when(~F.col("is_object"), "malformed").when(F.size("errors") > 0, "invalid")
        .when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    )
    rows = rows.withColumn("status", status)
    # Variants write their keys in order; a text that is no JSON object is kept as a JSON string.
    arguments = F.when(F.col("is_object"), F.to_json(parsed)).otherwise(quoted(F.col("arguments")))
    parts = {"arguments": arguments, "errors": F.to_json("errors"), "id": quoted(F.col("id")), "level": F.col("level").cast("string"), "result": quoted(F.col("content")), "status": quoted(F.col("status")), "tool": quoted(F.col("tool"))}
    json = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(parts.items())]), F.lit("}"))
    return rows.select("conv", "id", "tool", "level", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_calls", "n_results")], "status", F.array_join("errors", ",").alias("errors"), json.alias("json"))


def quoted(text: Column) -> Column:
    """A string as JSON; null stays null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.cast("string").alias("s"))), r'(?s)^\{"s":(.*)\}$', 1))
