"""Tool-call linking with DataFrame functions only.

Calls and results are joined by conversation and call id. A call may name the call whose
result it takes (``after``); its depth in that order comes from pointer doubling, so a chain
of d calls takes log2(d) rounds. Arguments are checked against the tool's schema and each
call is written as one canonical JSON line (sorted keys, no blanks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import join_split, stored

KEY = ["conv_id", "call_id"]


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth: 0 without a predecessor that exists, null behind a cycle.

    ``calls`` has one row per (conv_id, call_id), neither null, and ``after``.
    """
    ids = stored(calls.select(*KEY, "after"), "call_ids")
    known = ids.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("_known"))
    state = ids.join(known, ["conv_id", "after"], "left").select(*KEY, F.when(F.col("_known"), F.col("after")).alias("to"), F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("depth"))
    state = stored(state, "depth_state")
    most = ids.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        open_ = state.where("to is not null")
        if open_.isEmpty():
            break
        ahead = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_next"), F.col("depth").alias("_more"))
        moved = open_.join(ahead, ["conv_id", "to"]).select(*KEY, F.col("_next").alias("to"), (F.col("depth") + F.col("_more")).alias("depth"))
        state = stored(state.where("to is null").unionByName(moved), "depth_state")
    return state.select(*KEY, F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


def _kind(value: Column) -> Column:
    """The JSON type of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer")
        .when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
        .otherwise("null")
    )


def schema_maps(schemas: DataFrame) -> DataFrame:
    """name, _params (map of parameter to its type), _required (names): one row per tool."""
    rows = schemas.where("name is not null and param is not null").groupBy("name", "param").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    entry = F.array_sort(F.collect_list(F.struct("param", "type")))
    return rows.groupBy("name").agg(F.map_from_entries(entry).alias("_params"), F.array_sort(F.collect_list(F.when(F.col("required"), F.col("param")))).alias("_required"))


def argument_errors(args: Column, params: Column, required: Column) -> Column:
    """Sorted ``missing:``, ``unknown:`` and ``type:`` errors of a map of variants."""
    missing = F.transform(F.filter(required, lambda p: ~F.map_contains_key(args, p)), lambda p: F.concat(F.lit("missing:"), p))
    unknown = F.transform(F.filter(F.map_keys(args), lambda p: ~F.map_contains_key(params, p)), lambda p: F.concat(F.lit("unknown:"), p))
    kinds = F.transform_values(args, lambda _, v: _kind(v))

    def off(p: Column) -> Column:
        want, got = F.element_at(params, p), F.element_at(kinds, p)
        return F.map_contains_key(params, p) & (want != got) & ~((want == "number") & (got == "integer"))

    wrong = F.transform(F.filter(F.map_keys(args), off), lambda p: F.concat(F.lit("type:"), p))
    return F.array_sort(F.concat(missing, unknown, wrong))


def first_and_more(rows: DataFrame, fields: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows, stored, with a number; the first of each key by ``fields``; and the others.
    Rows without a whole key are in the first table only."""
    rows = stored(rows.withColumn("_rid", F.monotonically_increasing_id()), name)
    whole = rows.where(F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull())
    least = whole.groupBy(*KEY).agg(F.min(F.struct(*fields, "_rid")).alias("c"), F.count(F.lit(1)).alias("n"))
    least = stored(least.select(*KEY, "c.*", "n"), f"first_{name}")
    several = stored(least.where("n > 1").select(*KEY, F.col("_rid").alias("_first"), "n"), f"several_{name}")
    more = join_split(whole, several, KEY, "n").where("_rid <> _first")
    return rows.drop("_rid"), least.drop("_rid", "n"), more.select(*KEY, *fields)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result without call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), after. ``results``: conv_id,
    call_id, turn, content. ``schemas``: name, param, type, required.
    Returns conv_id, call_id, turn, name, status (linked, no_result, orphan_result,
    duplicate_call, duplicate_result), depth, valid, errors, line. Sorting by (conv_id,
    depth, turn, call_id) is a topological order.

    Of calls with one id the first by turn is linked, of results too; each further one is a
    row of its own, a call with the error ``duplicate:call_id`` and no depth. Rows without conv_id or
    call_id are left out of the links: calls have no result, results are orphans. An
    ``after`` that names no call of the conversation is the error ``after:missing``; a cycle
    leaves depth null and is ``after:cycle``. Arguments that are no JSON object are
    ``arguments:not an object`` and stand in the line as they are; a tool without schema is
    ``name:unknown``. Further columns are not read.
    """
    fields = ["turn", "name", "arguments", "after"]
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls, first, more_calls = first_and_more(calls.select(*KEY, *fields), fields, "calls")
    results, answer, more_results = first_and_more(results.select(*KEY, "turn", "content"), ["turn", "content"], "results")
    answer = answer.select(*KEY, F.struct("turn", "content").alias("_r"))
    linked = first.join(answer, KEY, "left").join(depths(first), KEY, "left")
    linked = linked.unionByName(calls.where(~whole).withColumn("depth", F.lit(0).cast("long")), allowMissingColumns=True)
    linked = linked.withColumn("_again", F.lit(False)).unionByName(more_calls.withColumn("_again", F.lit(True)), allowMissingColumns=True)
    known = first.select("conv_id", F.col("call_id").alias("after")).withColumn("_found", F.lit(True))
    linked = linked.join(known, ["conv_id", "after"], "left").join(schema_maps(schemas), "name", "left")
    linked = linked.withColumn("_v", F.try_parse_json("arguments"))
    linked = linked.withColumn("_args", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v").cast("map<string,variant>")))
    own = F.when(F.col("_params").isNull(), F.array(F.lit("name:unknown"))).when(F.col("_args").isNull(), F.array(F.lit("arguments:not an object"))).otherwise(argument_errors(F.col("_args"), F.col("_params"), F.col("_required")))
    order = F.when(F.col("_again"), F.array(F.lit("duplicate:call_id"))).when(F.col("depth").isNull(), F.array(F.lit("after:cycle"))).when(F.col("after").isNotNull() & F.col("_found").isNull(), F.array(F.lit("after:missing"))).otherwise(F.array().cast("array<string>"))
    linked = linked.withColumn("errors", F.concat(order, own))
    text = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6), F.lit("null"))
    json_of = lambda c: F.when(F.col(c).isNull(), "null").otherwise(text(c))
    linked = linked.withColumn("_content", F.col("_r.content"))
    arguments = F.when(F.col("_args").isNotNull(), F.to_json("_v")).otherwise(json_of("arguments"))
    line = F.concat(
        F.lit('{"after":'), json_of("after"), F.lit(',"arguments":'), arguments, F.lit(',"call_id":'), json_of("call_id"), F.lit(',"conv_id":'), json_of("conv_id"),
        F.lit(',"name":'), json_of("name"), F.lit(',"result":'), json_of("_content"), F.lit("}"),
    )
    status = F.when(F.col("_again"), "duplicate_call").when(F.col("_r").isNotNull(), "linked").otherwise("no_result")
    out = linked.select(*KEY, "turn", "name", status.alias("status"), "depth", (F.size("errors") == 0).alias("valid"), "errors", line.alias("line"))
    lone = answer.join(first.select(*KEY), KEY, "left_anti").select(*KEY, "_r.turn", "_r.content").unionByName(results.where(~whole).select(*KEY, "turn", "content"))
    lone = lone.withColumn("status", F.lit("orphan_result")).unionByName(more_results.withColumn("status", F.lit("duplicate_result")))
    orphan = lone.withColumn("_content", F.col("content")).withColumn("line", F.concat(F.lit('{"call_id":'), json_of("call_id"), F.lit(',"conv_id":'), json_of("conv_id"), F.lit(',"result":'), json_of("_content"), F.lit("}")))
    return out.unionByName(orphan.select(*KEY, "turn", "status", "line"), allowMissingColumns=True)
