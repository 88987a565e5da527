"""Linking tool calls with their results for chat training data.

Calls and results are joined by conversation and identifier. Calls may depend on other
calls of their conversation; each call gets a level above all it depends on, so
``(level, turn, call_id)`` is a topological order, and calls on a cycle never get one.
Arguments are checked against the tool's JSON schema, and each call is written as one
line of canonical JSON: sorted keys, no white space, one form for every number, all
text unescaped but for what JSON must escape.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.session import checkpointed, drop_scratch

CALLS = "conv_id, turn, call_id, name, arguments, depends_on"
RESULTS = "conv_id, turn, call_id, content"
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """Canonical JSON; numbers that are whole are written without a fraction."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("number out of range")
        if value.is_integer() and abs(value) < 2 ** 53:
            value = int(value)
    return json.dumps(value, ensure_ascii=False)


def parsed(text: str | None) -> tuple[object, str | None]:
    """The value of a JSON text, and what is wrong with it."""
    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("repeated key")
        return out

    def constant(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    if text is None:
        return None, "no arguments"
    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
        canonical(value)
        return value, None
    except RecursionError:
        return None, "nested too deeply"
    except ValueError as fault:
        return None, f"not JSON: {str(fault).split(':')[0]}"


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind])


def faults(value: object, schema: dict, path: str = "$") -> Iterator[str]:
    """Where ``value`` breaks the schema: type, enum, properties, required, additionalProperties, items, minimum,
    maximum, minLength, maxLength, minItems, maxItems, pattern."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        yield f"{path}: not {' or '.join(kinds)}"
        return
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        yield f"{path}: not one of the values"
    if _is(value, "number"):
        if value < schema.get("minimum", -math.inf):
            yield f"{path}: below {schema['minimum']}"
        if value > schema.get("maximum", math.inf):
            yield f"{path}: above {schema['maximum']}"
    if isinstance(value, (str, list)):
        least, most = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(least, 0) <= len(value) <= schema.get(most, math.inf):
            yield f"{path}: wrong length"
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        yield f"{path}: does not match"
    if isinstance(value, list) and "items" in schema:
        for n, item in enumerate(value):
            yield from faults(item, schema["items"], f"{path}[{n}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from (f"{path}: {key} is missing" for key in sorted(set(schema.get("required", ())) - value.keys()))
        for key in sorted(value):
            if key in known:
                yield from faults(value[key], known[key], f"{path}.{key}")
            elif schema.get("additionalProperties") is False:
                yield f"{path}: {key} is not known"


def _chains(edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, to, far``: for calls that depend on one other, the first call back along the chain that
    depends on none or on several, and how far it is. Chains that end in a cycle are left out.

    Every round doubles how far a call looks back, so there are as many rounds as the
    logarithm of the longest chain.
    """
    alone = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.first("on").alias("to")).where("n = 1")
    jumps = checkpointed(alone.select("conv_id", "call_id", "to", F.lit(1).alias("far")))
    for _ in range(jumps.count().bit_length() + 1):
        ahead = jumps.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("to").alias("next"),
                             F.col("far").alias("more"))
        longer = checkpointed(jumps.join(ahead, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("k")), "left").select(
            "conv_id", "call_id", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"),
            F.col("next").isNotNull().alias("moved")))
        drop_scratch(jumps)
        jumps = longer
        if jumps.where("moved").isEmpty():
            break
    within = jumps.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"))
    return checkpointed(jumps.drop("moved").join(within, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("k")), "left_anti"))


def call_levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 for calls that depend on none, else one above the highest; no row on cycles.

    Dependencies on calls that are not there do not count. Chains of single
    dependencies are shortened first (:func:`_chains`); then rounds of joins give
    levels to the calls with several, as many rounds as such calls follow each other.
    """
    nodes = checkpointed(calls.select("conv_id", "call_id"))
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("on"))
    there = nodes.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"))
    edges = checkpointed(edges.join(there, (F.col("conv_id") == F.col("c")) & (F.col("on") == F.col("k")), "left_semi"))
    chains = _chains(edges)
    levels = nodes.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    sizes = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n")).where("n > 1")
    back = chains.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "to", "far")
    hops = checkpointed(
        edges.join(sizes, ["conv_id", "call_id"])
        .join(back, (F.col("conv_id") == F.col("c")) & (F.col("on") == F.col("k")), "left")
        .select("conv_id", "call_id", "n", F.coalesce("to", "on").alias("to"), (F.coalesce("far", F.lit(0)) + 1).alias("far")))
    levels = checkpointed(levels)
    while not hops.isEmpty():
        known = levels.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "level")
        met = hops.join(known, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("k")))
        fresh = checkpointed(met.groupBy("conv_id", "call_id", "n").agg(
            F.count("*").alias("met"), F.max(F.col("level") + F.col("far")).alias("level"))
            .where("met = n").select("conv_id", "call_id", "level"))
        if fresh.isEmpty():
            break
        following = checkpointed(hops.join(fresh.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
        grown = checkpointed(levels.union(fresh))
        for done in (hops, levels, fresh):
            drop_scratch(done)
        hops, levels = following, grown
    known = levels.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "level")
    return levels.union(chains.join(known, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("k"))).select(
        "conv_id", "call_id", F.col("level") + F.col("far")))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and one per result without a call, from tables with the columns ``CALLS`` and ``RESULTS``.

    ``status``: ``linked``; ``no_result``; ``duplicate`` for a later call (by turn, then
    text) with an identifier of its conversation that is taken; ``orphan`` for a result
    without a call; ``unnamed`` for calls and results without a conversation or
    identifier. Of several results the one of the earliest turn counts, ``n_results``
    says how many there are. ``level`` is null on a cycle and for all but linked calls
    and those without result. ``valid`` is whether the arguments are JSON that fits the
    schema of the tool, ``errors`` says what does not. ``line`` is the canonical JSON, null
    where the arguments are not JSON. Equal rows stay apart as duplicates. Empty tables
    give no rows; other columns are not read.
    """
    calls = calls.selectExpr("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    results = results.selectExpr("conv_id", "turn", "call_id", "content")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    numbered = checkpointed(calls.withColumn("__row", F.monotonically_increasing_id()))
    first = numbered.where(named).groupBy("conv_id", "call_id").agg(
        F.min(F.struct(F.col("turn").isNull().alias("none"), "turn", "name", "arguments", "__row"))["__row"].alias("__row"))
    unique = checkpointed(numbered.join(first.select("__row"), "__row", "left_semi"))
    answers = checkpointed(results.where(named).groupBy("conv_id", "call_id").agg(
        F.min(F.struct(F.col("turn").isNull().alias("none"), "turn", "content")).alias("answer"), F.count("*").alias("n_results")))
    levels = call_levels(unique)
    kept = (unique.join(answers, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left")
            .withColumn("status", F.when(F.col("n_results") > 0, "linked").otherwise("no_result")))
    shared = ["conv_id", "turn", "call_id", "name", "arguments", "status", "level", "n_results", "result_turn", "content"]
    others = numbered.join(unique.select("__row"), "__row", "left_anti").withColumn(
        "status", F.when(named, "duplicate").otherwise("unnamed"))
    orphans = results.where(named).join(unique.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn(
        "status", F.lit("orphan")).unionByName(results.where(~named).withColumn("status", F.lit("unnamed")))
    none = F.lit(None)
    rows = (kept.withColumns({"result_turn": F.col("answer.turn"), "content": F.col("answer.content")}).select(*shared)
            .union(others.withColumns({"level": none.cast("int"), "n_results": none.cast("long"),
                                       "result_turn": none.cast("long"), "content": none.cast("string")}).select(*shared))
            .union(orphans.withColumns({"name": none.cast("string"), "arguments": none.cast("string"), "level": none.cast("int"),
                                        "n_results": none.cast("long"), "result_turn": F.col("turn")})
                   .withColumn("turn", none.cast("long")).select(*shared)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            valid, errors, lines = [], [], []
            for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                if r.name is None and r.arguments is None:
                    valid.append(None)
                    errors.append("")
                    lines.append(None)
                    continue
                value, wrong = parsed(r.arguments)
                found = [wrong] if wrong else (list(faults(value, schemas[r.name])) if r.name in schemas else ["unknown tool"])
                valid.append(not found)
                errors.append("; ".join(found))
                message = {"id": r.call_id, "type": "function", "function": {"name": r.name, "arguments": value}}
                if r.status == "linked":
                    message["result"] = r.content
                lines.append(None if wrong else canonical(message))
            yield pd.DataFrame({"conv_id": frame.conv_id, "turn": frame.turn.astype("Int64"), "call_id": frame.call_id,
                                "name": frame.name, "status": frame.status, "level": frame.level.astype("Int32"),
                                "n_results": frame.n_results.astype("Int64"), "result_turn": frame.result_turn.astype("Int64"),
                                "valid": pd.array(valid, "boolean"), "errors": errors, "line": lines})

    return rows.mapInPandas(run, "conv_id long, turn long, call_id string, name string, status string, level int, "
                                 "n_results long, result_turn long, valid boolean, errors string, line string")


# The tools that the turns of a plain chat are read as using.
CHAT_SCHEMAS = {
    "search": {"type": "object", "additionalProperties": False, "required": ["query", "limit"], "properties": {
        "query": {"type": "string", "minLength": 1, "maxLength": 1200}, "limit": {"type": "integer", "minimum": 1, "maximum": 50},
        "after": {"type": ["string", "null"]}}},
    "summarize": {"type": "object", "required": ["text", "words"], "properties": {
        "text": {"type": "string", "pattern": "[^ ]"}, "words": {"type": "number", "maximum": 120},
        "style": {"enum": ["short", "long"]}}},
}


def chat_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results read from ``conv_id, turn, role, text``: an assistant's turn is a call, the user's turn
    that follows at once is its result. A call depends on the one two turns before, if there is one, and those of the
    turns 5 and 9 on the one before that as well. So that all of the linking is at work: in some conversations the
    first call waits for the second (a cycle), the arguments break off, or a limit is out of its range."""
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    named = lambda turn: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), turn)
    asked = turns.where("role = 'assistant'").select("conv_id", "turn", "text", named(F.col("turn")).alias("call_id"))
    asked = asked.withColumn("before", F.when(F.col("turn") >= 2, named(F.col("turn") - 2)))
    earlier = F.when(F.col("turn").isin(5, 9), named(F.col("turn") - 4))
    later = F.when((F.col("turn") == 1) & (F.col("conv_id") % 41 == 7), named(F.col("turn") + 2))
    limit = F.when(F.col("conv_id") % 43 == 5, F.lit(1000)).otherwise((words / 10 + 1).cast("int"))
    search = F.to_json(F.struct(limit.alias("limit"), F.col("text").alias("query"), F.col("before").alias("after")))
    short = F.to_json(F.struct(words.cast("double").alias("words"), F.when(words < 60, "short").otherwise("long").alias("style"), "text"))
    even = F.col("turn") % 4 == 1
    whole = F.when(even, search).otherwise(short)
    broken = F.when(F.col("conv_id") % 47 == 11, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    calls = asked.select("conv_id", "turn", "call_id", F.when(even, "search").otherwise("summarize").alias("name"),
                         broken.alias("arguments"), F.array_compact(F.array("before", earlier, later)).alias("depends_on"))
    results = turns.where("role = 'user' AND turn > 0").select(
        "conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
