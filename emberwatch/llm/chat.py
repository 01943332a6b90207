"""Tool calls of conversations: linked to their results by identifier, ordered, checked against schemas, serialised."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.session import checkpointed

CALL_COLUMNS = ("conv_id", "turn", "call_id", "name", "arguments", "needs")
RESULT_COLUMNS = ("conv_id", "turn", "call_id", "content")
#: What a JSON value of a declared type may be in Python; a boolean is no number.
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict,
         "null": type(None)}


@dataclass(frozen=True)
class Parameter:
    """One argument of a tool: its JSON type, whether it must be there, and what bounds its value."""

    type: str
    required: bool = False
    choices: tuple = ()
    least: float | None = None
    most: float | None = None


Schemas = dict[str, dict[str, Parameter]]


def canonical(value) -> str:
    """One text for equal JSON values: keys sorted by code point, no blanks, shortest numbers, nothing escaped needlessly."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def plain_numbers(value):
    """1.0 is the number 1, as JSON has one kind of number."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        return int(value)
    if isinstance(value, dict):
        return {k: plain_numbers(v) for k, v in value.items()}
    return [plain_numbers(v) for v in value] if isinstance(value, list) else value


def parsed(source: str | None):
    """(value, error): JSON text; repeated keys, NaN, numbers beyond a double and lone surrogates are errors."""
    def unique(pairs):
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("repeated key")
        return out

    def refuse(name):
        raise ValueError(f"no JSON: {name}")

    def number(text):
        value = float(text)
        return value if abs(value) < float("inf") else refuse(text)

    try:
        value = plain_numbers(json.loads(source or "", object_pairs_hook=unique, parse_constant=refuse, parse_float=number))
        canonical(value).encode()  # an escaped lone surrogate is no text
        return value, None
    except (ValueError, RecursionError):
        return None, "arguments: not JSON"


def faults(name: str | None, arguments, schemas: Schemas) -> list[str]:
    """What a call's arguments have against its tool's schema, in order of the parameters' names."""
    if name not in schemas:
        return ["tool: unknown"]
    if not isinstance(arguments, dict):
        return ["arguments: not an object"]
    schema, out = schemas[name], []
    for key in sorted(schema.keys() | arguments.keys()):
        if key not in schema:
            out.append(f"{key}: not a parameter")
        elif key not in arguments:
            out += [f"{key}: missing"] * schema[key].required
        else:
            out += value_faults(key, arguments[key], schema[key])
    return out


def value_faults(key: str, value, p: Parameter) -> list[str]:
    if not isinstance(value, TYPES[p.type]) or isinstance(value, bool) and p.type in ("integer", "number"):
        return [f"{key}: not {p.type}"]
    out = [f"{key}: not a choice"] * bool(p.choices and value not in p.choices)
    if p.least is not None and value < p.least or p.most is not None and value > p.most:
        out.append(f"{key}: out of range")
    return out


def further_rows(rows: DataFrame, firsts: DataFrame, fields: list[str]) -> DataFrame:
    """The rows of the keys in `firsts` besides the first of each; `n` counts exact duplicates."""
    keys = ["conv_id", "call_id"]
    counted = rows.join(firsts.select(*keys), keys, "left_semi").groupBy(*keys, *fields).agg(F.count("*").alias("n"))
    counted = counted.join(firsts, keys)
    n = F.col("n") - F.struct(*fields).eqNullSafe(F.col("first")).cast("long")
    return counted.withColumn("n", n).filter("n > 0").drop("first")


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results joined on (conv_id, call_id), a row each way that something is left over.

    Of several calls with one identifier the first by turn, name, arguments and needs is the call; each other is a row of
    its own, "repeated". Of several results the first by turn and content is the result, each other a "repeated result".
    Only exact duplicates share a row, with their count. A call without a result
    is "unanswered", one answered before it was made is "out of order", a result without a call an "orphan". Null
    identifiers link with nothing.
    """
    keys = ["conv_id", "call_id"]
    # The least row of a key by a minimum: partial sums before the shuffle, no group in one place.
    called = calls.filter("conv_id is not null and call_id is not null")
    answered = results.filter("conv_id is not null and call_id is not null")
    first_call = called.groupBy(*keys).agg(
        F.min(F.struct("turn", "name", "arguments", "needs")).alias("c"), F.count("*").alias("calls"))
    first_result = answered.groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("results"))
    joined = first_call.hint("shuffle_hash").join(first_result, keys, "full")
    status = (F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered")
              .when(F.col("r.turn") <= F.col("c.turn"), "out of order").otherwise("linked"))
    main = joined.select(*keys, F.col("c.turn").alias("turn"), F.col("c.name").alias("name"),
                         F.col("c.arguments").alias("arguments"), F.col("c.needs").alias("needs"), F.col("r.turn").alias("result_turn"),
                         F.col("r.content").alias("content"), status.alias("status"), F.lit(1).cast("long").alias("n"))
    further = further_rows(called, first_call.filter("calls > 1").select(*keys, F.col("c").alias("first")),
                           ["turn", "name", "arguments", "needs"]).withColumn("status", F.lit("repeated"))
    again = further_rows(answered, first_result.filter("results > 1").select(*keys, F.col("r").alias("first")),
                         ["turn", "content"]).withColumn("status", F.lit("repeated result"))
    main = main.unionByName(further, allowMissingColumns=True).unionByName(
        again.withColumnRenamed("turn", "result_turn"), allowMissingColumns=True)
    lost = calls.filter("conv_id is null or call_id is null").select(
        *keys, "turn", "name", "arguments", F.lit("unanswered").alias("status"), F.lit(1).cast("long").alias("n"))
    stray = results.filter("conv_id is null or call_id is null").select(
        *keys, F.col("turn").alias("result_turn"), "content", F.lit("orphan").alias("status"),
        F.lit(1).cast("long").alias("n"))
    return main.unionByName(lost, allowMissingColumns=True).unionByName(stray, allowMissingColumns=True)


def chain_ends(single: DataFrame, nodes: int) -> DataFrame:
    """(conv_id, call_id, at, distance) of calls that need one other: the end of their chain and the steps to it.

    An end needs none or several. Pointers double, so the rounds grow with the logarithm of a chain's length; calls that
    have not come to an end after as many rounds as `nodes` allows go round in a cycle and are left out.
    """
    known = single.select("conv_id", F.col("call_id").alias("at"), F.lit(False).alias("end"))
    open_ = checkpointed(single.join(known, ["conv_id", "at"], "left").select(
        "conv_id", "call_id", "at", F.lit(1).alias("distance"), F.coalesce("end", F.lit(True)).alias("end")))
    for _ in range(nodes.bit_length() + 1):
        if open_.filter("not end").isEmpty():
            break
        ahead = open_.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("to"), F.col("distance").alias("more"),
                             F.col("end").alias("there"))
        moved = open_.filter("not end").join(ahead, ["conv_id", "at"]).select(
            "conv_id", "call_id", F.col("to").alias("at"), (F.col("distance") + F.col("more")).alias("distance"),
            F.col("there").alias("end"))
        open_ = checkpointed(open_.filter("end").unionByName(moved))
    return open_.filter("end").drop("end")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for a call that needs no other, else one more than the highest that it needs.

    Chains of calls that need one other are jumped over by doubling. What is left takes a round per level of calls that
    need several. Calls in or behind a cycle get no level. Needs that name no call of the conversation, or the call
    itself, are left out.
    """
    keys = ["conv_id", "call_id"]
    nodes = calls.select(*keys, "needs")
    pairs = nodes.select(*keys, F.explode(F.array_distinct("needs")).alias("at")).filter("at <> call_id")
    pairs = checkpointed(pairs.join(nodes.select("conv_id", F.col("call_id").alias("at")), ["conv_id", "at"]))
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("waits"))
    open_ = checkpointed(nodes.select(*keys).join(counts, keys, "left"))
    chains = chain_ends(pairs.join(open_.filter("waits = 1").select(*keys), keys), open_.count())
    # From here on, an edge leads from a call that needs several to the end of a chain.
    ends = chains.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("to"), "distance")
    several = pairs.join(open_.filter("waits > 1").select(*keys), keys).join(ends, ["conv_id", "at"], "left")
    edges = checkpointed(several.select(*keys, F.coalesce("to", "at").alias("at"), F.coalesce(
        F.col("distance") + 1, F.lit(1)).alias("distance")))
    done = placed = checkpointed(open_.filter("waits is null").select(*keys, F.lit(0).alias("level")))
    waiting = checkpointed(open_.filter("waits > 1").withColumn("level", F.lit(0)))
    while not (placed.isEmpty() or waiting.isEmpty()):
        met = edges.join(placed.select("conv_id", F.col("call_id").alias("at"), F.col("level").alias("below")), ["conv_id", "at"])
        met = met.groupBy(*keys).agg(F.count("*").alias("met"), F.max(F.col("below") + F.col("distance")).alias("reached"))
        waiting = checkpointed(waiting.join(met, keys, "left").select(
            *keys, (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits"),
            F.greatest("level", F.coalesce("reached", F.lit(0))).alias("level")))
        placed = waiting.filter("waits = 0").drop("waits")
        waiting = waiting.filter("waits > 0")
        done = done.unionByName(placed)
    at_end = done.withColumnsRenamed({"call_id": "at", "level": "below"})
    on_chains = chains.join(at_end, ["conv_id", "at"]).select(*keys, (F.col("below") + F.col("distance")).alias("level"))
    return done.unionByName(on_chains)


def exchanges(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, level, turn, call_id, status, n, valid, errors, message: a row per call or result.

    (level, turn, call_id) is the order in which a conversation's calls are to be replayed: what a call needs has a
    lower level; level is null for what is no linked call and for calls in a cycle, whose status is "cycle". `errors`
    are those of the arguments, null where there is no call. `message` is canonical JSON of the call with its result.
    Null and repeated identifiers: see linked. Arguments that parsed refuses are kept as their text, with one error. A text
    of any length is one value of one row; no rows in, no rows out. Columns besides CALL_COLUMNS and RESULT_COLUMNS are ignored.
    """
    rows = checkpointed(linked(calls.select(*CALL_COLUMNS), results.select(*RESULT_COLUMNS)))
    heads = rows.filter("status in ('linked', 'unanswered', 'out of order') and conv_id is not null and call_id is not null")
    order = levels(heads)

    @F.pandas_udf("errors array<string>, message string")
    def written(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out = []
            for call_id, name, arguments, content, status in zip(*columns):
                no_call = status in ("orphan", "repeated result")
                value, error = (None, None) if no_call else parsed(arguments)
                errors = None if no_call else [error] if error else faults(name, value, schemas)
                call = {"id": call_id, "name": name, "arguments": arguments if error else value}
                message = {"result": content, "call": None if no_call else call, "id": call_id}
                out.append((errors, canonical(message)))
            yield pd.DataFrame(out, columns=["errors", "message"])

    text = [F.col(c).cast("string") for c in ("call_id", "name", "arguments", "content", "status")]
    rows = rows.join(order, ["conv_id", "call_id"], "left").withColumn("w", written(*text))
    looped = F.col("level").isNull() & F.col("status").isin("linked", "unanswered", "out of order") & F.col(
        "call_id").isNotNull() & F.col("conv_id").isNotNull()
    return rows.select("conv_id", "level", "turn", "call_id", F.when(looped, "cycle").otherwise(F.col("status")).alias("status"),
                       "n", (F.size("w.errors") == 0).alias("valid"), "w.errors", "w.message")
