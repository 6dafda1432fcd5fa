"""Chat formatting: tool calls linked with their results.

Calls and results meet in a hash join on (conversation, identifier); results are summed per
identifier first, so repeated identifiers make no square. Arguments are parsed once to a variant,
checked against the schema of their tool, with its nested objects, items and allowed values, and
serialised as canonical JSON: keys sorted, no space, each number in one form.

The topological order gives each call a place (step, depth) such that it comes after every call it
depends on: step is its turn, or that of the latest call it waits for, and depth is its longest wait
within a step. A call that only refers to earlier turns has its own turn. Conversations with references
to later ones are settled in rounds: a call takes over what the calls that it refers to know, and a
reference to a call that has but one reference itself jumps over it, so a chain takes rounds by the
logarithm of its length; calls with several references take a round for each such call on the longest
way. What depends on itself gets no place, nor does what would wait for it within its step; other calls
keep theirs. All DataFrame functions. A round that the next one has read is removed.

Cases: null or invalid arguments fail validation and are written as null; a call without a result
is "pending", one with several "repeated"; a result without a call is dropped; rows with a null
conversation or identifier never link; unknown tools fail validation; references to unknown calls
are violations and don't delay; repeated calls keep their rows; empty and very long texts are values
like others; an empty table gives an empty result; other columns aren't read. A number is an integer
if its value is one, however it is written; integral numbers of up to 15 digits that were written with
a point or an exponent are written without.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.llm.common import drop_all, work_dir, written

#: Types as schema_of_variant names them; numbers are integers, decimals or doubles there.
TYPES = {"string": r"^STRING$", "boolean": r"^BOOLEAN$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "integer": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "array": r"^ARRAY", "object": r"^OBJECT"}
#: A number in JSON that may have other forms; pieces of JSON: a string, a number, what is between.
OTHER_FORM = r"\d[.eE]"
PIECE = r"\"(?:[^\"\\]++|\\.)*+\"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[^\"\d-]+|-"


@dataclass(frozen=True)
class Argument:
    """name: of a property, "" of an item. enum: the values that it may have, if not all. items: of an
    array; properties: of an object, which has no others if any are named."""

    name: str
    kind: str
    required: bool = True
    enum: tuple = ()
    items: Argument | None = None
    properties: tuple[Argument, ...] = ()


@dataclass(frozen=True)
class Tool:
    name: str
    arguments: tuple[Argument, ...]


def _property(value: Column, name: str) -> Column:
    """A property, whatever its name: paths have no escapes, so a name with both kinds of quotes
    is looked up in a map."""
    if "'" in name and '"' in name:
        return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def _wrong(value: Column, a: Argument, path: str) -> list[Column]:
    """What is wrong with a value (a variant) that is there: texts, null where nothing is."""
    kind = F.schema_of_variant(value)
    right = kind.rlike(TYPES[a.kind])
    if a.kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        right = right & (kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") | (number == F.floor(number)))
    right = F.coalesce(right, F.lit(False))
    out = [F.when(value.isNotNull() & ~right, F.lit(f"{path} isn't of type {a.kind}"))]
    if a.enum:
        told = F.try_variant_get(value, "$", "string")
        out.append(F.when(right & ~told.isin(*map(str, a.enum)), F.lit(f"{path} isn't one of {', '.join(map(str, a.enum))}")))
    if a.items:
        listed = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        bad = F.exists(listed, lambda x: F.schema_of_variant(x).isNull() | (F.size(F.array_compact(F.array(*_wrong(x, a.items, path)))) > 0))
        out.append(F.when(right & bad, F.lit(f"{path} has an item that isn't as it should be")))
    if a.properties:
        out += [F.when(right, w) for w in _of_object(value, a.properties, path)]
    return out


def _of_object(value: Column, arguments: tuple[Argument, ...], path: str = "") -> list[Column]:
    out = []
    for a in arguments:
        own, name = _property(value, a.name), f"{path}.{a.name}" if path else a.name
        if a.required:
            out.append(F.when(own.isNull(), F.lit(f"{name} is missing")))
        out += [F.when(own.isNotNull(), w) for w in _wrong(own, a, name)]
    return out


def _unknown(value: Column, a: tuple[Argument, ...], path: str = "") -> list[Column]:
    """Arrays of texts on properties that no argument names, of an object and those in it."""
    keys = F.json_object_keys(F.to_json(value))
    extra = F.transform(F.array_sort(F.array_except(keys, F.array(*(F.lit(x.name) for x in a)))), lambda k: F.concat(F.lit(f"{path}." if path else ""), k, F.lit(" isn't an argument")))
    nested = [u for x in a if x.properties for u in _unknown(_property(value, x.name), x.properties, f"{path}.{x.name}" if path else x.name)]
    return [F.coalesce(extra, F.array().cast("array<string>")), *nested]


def violations(tool: Column, arguments: Column, tools: list[Tool]) -> Column:
    """What is wrong with a call, as an array of texts; arguments is a variant."""
    of_tool = F.array(F.lit("unknown tool"))
    for t in tools:
        found = [F.when(arguments.isNull(), F.lit("arguments aren't JSON")), *(F.when(arguments.isNotNull(), w) for w in _of_object(arguments, t.arguments))]
        of_tool = F.when(tool == t.name, F.concat(F.array_compact(F.array(*found)), *_unknown(arguments, t.arguments))).otherwise(of_tool)
    return of_tool


def canonical_numbers(json: Column) -> Column:
    """JSON whose integral numbers of up to 15 digits have neither point nor exponent."""

    def one(piece: Column) -> Column:
        value = piece.try_cast("double")
        plain = F.when((F.abs(value) < 1e15) & (value == F.floor(value)), F.concat(F.when((value < 0), F.lit("-")).otherwise(F.lit("")), F.abs(value).cast("bigint").cast("string")))
        return F.when(piece.rlike(r"^-?\d"), F.coalesce(plain, piece)).otherwise(piece)

    return F.when(json.rlike(OTHER_FORM), F.array_join(F.transform(F.regexp_extract_all(json, F.lit(PIECE), F.lit(0)), one), "")).otherwise(json)


def order(calls: DataFrame, folder: str) -> DataFrame:
    """conv_id, call_id, step and depth of each distinct call; null where it waits for a circle.
    calls: conv_id, call_id, turn, needs (an array of call ids)."""
    nodes = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").cast("bigint").alias("step"))
    edges = calls.where("call_id is not null").select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    links = edges.join(_as_need(nodes, "step", "need_step"), ["conv_id", "need"]).join(nodes, ["conv_id", "call_id"])
    links = written(links.select("conv_id", "call_id", "need", (F.col("need_step") >= F.col("step")).alias("ahead")), folder, "links")
    ahead = links.where("ahead").select("conv_id").distinct()
    alone = lambda df: df.select("conv_id", "call_id", "step", F.lit(0).alias("depth"))
    if ahead.isEmpty():
        return alone(nodes)
    # A call that waits makes those wait that need it, so in these conversations all references count.
    links = written(links.drop("ahead").join(ahead, "conv_id", "left_semi"), folder, "open")
    steps = _steps(written(nodes.join(ahead, "conv_id", "left_semi"), folder, "steps0"), links, folder)
    waits = links.join(_as_need(steps, "step", "need_step"), ["conv_id", "need"]).join(steps, ["conv_id", "call_id"]).where("need_step <=> step")
    depths, stuck = _depths(written(waits.select("conv_id", "call_id", "need", F.lit(1).cast("bigint").alias("w")), folder, "waits0"), folder)
    places = steps.join(depths, ["conv_id", "call_id"], "left").join(stuck.withColumn("stuck", F.lit(True)), ["conv_id", "call_id"], "left")
    free = F.col("stuck").isNull()
    places = places.select("conv_id", "call_id", F.when(free, F.col("step")).alias("step"), F.when(free, F.coalesce("least", F.lit(0)).cast("int")).alias("depth"))
    places = written(places, folder, "places")
    others = alone(nodes.join(written(ahead, folder, "ahead"), "conv_id", "left_anti"))
    drop_all(calls.sparkSession, folder, "links", "open", "steps0", "steps", "waits0", "waits", "least")
    return others.union(places)


def _as_need(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.select("conv_id", F.col("call_id").alias("need"), F.col(value).alias(name))


def _steps(steps: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """The latest step that each call reaches. References end in what was known before they jumped,
    so once no step moves every call has the latest of all that it reaches; circles don't keep the
    steps from coming to rest."""
    for k in count(1):
        after = links.join(_as_need(steps, "step", "need_step"), ["conv_id", "need"]).groupBy("conv_id", "call_id").agg(F.max("need_step").alias("after"))
        new = steps.join(after, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("step", "after").alias("step"), F.col("step").alias("was"))
        new = written(new, folder, f"steps/{k}")
        moved, steps = new.where("not step <=> was"), new.drop("was")
        if moved.isEmpty():
            return steps
        outs = links.groupBy("conv_id", F.col("call_id").alias("need")).agg(F.count("*").alias("n"), F.min("need").alias("only"))
        # What a call without references knows has been taken over.
        on = links.join(outs, ["conv_id", "need"]).select("conv_id", "call_id", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("need")).alias("need"))
        links = written(on.where("call_id <> need").distinct(), folder, f"open/{k}")
        drop_all(steps.sparkSession, folder, f"steps/{k - 1}", f"open/{k - 1}")
    raise AssertionError


def _depths(waits: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The longest wait of each call that waits (least), and the calls whose waits never end. Of a wait
    (call_id, need, w) that ends at a call without waits the length is known; one that goes on over a
    call with a single wait is made longer by it."""
    least = waits.select("conv_id", "call_id", F.lit(0).cast("bigint").alias("least")).where("false")
    for k in count(1):
        outs = waits.groupBy("conv_id", F.col("call_id").alias("need")).agg(F.count("*").alias("n"), F.min(F.struct("need", "w")).alias("only"))
        both = waits.join(outs, ["conv_id", "need"], "left").join(_as_need(least, "least", "of_need"), ["conv_id", "need"], "left")
        both = written(both, folder, f"waits/both{k}")
        if both.where("n is null").isEmpty():
            return least, waits.select("conv_id", "call_id").distinct()
        known = both.where("n is null or n = 1").select("conv_id", "call_id", (F.col("w") + F.coalesce("of_need", F.lit(0))).alias("least"))
        least = written(least.union(known).groupBy("conv_id", "call_id").agg(F.max("least").alias("least")), folder, f"least/{k}")
        single = F.col("n") == 1
        on = both.where("n is not null").select("conv_id", "call_id", F.when(single, F.col("only.need")).otherwise(F.col("need")).alias("need"), F.when(single, F.col("w") + F.col("only.w")).otherwise(F.col("w")).alias("w"))
        waits = written(on.groupBy("conv_id", "call_id", "need").agg(F.max("w").alias("w")), folder, f"waits/{k}")
        drop_all(waits.sparkSession, folder, f"waits/both{k}", f"waits/{k - 1}", f"least/{k - 1}")
    raise AssertionError


def link_calls(calls: DataFrame, results: DataFrame, tools: list[Tool]) -> DataFrame:
    """A row for each call: conv_id, call_id, tool, step, depth, status, violations, valid, and
    json, its canonical record with arguments and result.

    calls: conv_id, call_id, turn, tool, arguments (JSON text), needs (an array of call ids).
    results: conv_id, call_id, content."""
    folder = work_dir(calls.sparkSession)
    parsed = calls.select("conv_id", "call_id", "turn", "tool", "needs", F.try_parse_json("arguments").alias("v"))
    result = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("content").alias("content"))
    linked = parsed.join(result.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(order(calls, folder), ["conv_id", "call_id"], "left")
    known = calls.where("call_id is not null").select("conv_id", F.col("call_id").alias("need")).distinct()
    wanted = calls.select("conv_id", "call_id", F.explode("needs").alias("need"))
    lost = wanted.join(known, ["conv_id", "need"], "left_anti").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(F.concat("need", F.lit(" isn't a call")))).alias("lost"))
    linked = linked.join(lost, ["conv_id", "call_id"], "left")
    none = F.array().cast("array<string>")
    found = F.concat(violations(F.col("tool"), F.col("v"), tools), F.coalesce("lost", none))
    status = F.when(F.col("n") > 1, "repeated").when(F.col("n") == 1, "linked").otherwise("pending")
    text = lambda c: F.coalesce(F.get(F.split(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":", 2), 1), F.lit("null}"))
    quoted = lambda c: F.substring(text(c), F.lit(1), F.length(text(c)) - 1)  # noqa: E731  a JSON string, or null
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical_numbers(F.to_json("v")), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"name":'), quoted(F.col("tool")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}"),
    )
    return linked.select("conv_id", "call_id", "tool", "step", "depth", status.alias("status"), found.alias("violations"), (F.size(found) == 0).alias("valid"), json.alias("json"))
