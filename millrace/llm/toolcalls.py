"""Tool-call linking: calls meet results by identifier, are ordered, validated and serialised.

Calls and results are hash-joined by call id. A call may build on several earlier calls, its parents; its depth
is the longest way down from a call without known parents, and calls that are joined by such ways
make a chain, in which every call has a position behind all its parents. Arguments are validated against a
schema for each tool (the usual keywords of JSON Schema) and every record is written as canonical JSON as
RFC 8785 has it: keys in UTF-16 order, no spaces, no escapes beyond the needed ones, numbers as doubles.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, fresh, shuffles_freed, staged
from .components import components, with_root


def _number(x: float) -> str:
    """A double as ECMAScript writes it: the fewest digits that read back, plain from 1e-6 to below 1e21."""
    if x == 0:
        return "0"
    _, places, power = Decimal(repr(abs(x))).normalize().as_tuple()
    sign, digits = "-" * (x < 0), "".join(map(str, places))
    n, exponent = len(digits), len(digits) + power
    if n <= exponent <= 21:
        return sign + digits + "0" * (exponent - n)
    if 0 < exponent <= 21:
        return f"{sign}{digits[:exponent]}.{digits[exponent:]}"
    if -6 < exponent <= 0:
        return f"{sign}0.{'0' * -exponent}{digits}"
    power = exponent - 1
    return f"{sign}{digits[0]}{'.' * (n > 1)}{digits[1:]}e{'+' if power > 0 else '-'}{abs(power)}"


def canonical(value) -> str:
    """Canonical JSON of what _parsed gives, or of strings and nulls."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(float(value))
    return json.dumps(value, ensure_ascii=False)


def _parsed(text: str):
    """The value of a JSON text, all numbers as doubles; ValueError for what RFC 8785 has no form for: numbers beyond them, lone surrogates and repeated keys."""
    def finite(x: str) -> float:
        if not math.isfinite(v := float(x)):
            raise ValueError(x)
        return v

    def once(pairs: list[tuple]) -> dict:
        if len(out := dict(pairs)) < len(pairs):
            raise ValueError("a key comes twice")
        return out

    value = json.loads(text, parse_int=finite, parse_float=finite, parse_constant=finite, object_pairs_hook=once)
    canonical(value).encode()
    return value


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    plain = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
    return isinstance(value, plain[kind]) if kind in plain else number and (kind == "number" or float(value).is_integer())


# The keywords of JSON Schema that say nothing about what is valid, that hold one schema, a list of them, and a map of them.
ANNOTATIONS = {"title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"}
HOLD_ONE = {"items", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else"}
HOLD_LIST = {"prefixItems", "allOf", "anyOf", "oneOf"}
HOLD_MAP = {"properties", "patternProperties", "$defs", "definitions"}
PLAIN = {
    "type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minItems", "maxItems",
    "uniqueItems", "minContains", "maxContains", "required", "minProperties", "maxProperties", "dependentRequired", "$ref",
}
IN_PLACE = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else")


def _target(ref: str, root):
    """The schema that a reference within the document names."""
    at = root
    if not ref.startswith("#"):
        raise ValueError(f"a reference beyond the schema: {ref}")
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(at, dict) and part in at:
            at = at[part]
        elif isinstance(at, list) and part.isdigit() and int(part) < len(at):
            at = at[int(part)]
        else:
            raise ValueError(f"a reference to nothing: {ref}")
    return at


def check_schema(schema, root=None, above: tuple = ()) -> None:
    """ValueError for a schema with a keyword that schema_errors does not know, or with references to nothing or round in a circle."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return
    if unknown := sorted(schema.keys() - ANNOTATIONS - HOLD_ONE - HOLD_LIST - HOLD_MAP - PLAIN):
        raise ValueError(f"unknown schema keywords: {', '.join(unknown)}")
    if "$ref" in schema:
        if id(schema) in above:
            raise ValueError(f"references go round in a circle: {schema['$ref']}")
        target = _target(schema["$ref"], root)
        if not isinstance(target, (dict, bool)):
            raise ValueError(f"a reference to no schema: {schema['$ref']}")
        _in_place(target, root, (id(schema),))
    for k, v in schema.items():
        for inner in [v] if k in HOLD_ONE else v if k in HOLD_LIST else v.values() if k in HOLD_MAP else []:
            check_schema(inner, root)


def _in_place(schema, root, above: tuple) -> None:
    """Follows references and the keywords that apply to the same value."""
    if isinstance(schema, bool):
        return
    if id(schema) in above:
        raise ValueError("references go round in a circle")
    above = (*above, id(schema))
    if "$ref" in schema:
        _in_place(_target(schema["$ref"], root), root, above)
    for k in IN_PLACE:
        for inner in schema.get(k, []) if k in HOLD_LIST else [schema[k]] if k in schema else []:
            _in_place(inner, root, above)


def schema_errors(value, schema, at: str = "$", root=None) -> list[str]:
    """What is wrong with a value, as "path: keyword", in the order of paths. Values are equal as JSON is: true is not 1, 1.0 is.

    Of the keywords that combine schemas, allOf and $ref pass on what is wrong inside; anyOf, oneOf, not, contains and propertyNames
    name themselves. format is a note and tests nothing.
    """
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: false"]
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    out = [f"{at}: enum"] if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]) else []
    out += [f"{at}: const"] if "const" in schema and canonical(value) != canonical(schema["const"]) else []

    def wrong(broken: bool, keyword: str, place: str = at) -> None:
        if broken:
            out.append(f"{place}: {keyword}")

    def inside(v, inner, place: str) -> list[str]:
        return schema_errors(v, inner, place, root)

    def fits(v, inner) -> bool:
        return not inside(v, inner, at)

    if isinstance(value, str):
        wrong(len(value) < schema.get("minLength", 0), "minLength")
        wrong(len(value) > schema.get("maxLength", len(value)), "maxLength")
        wrong("pattern" in schema and not re.search(schema["pattern"], value), "pattern")
    elif _is(value, "number"):
        wrong(value < schema.get("minimum", value), "minimum")
        wrong(value > schema.get("maximum", value), "maximum")
        wrong("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"], "exclusiveMinimum")
        wrong("exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"], "exclusiveMaximum")
        wrong("multipleOf" in schema and Fraction(repr(value)) % Fraction(repr(schema["multipleOf"])) != 0, "multipleOf")
    elif isinstance(value, list):
        first = schema.get("prefixItems", [])
        for i, v in enumerate(value):
            out += inside(v, first[i] if i < len(first) else schema.get("items", {}), f"{at}[{i}]")
        wrong(len(value) < schema.get("minItems", 0), "minItems")
        wrong(len(value) > schema.get("maxItems", len(value)), "maxItems")
        wrong(schema.get("uniqueItems") is True and len({canonical(v) for v in value}) < len(value), "uniqueItems")
        if "contains" in schema:
            n = sum(fits(v, schema["contains"]) for v in value)
            wrong(n < schema.get("minContains", 1), "contains")
            wrong(n > schema.get("maxContains", n), "maxContains")
    elif isinstance(value, dict):
        known, by_pattern = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{at}.{k}: required" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            met = [known[k]] if k in known else []
            met += [inner for p, inner in by_pattern.items() if re.search(p, k)]
            for inner in met:
                out += inside(value[k], inner, f"{at}.{k}")
            if not met and schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: additionalProperties")
            elif not met and "additionalProperties" in schema:
                out += inside(value[k], schema["additionalProperties"], f"{at}.{k}")
            wrong("propertyNames" in schema and not fits(k, schema["propertyNames"]), "propertyNames", f"{at}.{k}")
            for needed in sorted(schema.get("dependentRequired", {}).get(k, [])):
                wrong(needed not in value, "dependentRequired", f"{at}.{needed}")
        wrong(len(value) < schema.get("minProperties", 0), "minProperties")
        wrong(len(value) > schema.get("maxProperties", len(value)), "maxProperties")
    if "$ref" in schema:
        out += inside(value, _target(schema["$ref"], root), at)
    for inner in schema.get("allOf", []):
        out += inside(value, inner, at)
    wrong("anyOf" in schema and not any(fits(value, s) for s in schema["anyOf"]), "anyOf")
    wrong("oneOf" in schema and sum(fits(value, s) for s in schema["oneOf"]) != 1, "oneOf")
    wrong("not" in schema and fits(value, schema["not"]), "not")
    if "if" in schema:
        out += inside(value, schema.get("then" if fits(value, schema["if"]) else "else", True), at)
    return out


def checked_arguments(tool: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """A struct of errors (joined by "; ", empty if none) and arguments as canonical JSON (null if they have none).

    ValueError for schemas with keywords that are not known, before any row is read.
    """
    for schema in schemas.values():
        check_schema(schema)

    @F.pandas_udf("errors string, arguments string")
    def of(tools: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for tool, text in zip(tools, texts):
            try:
                value = _parsed(text) if text is not None else None
                wrong = schema_errors(value, schemas[tool]) if tool in schemas else ["$: unknown tool"]
                rows.append(("; ".join(wrong), canonical(value)))
            except (ValueError, RecursionError):
                rows.append(("$: no JSON", None))
        return pd.DataFrame(rows, columns=["errors", "arguments"])

    return of(tool, arguments)


def _settled(up: DataFrame, total: int) -> DataFrame:
    """up: node, anchor, k, lost. Follows anchors to one that is null (no call above) or its own; the distance doubles each round.

    Only nodes that still move take part in a round, so that a few long chains cost no pass over all others. A node
    that comes back to itself, or still moves after as many steps as there are nodes, is on or behind a
    cycle: it is lost and becomes its own anchor.
    """
    moves = F.col("anchor").isNotNull() & (F.col("anchor") != F.col("node"))
    still, moving, reach = [up.filter(~moves)], staged(up.filter(moves), "moving"), 1
    made = [moving]
    while moving.take(1):
        known = moving
        for part in still:
            known = known.unionByName(part)
        known = known.select(F.col("node").alias("at"), F.col("anchor").alias("next"), F.col("k").alias("more"))
        joined = moving.join(known, F.col("anchor") == F.col("at"))
        root = F.col("next").isNotNull() & (F.col("next") == F.col("at"))
        back = ~root & F.col("next").isNotNull() & (F.lit(reach > total) | (F.col("next") == F.col("node")))
        anchor = F.when(root, F.col("at")).when(back, F.col("node")).otherwise(F.col("next"))
        k = F.when(root, F.col("k")).when(back, 0).otherwise(F.col("k") + F.col("more"))
        done = root | back | F.col("next").isNull()
        step = staged(joined.select("node", anchor.alias("anchor"), k.cast("long").alias("k"), back.alias("lost"), done.alias("done")), "anchors")
        made.append(step)
        still.append(step.filter("done").drop("done"))
        moving, reach = step.filter("not done").drop("done"), reach * 2
    out = still[0]
    for part in still[1:]:
        out = out.unionByName(part)
    out = staged(out, "settled")
    drop(up, *made)
    return out


def depths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes: node; edges: node, parent (both known, distinct). node and depth, staged: the longest way up, null on or behind a cycle.

    Nodes hang from their only parent, and ways of such steps are shortened by doubling. A node of several
    parents hangs from what they all hang from, by the longest way, as soon as that is one node; this goes on while
    there are such nodes. A chain or a tree takes a logarithmic number of joins; each node of several parents
    that hang from different ones adds a round to those above it.
    """
    one = edges.groupBy("node").agg(F.count("*").alias("n"), F.max("parent").alias("p"))
    up = nodes.join(one, "node", "left").select("node", F.when(F.col("n") == 1, F.col("p")).when(F.col("n") > 1, F.col("node")).alias("anchor"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("k"), F.coalesce((F.col("n") == 1) & (F.col("p") == F.col("node")), F.lit(False)).alias("lost"))
    up = staged(up, "anchors")
    total = up.count()
    while True:
        up = _settled(up, total)
        open_ = up.filter("anchor = node and not lost").select("node")
        to = up.select(F.col("node").alias("of"), "anchor", F.col("k").alias("way"))
        ways = edges.join(open_, "node", "left_semi").join(to, F.col("parent") == F.col("of")).groupBy("node", "anchor").agg(F.max("way").alias("way"))
        single = ways.groupBy("node").agg(F.count("*").alias("n"), F.first("anchor").alias("to"), F.max("way").alias("way")).filter("n = 1 and not (to <=> node)")
        single = staged(single.select(F.col("node").alias("of"), "to", "way"), "single")
        if not single.take(1):
            drop(single)
            break
        joined = up.join(single, F.col("node") == F.col("of"), "left")
        moved = F.col("of").isNotNull()
        old, up = up, staged(joined.select("node", F.when(moved, F.col("to")).otherwise(F.col("anchor")).alias("anchor"), F.when(moved, F.col("way") + 1).otherwise(F.col("k")).alias("k"), "lost"), "anchors")
        drop(old, single)
    out = staged(up.select("node", F.when(F.col("anchor").isNull(), F.col("k")).alias("depth")), "depths")
    drop(up)
    return out


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    """df, staged, with position: from 0 without gaps in each group of by, in that order; groups of any size spread over tasks."""
    parts, position = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), fresh(df, "position")
    run = df.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order)
    run = staged(run.select("*", F.monotonically_increasing_id().alias("at_"), F.spark_partition_id().alias("part_")), "ordered")
    counts = run.groupBy(F.col(by).alias("of_"), F.col("part_").alias("in_")).agg(F.count("*").alias("n"), F.min("at_").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of_").orderBy("in_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("of_", "in_", (before - F.col("first")).alias("base_"))
    out = staged(run.join(base, (F.col(by) == F.col("of_")) & (F.col("part_") == F.col("in_"))).withColumn(position, F.col("at_") + F.col("base_")).drop("at_", "part_", "of_", "in_", "base_"), "numbered")
    drop(run)
    return out


def ordered(calls: DataFrame) -> DataFrame:
    """calls: call_id (distinct), parents (array). ordered_id, chain (its least call id), depth and position, staged."""
    ids = staged(calls.select("call_id", "parents", F.monotonically_increasing_id().alias("node")), "call-nodes")
    known = ids.select(F.col("call_id").alias("known"), F.col("node").alias("up"))
    edges = ids.select("node", F.explode("parents").alias("parent_id")).join(known, F.col("parent_id") == F.col("known")).select("node", F.col("up").alias("parent")).distinct()
    edges = staged(edges, "call-edges")
    depth = depths(edges, ids.select("node"))
    roots = components(edges.select(F.col("node").alias("u"), F.col("parent").alias("v")), "call-chains")
    rows = with_root(ids.select("call_id", "node"), roots).join(depth, "node")
    rows = staged(rows.select("call_id", "root", "depth", F.coalesce("depth", F.lit(1 << 62)).alias("order")), "call-depths")
    names = rows.groupBy(F.col("root").alias("of")).agg(F.min("call_id").alias("chain"))
    out = staged(numbered(rows, "root", "order", "call_id").join(names, F.col("root") == F.col("of")).select(F.col("call_id").alias("ordered_id"), "chain", "depth", "position"), "call-order")
    drop(ids, edges, depth, roots, rows)
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: call_id, parents (array of ids), tool, arguments (JSON); results: call_id, content. A row for each call id of either.

    Returns call_id, parents (as given), tool, n_calls, n_results, status, chain, depth, position, errors and
    record, the canonical JSON of {arguments, id, name, result}. Of calls with the same id the least by
    (tool, arguments, parents) counts, of results the least content; n_calls and n_results tell how many there
    were. status is linked, unanswered, or orphan for a result without a call, which has no chain, depth, position,
    errors or record. Null parents and those that are no call's id are no parents. Calls on or behind a cycle
    have no depth and stand last in their chain, by id. Null ids meet nothing and are left out. Arguments
    that are no JSON, hold a lone surrogate or a number beyond doubles have the error "$: no JSON" and stand
    as null in the record; null arguments are the value null. Texts of any length are written whole. Empty tables
    give an empty result; other columns are not used.
    """
    with shuffles_freed(calls.sparkSession):
        one = calls.filter("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_calls"), F.min(F.struct("tool", "arguments", "parents")).alias("c"))
        one = staged(one.select("call_id", "n_calls", "c.*"), "calls")
        order = ordered(one.select("call_id", "parents"))
    answers = results.filter("call_id is not null").groupBy(F.col("call_id").alias("answered")).agg(F.count("*").alias("n_results"), F.min("content").alias("result"))
    joined = one.join(order, F.col("call_id") == F.col("ordered_id")).join(answers, F.col("call_id") == F.col("answered"), "full")
    joined = joined.withColumn("k", F.when(F.col("call_id").isNotNull(), checked_arguments(F.col("tool"), F.col("arguments"), schemas)))
    status = F.when(F.col("call_id").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked")

    @F.pandas_udf("string")
    def record(ids: pd.Series, tools: pd.Series, arguments: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([f'{{"arguments":{a or "null"},"id":{canonical(i)},"name":{canonical(t)},"result":{canonical(r)}}}' for i, t, a, r in zip(ids, tools, arguments, answers)])

    made = F.when(F.col("call_id").isNotNull(), record("call_id", "tool", F.col("k.arguments"), F.col("result")))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_calls", "n_results")]
    return joined.select(F.coalesce("call_id", "answered").alias("call_id"), "parents", "tool", *counts, status.alias("status"), "chain", "depth", "position", F.col("k.errors").alias("errors"), made.alias("record"))


_TEXT = {"type": "string", "minLength": 1, "maxLength": 400}
_KIND = {"enum": ["question", "statement"]}
#: The tools that conversation_calls derives, with their schemas; "system" has none.
TURN_SCHEMAS = {
    "open": {"type": "object", "required": ["kind", "text"], "additionalProperties": False, "properties": {"kind": _KIND, "text": _TEXT}},
    "follow": {"type": "object", "required": ["kind", "text", "turn"], "additionalProperties": False, "properties": {"kind": _KIND, "text": _TEXT, "turn": {"type": "integer", "minimum": 2, "maximum": 5}}},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a table of turns (conv_id, turn, role, text) implies, whole texts as arguments and contents.

    Every user and system turn is a call with its text. A user turn builds on the user turn two before it, every fourth
    turn on the one four before it too, and the first two on a system turn right before. Every assistant
    turn is the result for the turn before it. Rows without a conversation or turn are left out, null texts are empty.
    """
    def name(turn: Column) -> Column:
        return F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)

    known = turns.filter("conv_id is not null and turn is not null")
    text, turn, follow = F.coalesce(F.col("text"), F.lit("")), F.col("turn"), F.col("turn") >= 2
    kind = F.when(text == "", "nothing").when(text.endswith("?"), "question").otherwise("statement").alias("kind")
    arguments = F.to_json(F.struct(F.when(follow, turn).alias("turn"), text.alias("text"), kind))
    parents = F.filter(F.array(F.when(turn >= 1, name(turn - F.when(follow, 2).otherwise(1))), F.when((turn % 4 == 0) & (turn >= 4), name(turn - 4))), lambda p: p.isNotNull())
    tool = F.when(F.col("role") == "system", "system").when(follow, "follow").otherwise("open")
    calls = known.filter("role in ('user', 'system')").select(name(turn).alias("call_id"), parents.alias("parents"), tool.alias("tool"), arguments.alias("arguments"))
    results = known.filter("role = 'assistant'").select(name(turn - 1).alias("call_id"), text.alias("content"))
    return calls, results
