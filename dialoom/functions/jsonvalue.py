"""JSON values: strict parsing, canonical texts, tool-call matching.

Equality of free-form arguments is equality of canonical texts: keys sorted, every number and
boolean written as one number (so 1, 1.0 and true agree, as the metrics ask), strings quoted.
Parsing is Arrow-batched Python; all that follows stays in built-in functions.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = "name string, is_object boolean, args map<string,string>, whole string"


def canonical(value: object) -> str:
    """Canonical text of a parsed JSON value."""
    match value:
        case dict():
            return "{" + ",".join(f"{json.dumps(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
        case list():
            return "[" + ",".join(map(canonical, value)) + "]"
        case bool() | int() | float():
            number = float(value)
            return str(int(value)) if not math.isinf(number) and not math.isnan(number) and number == int(value) else repr(number)
        case None:
            return "null"
        case _:
            return json.dumps(value, ensure_ascii=False)


def parsed(text: str | None) -> tuple[bool, object]:
    """(valid, value) under a strict parser: trailing text is an error."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def leaves(value: object) -> list[str]:
    """Leaf values as text."""
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    return [str(value)]


def node_types(value: object, path: str = "") -> list[tuple[str, str, str]]:
    """(path, type, sorted keys of an object) of every node below the root; list places collapse to []."""
    found = []
    kind = {dict: "dict", list: "list", str: "str", bool: "bool", int: "int", float: "float"}.get(type(value), "null")
    if path:
        found.append((path, kind, ",".join(sorted(value)) if kind == "dict" else ""))
    if kind == "dict":
        for k, v in value.items():
            found += node_types(v, f"{path}.{k}" if path else k)
    elif kind == "list":
        for v in value:
            found += node_types(v, f"{path}.[]" if path else "[]")
    return found


def first_object(text: str) -> str | None:
    """The first JSON object that starts at a brace of the text and parses."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], sort_keys=True)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def _udf(schema: str, each):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(each, na_action=None)

    return F.pandas_udf(run, schema)


def is_valid(text: Column) -> Column:
    """Whether a strict parser takes the text."""
    return _udf("boolean", lambda t: parsed(t)[0])(text)


def canonical_text(text: Column) -> Column:
    """Canonical text, null for invalid JSON."""
    return _udf("string", lambda t: canonical(v[1]) if (v := parsed(t))[0] else None)(text)


def leaf_texts(text: Column) -> Column:
    return _udf("array<string>", lambda t: leaves(v[1]) if (v := parsed(t))[0] else [])(text)


def typed_paths(text: Column) -> Column:
    """(path, kind, keys) of every node of a JSON text."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"path": p, "kind": k, "keys": s} for p, k, s in node_types(parsed(t)[1])])

    return F.pandas_udf(run, "array<struct<path:string,kind:string,keys:string>>")(text)


def embedded_object(text: Column) -> Column:
    """First JSON object inside a text, keys sorted."""
    return _udf("string", lambda t: first_object(t) if t else None)(text)


def tool_call(text: Column) -> Column:
    """Name and arguments of a call: ``function`` wrappers, ``parameters`` and string arguments are unfolded."""

    def each(t: str | None) -> dict | None:
        ok, value = parsed(t)
        if not ok or not isinstance(value, dict):
            return None
        inner = value.get("function") if isinstance(value.get("function"), dict) else value
        args = inner.get("arguments", inner.get("parameters", {}))
        if isinstance(args, str) and inner is value:
            args = v if (v := parsed(args)[1]) is not None else args
        known = isinstance(args, dict)
        return {"name": str(inner.get("name", "")), "is_object": known, "args": {k: canonical(v) for k, v in args.items()} if known else {}, "whole": canonical(args)}

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [each(t) or {"name": None, "is_object": None, "args": None, "whole": None} for t in texts]
        return pd.DataFrame(rows, columns=["name", "is_object", "args", "whole"])

    return F.pandas_udf(run, CALL)(text)


def _agreeing(pred: Column, true: Column) -> Column:
    """Number of true arguments that the prediction has with an equal value."""
    return F.size(F.filter(F.map_entries(true["args"]), lambda e: F.coalesce(F.element_at(pred["args"], e["key"]) == e["value"], F.lit(False))))


def subtree_match(pred: Column, true: Column) -> Column:
    """Same name and every true argument present with an equal value."""
    objects = pred["is_object"] & true["is_object"]
    inside = F.when(objects, _agreeing(pred, true) == F.size(F.map_keys(true["args"]))).otherwise(pred["whole"] == true["whole"])
    return (pred["name"] == true["name"]) & inside


def _f1(hits: Column, pred: Column, true: Column) -> Column:
    both = (F.size(pred) == 0) & (F.size(true) == 0)
    return F.when(both, 1.0).otherwise(2 * hits / F.greatest(F.size(pred) + F.size(true), F.lit(1)))


def ast_f1(pred: Column, true: Column) -> Column:
    """F1 of calls: in order of prediction each takes the first free true call that it matches."""
    def take(free: Column, p: Column) -> Column:
        fits = F.filter(free, lambda i: subtree_match(p, F.get(true, i)))
        return F.when(F.size(fits) > 0, F.array_remove(free, F.get(fits, 0))).otherwise(free)

    places = F.filter(F.sequence(F.lit(0), F.size(true)), lambda i: i < F.size(true))
    return _f1(F.size(true) - F.size(F.aggregate(pred, places, take)), pred, true)


def pair_score(pred: Column, true: Column, name_weight: float = 0.4) -> Column:
    """0 for another name, else the name's weight and the rest by the share of true arguments that agree."""
    n = F.size(F.map_keys(true["args"]))
    share = F.when(n == 0, 1.0).otherwise(_agreeing(pred, true) / F.greatest(n, F.lit(1)))
    inside = F.when(pred["is_object"] & true["is_object"], F.lit(name_weight) + F.lit(1 - name_weight) * share)
    return F.when(pred["name"] != true["name"], 0.0).otherwise(F.coalesce(inside, F.when(pred["whole"] == true["whole"], 1.0).otherwise(name_weight)))


def graded_f1(pred: Column, true: Column) -> Column:
    """Soft F1: pairs are taken from the best score down, ties in order, each call once."""
    all_pairs = F.flatten(F.transform(pred, lambda p, i: F.transform(true, lambda t, j: F.struct((-pair_score(p, t)).alias("s"), i.alias("i"), j.alias("j")))))
    ordered = F.array_sort(F.filter(all_pairs, lambda x: x["s"] < 0))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("p"), F.array().cast("array<int>").alias("t"))

    def take(state: Column, x: Column) -> Column:
        taken = F.array_contains(state["p"], x["i"]) | F.array_contains(state["t"], x["j"])
        after = F.struct((state["sum"] - x["s"]).alias("sum"), F.array_append(state["p"], x["i"]).alias("p"), F.array_append(state["t"], x["j"]).alias("t"))
        return F.when(taken, state).otherwise(after)

    return _f1(F.aggregate(ordered, start, take, lambda state: state["sum"]), pred, true)
