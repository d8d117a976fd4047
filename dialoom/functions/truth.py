"""Ground-truth tool calls: which ones carry made-up required arguments or impossible scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders of generated arguments and the names of score arguments.
NULL_SENTINEL = r"(?i)^(unknown|n/?a|none|null|tbd|placeholder|pending|0{3,}|0000+)$"
SCORE_ARGUMENTS = ("score", "rating", "nps", "satisfaction", "csat")
LEAST_SCORE, MOST_SCORE = 0, 10

CALLS = "array<struct<name:string,arguments:map<string,variant>>>"
_TOOL = "name:string,parameters:struct<required:array<string>>"
TOOLS = f"array<struct<function:struct<{_TOOL}>,{_TOOL}>>"


def tools(schemas: Column) -> Column:
    """(name, required) of each named tool in a JSON list of schemas, wrapped in "function" or not; bad JSON is no tool."""
    bare = F.transform(F.from_json(schemas, TOOLS), lambda t: F.coalesce(t["function"], F.struct(t["name"], t["parameters"])))
    listed = F.transform(bare, lambda t: F.struct(t["name"].alias("name"), F.coalesce(t["parameters"]["required"], F.array().cast("array<string>")).alias("required")))
    return F.coalesce(F.filter(listed, lambda t: t["name"] != ""), F.array().cast("array<struct<name:string,required:array<string>>>"))


def is_made_up(arguments: Column, required: Column) -> Column:
    """Whether a score lies outside its range (booleans are no scores) or a required text is a placeholder; null arguments are not."""

    def bad(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        kind = F.schema_of_variant(value)
        number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))
        score = F.lower(key).isin(*SCORE_ARGUMENTS) & ~number.between(LEAST_SCORE, MOST_SCORE)
        text = F.when(kind == "STRING", F.regexp_replace(F.try_variant_get(value, "$", "string"), r"(?U)^\s+|\s+$", ""))
        return F.coalesce(score, F.lit(False)) | F.coalesce(F.array_contains(required, key) & text.rlike(NULL_SENTINEL), F.lit(False))

    return F.coalesce(F.exists(F.map_entries(arguments), bad), F.lit(False))


def sane_calls(calls: Column, schemas: Column) -> Column:
    """Calls of a JSON list that are not made up, in order; a tool without schema requires nothing, the last schema of a name counts."""
    known = tools(schemas)

    def sane(call: Column) -> Column:
        mine = F.filter(known, lambda t: t["name"] == call["name"])
        return ~is_made_up(call["arguments"], F.coalesce(F.try_element_at(mine, F.lit(-1))["required"], F.array().cast("array<string>")))

    return F.coalesce(F.filter(F.from_json(calls, CALLS), sane), F.array().cast(CALLS))
