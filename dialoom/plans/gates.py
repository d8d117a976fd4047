"""Queries on entry gates, schema checks, prompt enrichment, greedy matches and sink guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import jsonvalue, texts
from dialoom.plans.base import Plans
from dialoom.plans.structures import _CALLS, _calls
from dialoom.sources import jsonl, table

P = Plans()
MARK = "## Structured reference"


@P.query("join13_greedy_matches", "WITH c AS (" + _CALLS.replace("{lineitem}", "lineitem") + ") SELECT k, count(*) FILTER (WHERE name = pname AND q = pq) AS matched FROM c GROUP BY k")
def _(spark, d):
    f1 = jsonvalue.ast_f1(F.col("pred"), F.col("true"))
    return _calls(spark, d).select("k", F.round(f1 * (F.size("pred") + F.size("true")) / 2).cast("long").alias("matched"))


@P.query("snk03_no_overwrite", "SELECT count(*) AS n, true AS guarded FROM documents")
def _(spark, d):
    path = jsonl.scratch(spark, "guarded")
    rows = table(spark, d, "documents").select("doc_id")
    jsonl.write_jsonl(rows.limit(0), path)
    try:
        jsonl.write_jsonl(rows, path)
        guarded = False
    except Exception as e:  # noqa: BLE001
        guarded = "exist" in str(e).lower()
    jsonl.write_jsonl(rows, path, force=True)
    return spark.read.schema("doc_id long").json(path).agg(F.count("*").alias("n"), F.lit(guarded).alias("guarded"))


@P.query("src06_file_or_folder", "SELECT 2 * count(*) AS n FROM documents")
def _(spark, d):
    path = jsonl.scratch(spark, "either")
    table(spark, d, "documents").select(F.to_json(F.struct("doc_id")).alias("raw")).coalesce(1).write.text(path)
    name = jsonl.files_in(spark, path, "*.txt").first()["name"]
    either = jsonl.lines(spark, path, "*.txt").union(jsonl.lines(spark, f"{path}/{name}", "*.txt"))
    return either.agg(F.count("*").alias("n"))


@P.query("jsn09_schema_defects", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'bad node id;' WHEN 2 THEN 'no terminal states;' ELSE 'no initial state;' END AS defects FROM events""")
def _(spark, d):
    m = F.col("event_id") % 4
    node = F.when(m == 1, "X1").otherwise("S1")
    text = F.concat(
        F.lit('{"nodes": [{"id": "'), node, F.lit('", "name": "A"}], "edges": []'), F.when(m == 3, "").otherwise(', "initial_state": "S1"'),
        F.lit(', "terminal_states": ['), F.when(m == 2, "").otherwise('"S1"'), F.lit("]}"),
    )
    g = F.from_json(text, "nodes array<struct<id:string,name:string>>, edges array<struct<from_state:string,to_state:string,condition:string,priority:int>>, initial_state string, terminal_states array<string>")
    defects = F.array_compact(F.array(
        F.when(F.coalesce(F.exists(g["nodes"], lambda n: ~n["id"].rlike(r"^S\d+$") | n["name"].isNull()), F.lit(True)), "bad node id;"),
        F.when(g["initial_state"].isNull(), "no initial state;"), F.when(F.coalesce(F.size(g["terminal_states"]) < 1, F.lit(True)), "no terminal states;"),
    ))
    return table(spark, d, "events").select("event_id", F.array_join(defects, "").alias("defects"))


@P.query("str14_entry_gate", "SELECT doc_id, (CASE WHEN doc_id % 5 = 0 THEN 'bad role;' ELSE '' END) || (CASE WHEN length(text) < 20 OR length(text) > 600 THEN 'bad length;' ELSE '' END) AS errors FROM documents")
def _(spark, d):
    role = F.when(F.col("doc_id") % 5 == 0, "narrator").otherwise("user")
    errors = F.array_compact(F.array(F.when(~role.isin("user", "assistant"), "bad role;"), F.when(~F.length("text").between(20, 600), "bad length;")))
    return table(spark, d, "documents").select("doc_id", F.array_join(errors, "").alias("errors"))


@P.query("prj04_enriched_prompt", f"SELECT doc_id, lang || chr(10) || '{MARK}' || chr(10) || source AS prompt FROM documents")
def _(spark, d):
    enrich = lambda c: F.when(F.contains(c, F.lit(MARK)), c).otherwise(F.concat(c, F.lit(f"\n{MARK}\n"), F.col("source")))
    return table(spark, d, "documents").select("doc_id", enrich(enrich(F.col("lang"))).alias("prompt"))


@P.query("str10_quoted_anchor", "SELECT p_partkey, true AS found FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.mentions(F.concat(F.lit("see ("), F.col("p_brand"), F.lit(").")), F.col("p_brand")).alias("found"))


QUERIES, ORACLE = P.queries, P.oracle
