"""Queries on scans and sinks: each writes lines, reads them back and is checked against the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.plans.base import Plans
from dialoom.sources import jsonl, table

P = Plans()
ROW = "doc_id bigint, lang string, n_chars bigint"


def _written(spark, d, name, spoil=None):
    """Documents as JSON lines in a scratch folder, some of them spoiled."""
    raw = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    rows = table(spark, d, "documents").select(raw.alias("raw") if spoil is None else F.when(spoil, F.concat(raw, F.lit(" tail"))).otherwise(raw).alias("raw"))
    path = jsonl.scratch(spark, name)
    rows.write.text(path)
    return jsonl.lines(spark, path, "*.txt"), path


@P.query("src01_strict_scan", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, d):
    return jsonl.strict(_written(spark, d, "strict")[0], ROW).select("doc_id", "lang", "n_chars")


@P.query("src02_lenient_scan", "SELECT count(*) AS kept FROM documents WHERE doc_id % 10 = 0 OR lang = 'fr'")
def _(spark, d):
    rows, _ = _written(spark, d, "lenient", F.col("doc_id") % 10 == 0)
    return jsonl.lenient(rows, F.contains("raw", F.lit('"lang":"fr"'))).agg(F.count("*").alias("kept"))


@P.query("src03_error_rows", "SELECT doc_id % 10 = 0 AS bad, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    rows, _ = _written(spark, d, "errors", F.col("doc_id") % 10 == 0)
    return jsonl.marked(rows).groupBy("bad").agg(F.count("*").alias("n"))


@P.query("src04_dropping_scan", "SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 0")
def _(spark, d):
    rows, _ = _written(spark, d, "dropping", F.col("doc_id") % 10 == 0)
    return jsonl.dropping(rows, ROW).select("doc_id", "lang")


@P.query("src05_line_numbers", "SELECT count(*) AS n, count(*) AS n_places FROM documents")
def _(spark, d):
    rows, _ = _written(spark, d, "places")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("stem", "line_no").alias("n_places"))


@P.query("src07_single_document", "SELECT r_regionkey AS row_index, r_name AS name FROM region")
def _(spark, d):
    rows = table(spark, d, "region").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("r_regionkey").alias("row_index"), F.col("r_name").alias("name"))).alias("rows"))).alias("value"))
    path = jsonl.scratch(spark, "document")
    rows.coalesce(1).write.text(path)
    return jsonl.document_rows(spark, path, "row_index:int,name:string")


@P.query("src08_level_files", "SELECT lang AS level, count(*) AS n FROM documents WHERE lang IN ('en', 'es') GROUP BY lang")
def _(spark, d):
    path = jsonl.scratch(spark, "levels")
    jsonl.write_jsonl(table(spark, d, "documents").select("doc_id", F.col("lang").alias("level")), path, by=["level"])
    return spark.read.schema("doc_id long, level string").json(path).filter(F.col("level").startswith("e")).groupBy("level").agg(F.count("*").alias("n"))


@P.query("src09_contract", "SELECT count(*) AS n FROM documents")
def _(spark, d):
    rows = jsonl.dropping(_written(spark, d, "contract")[0], ROW)
    return jsonl.contract(rows, ["doc_id", "lang"]).agg(F.count("*").alias("n"))


@P.query("src14_point_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id = 17")
def _(spark, d):
    return jsonl.first_match(jsonl.dropping(_written(spark, d, "lookup")[0], ROW), F.col("doc_id") == 17).select("doc_id", "lang")


@P.query("snk01_jsonl_round_trip", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang FROM documents")
def _(spark, d):
    path = jsonl.scratch(spark, "roundtrip")
    jsonl.write_jsonl(table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang")), path)
    return spark.read.schema("doc_id long, lang string").json(path)


@P.query("snk02_kept_lines", "SELECT count(*) AS n FROM documents WHERE doc_id % 10 = 0 OR lang = 'en'")
def _(spark, d):
    rows, _ = _written(spark, d, "kept", F.col("doc_id") % 10 == 0)
    path = jsonl.scratch(spark, "rewritten")
    jsonl.write_lines(jsonl.lenient(rows, F.contains("raw", F.lit('"lang":"en"'))), path)
    return spark.read.text(path).agg(F.count("*").alias("n"))


@P.query("snk04_partitioned", "SELECT source, lang, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY source, lang")
def _(spark, d):
    path = jsonl.scratch(spark, "partitioned")
    jsonl.write_jsonl(table(spark, d, "documents").select("doc_id", "source", "lang"), path, by=["lang", "source"])
    return spark.read.schema("doc_id long, lang string, source string").json(path).filter("lang = 'de'").groupBy("source", "lang").agg(F.count("*").alias("n"))


@P.query("snk05_report", "SELECT count(*) AS kept, count(DISTINCT lang) AS langs FROM documents")
def _(spark, d):
    path = jsonl.scratch(spark, "report")
    jsonl.write_jsonl(table(spark, d, "documents").agg(F.count("*").alias("kept"), F.countDistinct("lang").alias("langs")), path)
    return spark.read.schema("kept long, langs long").json(path)


@P.query("snk06_cached_view", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    root = jsonl.scratch(spark, "views")
    view = lambda: jsonl.cached(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), root, "by-lang")
    view()
    return view()


@P.query("snk07_append", "SELECT lang, 2 * count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    path = jsonl.scratch(spark, "append")
    rows = table(spark, d, "documents").select("doc_id", "lang")
    jsonl.append_jsonl(rows, path)
    jsonl.append_jsonl(rows, path)
    return spark.read.schema("doc_id long, lang string").json(path).groupBy("lang").agg(F.count("*").alias("n"))


@P.query("snk08_write_if_clean", "SELECT count(*) AS n FROM documents")
def _(spark, d):
    path = jsonl.scratch(spark, "clean")
    rows = table(spark, d, "documents").select("doc_id")
    jsonl.write_if_clean(rows, rows.groupBy("doc_id").count().filter("count > 1"), path)
    return spark.read.schema("doc_id long").json(path).agg(F.count("*").alias("n"))


QUERIES, ORACLE = P.queries, P.oracle
