"""Line-delimited JSON: strict, lenient and counting scans, and sinks that guard what they write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions.jsonvalue import is_valid


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder of the session, or under /tmp for a local master without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/dialoom-scratch"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """stem, line_no (from 0) and raw text of every line; files are ordered by name and a byte-order mark is dropped.

    Each file is one value, so line numbers are exact; corpora in files too large for that should
    carry a line number of their own.
    """
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]*$", 1)
    found = files.select(name.alias("stem"), F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\n")).alias("line_no", "raw"))
    return found.filter(F.trim("raw") != "")


def files_in(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Names of the files of a folder that match a pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def strict(rows: DataFrame, schema: str) -> DataFrame:
    """Parsed lines; the first bad one ends the job with its file and line."""
    where = F.concat(F.lit("bad JSON at "), F.col("stem"), F.lit(":"), (F.col("line_no") + 1).cast("string"))
    checked = rows.select("stem", "line_no", F.when(is_valid(F.col("raw")), F.col("raw")).otherwise(F.raise_error(where)).alias("raw"))
    return checked.select("stem", "line_no", F.from_json("raw", schema).alias("r")).select("stem", "line_no", "r.*")


def marked(rows: DataFrame) -> DataFrame:
    """Lines with ``bad``: kept as they are and reported, never dropped."""
    return rows.withColumn("bad", ~is_valid(F.col("raw")))


def lenient(rows: DataFrame, keep: Column) -> DataFrame:
    """Raw lines that are malformed or meet ``keep``, for a byte-preserving rewrite."""
    return marked(rows).filter(F.col("bad") | keep)


def dropping(rows: DataFrame, schema: str) -> DataFrame:
    """Parsed good lines only; ``marked`` counts the others."""
    return marked(rows).filter(~F.col("bad")).select("stem", "line_no", F.from_json("raw", schema).alias("r")).select("stem", "line_no", "r.*")


def contract(rows: DataFrame, required: list[str]) -> DataFrame:
    """The rows, if there are any and each has every required field; else an error."""
    if rows.isEmpty():
        raise ValueError("no rows")
    bad = F.lit(False)
    for c in required:
        bad |= F.col(c).isNull()
    n = rows.filter(bad).count()
    if n:
        raise ValueError(f"{n} rows lack one of {required}")
    return rows


def document_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a single JSON document {"rows": [...]}, in the order of row_index."""
    doc = spark.read.schema(f"rows array<struct<{schema}>>").json(path, multiLine=True)
    return doc.select(F.inline("rows")).orderBy("row_index")


def last_wins(rows: DataFrame, key: str) -> DataFrame:
    """The last line of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("stem"), F.desc("line_no"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def first_match(rows: DataFrame, condition: Column) -> DataFrame:
    """Point lookup: the first row in file order that meets a condition."""
    return rows.filter(condition).orderBy("stem", "line_no").limit(1)


def write_jsonl(rows: DataFrame, path: str, force: bool = False, by: list[str] | None = None) -> None:
    """One JSON object a line, nulls written; an existing folder is kept unless ``force``."""
    writer = rows.write.option("ignoreNullFields", "false").mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(*by) if by else writer).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append; the committer leaves no torn lines."""
    rows.write.option("ignoreNullFields", "false").mode("append").json(path)


def write_lines(rows: DataFrame, path: str, raw: str = "raw") -> None:
    """Raw lines, byte for byte."""
    rows.select(raw).write.mode("errorifexists").text(path)


def write_if_clean(rows: DataFrame, violations: DataFrame, path: str) -> None:
    """Write only if an integrity query found nothing."""
    found = [r.asDict() for r in violations.limit(5).collect()]
    if found:
        raise ValueError(f"nothing written: {found}")
    write_jsonl(rows, path)


def cached(rows: DataFrame, root: str, recipe: str) -> DataFrame:
    """A parquet copy under a digest of plan and recipe, built at the first use."""
    spark = rows.sparkSession
    key = uuid.uuid5(uuid.NAMESPACE_OID, recipe + rows._jdf.queryExecution().analyzed().canonicalized().toString()).hex
    path = f"{root}/cache-{key}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
