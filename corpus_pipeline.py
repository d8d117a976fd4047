"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import langid, linededup, mixing, neardup, packing
from dialoom.llm.storage import documents_schema, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language can be told (null text or no letter) and set ``lang`` to the prediction."""
    found = langid.identify(docs.select(*documents_schema()), langid.labelled_sample(docs))
    kept = found.filter(F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumn("lang", F.col("lang_pred")).select(*documents_schema())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated three-line passages; a document of which no letter stays goes."""
    cleaned = linededup.drop_repeated_lines(docs.select(*documents_schema()))
    kept = cleaned.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*documents_schema())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: that with the smallest doc_id, null last.

    Texts without words are like none but equal ones; of rows equal in doc_id and text one stays.
    Texts of any length count whole.
    """
    return neardup.drop_near_duplicates(docs.select(*documents_schema()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their target weights.

    Rows of one doc_id are taken alike, rows without one by their text; a null source is one of
    its own; texts without words follow the whole copies of their source.
    """
    drawn = mixing.mix_documents(docs.select(*documents_schema()))
    times = F.sequence(F.lit(1), F.col("copies"))
    return drawn.filter(F.col("copies") > 0).select(*documents_schema(), F.explode(times).alias("_copy")).select(*documents_schema())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all documents that are left.

    A null or empty text is its end token, a text longer than a sequence several pieces; repeated
    rows are packed one by one, and no rows give no pieces.
    """
    return packing.op1_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
