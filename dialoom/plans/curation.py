"""Corpus curation: split, dedupe, fingerprint and summary plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators.splitting import hash_split
from dialoom.sources import table


def split_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded 85/10/5 split of conversations."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return hash_split(ids, "conv_id", seed=42, train=0.85, validation=0.10)


def curated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and distinct texts by split and role after dropping blank messages."""
    turns = table(spark, sf_dir, "conversations").filter(F.trim("text") != "")
    parts = split_conversations(spark, sf_dir)
    return (
        turns.join(parts, "conv_id")
        .groupBy("split", "role")
        .agg(F.count("*").alias("n_messages"), F.countDistinct("text").alias("n_texts"))
    )


_SPLIT = """
  SELECT conv_id, CASE WHEN r <= floor(n * 0.85::DOUBLE) THEN 'train'
    WHEN r <= floor(n * 0.85::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT conv_id, row_number() OVER (ORDER BY md5('42|' || conv_id), conv_id) AS r, count(*) OVER () AS n
        FROM (SELECT DISTINCT conv_id FROM conversations))
"""

QUERIES = {"srt01_hash_split": split_conversations, "flagship_curated_summary": curated_summary}
ORACLE = {
    "srt01_hash_split": _SPLIT,
    "flagship_curated_summary": f"""
      SELECT split, role, count(*) AS n_messages, count(DISTINCT text) AS n_texts
      FROM conversations JOIN ({_SPLIT}) USING (conv_id) WHERE trim(text) <> '' GROUP BY split, role""",
}
