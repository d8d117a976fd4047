"""Collects the queries of the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoom.plans import curation, dialogue, files, gates, repairs, rewards, scoring, structures, tables

MODULES = (curation, dialogue, files, gates, repairs, rewards, scoring, structures, tables)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curated_summary(spark, sf_dir)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
