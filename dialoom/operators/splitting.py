"""Seeded splits and samples whose order comes from md5 of (seed, key), never from row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: str | Column, seed: int) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string") if isinstance(key, str) else key))


def hash_split(rows: DataFrame, key: str, seed: int, train: float, validation: float) -> DataFrame:
    """Cut the seeded order of ``rows`` (one row a key) at floor(n * share); the last part takes the rest.

    A cut by exact rank needs one global order, so this suits tables of keys, not of payloads.
    """
    if not 0 < train + validation <= 1:
        raise ValueError("shares must lie in (0, 1]")
    ranked = rows.withColumn("_r", F.row_number().over(Window.orderBy(seeded_order(key, seed), key)))
    total = rows.agg(F.count("*").alias("_n"))
    head = F.floor(F.col("_n") * F.lit(float(train)))
    body = head + F.floor(F.col("_n") * F.lit(float(validation)))
    part = F.when(F.col("_r") <= head, "train").when(F.col("_r") <= body, "validation").otherwise("test")
    return ranked.crossJoin(F.broadcast(total)).select(*rows.columns, part.alias("split"))
