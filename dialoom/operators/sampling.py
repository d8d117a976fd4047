"""Seeded samples, balances and splits; order comes from md5 of (seed, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators.splitting import seeded_order


def reserve_share(prints: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``max(1, round(n * share))`` of the distinct keys, the same whatever the row order."""
    if not 0 < share < 1:
        raise ValueError("share must lie in (0, 1)")
    keys = prints.select(key).distinct()
    n = keys.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(float(share)), 0).cast("int")).alias("_take"))
    ranked = keys.withColumn("_r", F.row_number().over(Window.orderBy(seeded_order(key, seed), key)))
    return ranked.join(F.broadcast(n), F.col("_r") <= F.col("_take")).select(key)


def balance_to_scarcest(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """As many rows of each label as the scarcest label has."""
    counts = rows.groupBy(label).count().agg(F.min("count").alias("_cap"))  # one row
    w = Window.partitionBy(label).orderBy(seeded_order(key, seed), key)
    return rows.withColumn("_r", F.row_number().over(w)).join(F.broadcast(counts), F.col("_r") <= F.col("_cap")).select(*rows.columns)


def downsample_to_ratio(rows: DataFrame, keep: Column, ratio: float, key: str, seed: int) -> DataFrame:
    """Thin the rows without ``keep`` so that kept rows make up ``ratio``; a ratio of 1 leaves these alone."""
    flagged = rows.withColumn("_keep", keep)
    allowed = flagged.agg(F.bround(F.count_if("_keep") * F.lit((1 - ratio) / ratio), 0).cast("int").alias("_cap"))
    w = Window.partitionBy("_keep").orderBy(seeded_order(key, seed), key)
    ranked = flagged.withColumn("_r", F.row_number().over(w)).crossJoin(F.broadcast(allowed))
    return ranked.filter(F.col("_keep") | (F.col("_r") <= F.col("_cap"))).select(*rows.columns)


def oversample_to_share(rows: DataFrame, wanted: Column, share: float, key: str, seed: int) -> DataFrame:
    """Draw wanted rows again, with replacement by seeded rank, until they make up ``share``."""
    flagged = rows.withColumn("_w", wanted)
    sizes = flagged.agg(F.count_if("_w").alias("_have"), F.count_if(~F.col("_w")).alias("_other"))
    need = F.greatest(F.bround(F.col("_other") * F.lit(share / (1 - share)), 0).cast("int") - F.col("_have"), F.lit(0))
    ranked = flagged.filter("_w").withColumn("_r", F.row_number().over(Window.orderBy(seeded_order(key, seed), key)))
    sized = ranked.crossJoin(F.broadcast(sizes)).withColumn("_need", need)
    times = F.floor(F.col("_need") / F.col("_have")) + F.when(F.col("_r") <= F.col("_need") % F.col("_have"), 1).otherwise(0)
    extra = sized.select(*rows.columns, F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("_x")).drop("_x")
    return rows.unionByName(extra)


def one_per_group(rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """A seeded pick of one row a group."""
    w = Window.partitionBy(group).orderBy(seeded_order(key, seed), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def split_defects(rows: DataFrame, group: str, held_out: list[str]) -> DataFrame:
    """Integrity of a recorded split: missing values, groups in several splits, held-out domains outside test."""
    missing = rows.filter(F.col("split").isNull()).select(F.lit("missing").alias("defect"), F.col(group).cast("string").alias("item"))
    spans = rows.groupBy(group).agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit("spans").alias("defect"), F.col(group).cast("string").alias("item"))
    leaked = rows.filter(F.col("domain").isin(*held_out) & (F.col("split") != "test")).select(F.lit("leaked").alias("defect"), F.col(group).cast("string").alias("item"))
    return missing.union(spans).union(leaked).distinct()


def keep_first(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each value of ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def rename_repeats(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Append _2, _3 ... to repeated ids by occurrence."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(key, F.when(n > 1, F.concat(F.col(key), F.lit("_"), n.cast("string"))).otherwise(F.col(key)))
