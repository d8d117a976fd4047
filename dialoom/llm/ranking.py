"""Gapless ranks without one task a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.storage import stored


def ranked_in_group(rows: DataFrame, group: Sequence[str], order: Sequence[str], salts: int, out: str = "rank") -> DataFrame:
    """Number the rows of each group from 0 without gaps, in an arbitrary order between salts.

    A group is dealt over ``salts`` hash parts; each part is numbered alone and shifted by the
    rows of the parts before it. The salt is drawn with the row's place in its partition, so
    copies of one row spread too, and it is written down before it is used twice.
    """
    salted = stored(
        rows.withColumn("_salt", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(salts)).cast("int")), "salted"
    )
    parts = salted.groupBy(*group, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*group, "_salt").orderBy(*order)
    numbered = salted.withColumn("_r", F.row_number().over(within).cast("long") - 1)
    same = F.lit(True)
    for name in (*group, "_salt"):
        same &= F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    return (
        numbered.alias("a").join(shifts.alias("b"), same)
        .select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("_r") + F.col("_shift")).alias(out))
    )


def ordered_rank(rows: DataFrame, order: Sequence[Column], parts: int, out: str = "rank") -> DataFrame:
    """Number all rows from 0 in exactly this order: range partitions, each numbered alone and shifted."""
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    numbered = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1)
    return numbered.join(shifts, "_part").select(*rows.columns, (F.col("_r") + F.col("_shift")).alias(out))
