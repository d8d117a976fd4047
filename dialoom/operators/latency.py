"""Latency, sweep and frontier reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_percentile(value: str | Column, share: float) -> Column:
    """The sorted value at place max(0, int(n * share) - 1), without interpolation."""
    return F.element_at(F.array_sort(F.collect_list(value)), F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(float(share))).cast("int")))


def floor_percentiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``floor_percentile`` for large groups: values are counted first, and ranks run over distinct values."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(w))
    place = lambda share: F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(share))))
    return ranked.groupBy(*group).agg(*[F.min(F.when(F.col("_upto") >= place(s), F.col(value))).alias(name) for name, s in shares.items()])


def rounded_percentile(value: str, share: float) -> Column:
    """The sorted value at place round(share * (n - 1)), halves to even."""
    return F.element_at(F.array_sort(F.collect_list(value)), F.bround(F.lit(float(share)) * (F.count("*") - 1), 0).cast("int") + 1)


def index_percentile(value: str, share: float) -> Column:
    """The sorted value at place int(share * n)."""
    return F.element_at(F.array_sort(F.collect_list(value)), F.floor(F.lit(float(share)) * F.count("*")).cast("int") + 1)


def stop_after_violations(levels: DataFrame, group: str) -> DataFrame:
    """Levels up to the second of two violations in a row; later ones were never run."""
    w = Window.partitionBy(group).orderBy("level")
    twice = F.when(F.col("violated") & F.lag("violated").over(w), F.col("level"))
    marked = levels.withColumn("_t", twice)
    cut = marked.withColumn("_cut", F.min("_t").over(Window.partitionBy(group)))
    return cut.filter(F.col("_cut").isNull() | (F.col("level") <= F.col("_cut"))).drop("_t", "_cut")


def highest_within(levels: DataFrame, group: str, factor: float) -> DataFrame:
    """The last level whose value is at most ``factor`` times that of the first level; 1 if there is none."""
    w = Window.partitionBy(group).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    based = levels.withColumn("_base", F.first("value").over(w))
    return based.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("value") <= F.col("_base") * factor, F.col("level"))), F.lit(1)).alias("best"))


def frontier(points: DataFrame, key: str, high: list[str], low: list[str]) -> DataFrame:
    """Points that no other point dominates; equal points all stay.

    Equal points collapse first, then each is tested against the points that are strictly better
    somewhere and worse nowhere. A local frontier of each partition thins the input, so the
    quadratic step sees survivors only.
    """
    names = [*high, *low]
    distinct = points.select(*names).distinct()
    a, b = distinct.alias("a"), distinct.alias("b")
    no_worse = F.lit(True)
    better = F.lit(False)
    for c in high:
        no_worse &= F.col(f"b.{c}") >= F.col(f"a.{c}")
        better |= F.col(f"b.{c}") > F.col(f"a.{c}")
    for c in low:
        no_worse &= F.col(f"b.{c}") <= F.col(f"a.{c}")
        better |= F.col(f"b.{c}") < F.col(f"a.{c}")
    best = a.join(b, no_worse & better, "left_anti")
    return points.join(best, names, "left_semi").select(key, *names)


def rising_while_held_out_falls(history: DataFrame, group: str, look_back: int) -> DataFrame:
    """Steps at which the reward is above that ``look_back - 1`` steps ago and the held-out score below the last one."""
    w = Window.partitionBy(group).orderBy("step")
    return history.withColumn("flag", F.coalesce((F.col("reward") > F.lag("reward", look_back - 1).over(w)) & (F.col("held_out") < F.lag("held_out", 1).over(w)), F.lit(False)))


def halt_leg(checks: DataFrame, group: str, least: int, share: float) -> DataFrame:
    """Rows up to the first at which at least ``least`` checks ran and more than ``share`` failed."""
    w = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ran = checks.withColumn("_n", F.count("*").over(w)).withColumn("_bad", F.count_if("failed").over(w))
    halted = F.when((F.col("_n") >= least) & (F.col("_bad") / F.col("_n") > share), F.col("pos"))
    cut = ran.withColumn("_h", halted).withColumn("_cut", F.min("_h").over(Window.partitionBy(group)))
    return cut.filter(F.col("_cut").isNull() | (F.col("pos") <= F.col("_cut"))).drop("_n", "_bad", "_h", "_cut")
