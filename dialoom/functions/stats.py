"""Paired statistics on aggregated counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided sign test of k successes out of n at 1/2."""
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1))
    return float(min(1.0, 2 * tail / 2**n))


def sign_test(wins: Column, losses: Column) -> Column:
    def run(w: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([binomial_two_sided(int(a), int(a + b)) for a, b in zip(w, x, strict=True)])

    return F.pandas_udf(run, "double")(wins, losses)


def mcnemar_exact(only_a: Column, only_b: Column) -> Column:
    """Exact McNemar test from the discordant counts."""
    return sign_test(only_a, only_b)


def _continued_beta(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued_beta(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued_beta(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def paired_t(deltas: DataFrame, group: list[str], delta: str) -> DataFrame:
    """t and its two-sided p by group; null where the spread is 0 or fewer than two rows exist."""

    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b - 1) if a == a and b > 1 else None for a, b in zip(t, n, strict=True)], dtype="float64")

    sums = deltas.groupBy(*group).agg(F.count(delta).alias("n"), F.avg(delta).alias("m"), F.stddev_samp(delta).alias("s"))
    t = sums.withColumn("t", F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")))
    return t.withColumn("p", F.pandas_udf(run, "double")("t", "n")).select(*group, "n", "t", "p")


def wilcoxon(deltas: DataFrame, group: list[str], delta: str) -> DataFrame:
    """Signed-rank statistic with mean ranks for ties and its normal approximation; zeros are dropped.

    Ranks come from counts of equal magnitudes, so rows of a group are never gathered.
    """
    from pyspark.sql import Window

    size = deltas.filter(F.col(delta) != 0).select(*group, F.abs(delta).alias("a"), (F.col(delta) > 0).cast("int").alias("up"))
    ties = size.groupBy(*group, "a").agg(F.count("*").alias("c"), F.sum("up").alias("ups"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*group).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("rank", before + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(*group).agg(
        F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("ups")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("ups"))).alias("w_minus"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("tie")
    )
    mean = F.col("n") * (F.col("n") + 1) / 4
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("tie") / 48
    return sums.select(*group, "n", F.least("w_plus", "w_minus").alias("w"), F.try_divide(F.least("w_plus", "w_minus") - mean, F.sqrt(var)).alias("z"))


def bootstrap_mean(deltas: DataFrame, group: str, delta: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean and 95 % percentile interval of the bootstrap by group.

    Resampling n rows is a multinomial draw over the distinct values, so each group sends its
    distinct values with counts, not its rows.
    """
    counted = deltas.groupBy(group, delta).agg(F.count("*").alias("c"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(delta)
        values, counts = part[delta].to_numpy(), part["c"].to_numpy()
        n = counts.sum()
        rng = np.random.default_rng(seed)
        means = np.concatenate([rng.multinomial(n, counts / n, 100) @ values / n for _ in range(-(-resamples // 100))])[:resamples]
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({group: [part[group].iloc[0]], "mean": [float(values @ counts / n)], "low": [float(low)], "high": [float(high)]})

    kind = dict(deltas.dtypes)[group]
    return counted.groupBy(group).applyInPandas(run, f"{group} {kind}, mean double, low double, high double")
