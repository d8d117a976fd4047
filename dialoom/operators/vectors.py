"""Vector quantisation, length packing, weighted draws and type choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lloyd_max(dimension: int, bits: int, grid: int = 20_001, rounds: int = 200) -> np.ndarray:
    """Lloyd-Max levels for a coordinate of a random unit vector: density (1 - x^2)^((d - 3) / 2) on [-1, 1]."""
    x = np.linspace(-1, 1, grid)
    weight = np.exp((dimension - 3) / 2 * np.log(np.maximum(1 - x * x, 1e-300)))
    mass, moment = (np.concatenate([[0.0], np.cumsum(w)]) for w in (weight, weight * x))
    levels = x[np.searchsorted(mass[1:] / mass[-1], (np.arange(2**bits) + 0.5) / 2**bits)]
    for _ in range(rounds):
        edges = np.concatenate([[0], np.searchsorted(x, (levels[1:] + levels[:-1]) / 2), [grid]])
        m = mass[edges[1:]] - mass[edges[:-1]]
        after = np.where(m > 0, (moment[edges[1:]] - moment[edges[:-1]]) / np.where(m > 0, m, 1), levels)
        if np.abs(after - levels).max() < 1e-12:
            break
        levels = after
    return levels


def unit(vector: Column) -> Column:
    """The vector over its length; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def encode(vector: Column, levels: np.ndarray) -> Column:
    """Place of the nearest level of each coordinate: the count of midpoints below it."""
    middles = F.array(*[F.lit(float(m)) for m in (levels[1:] + levels[:-1]) / 2])
    return F.transform(vector, lambda x: F.size(F.filter(middles, lambda m: m < x)))


def decode(codes: Column, levels: np.ndarray) -> Column:
    book = F.array(*[F.lit(float(x)) for x in levels])
    return F.transform(codes, lambda c: F.get(book, c))


def rotation(dimension: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix: QR of a Gaussian one with the signs of R's diagonal folded in."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def rotated(vector: Column, matrix: np.ndarray) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_numpy()).astype(np.float64) @ matrix.T)) if len(rows) else rows

    return F.pandas_udf(run, "array<double>")(vector)


def nuq_codebook(values: DataFrame, value: str, levels: int, rounds: int = 10, bins: int = 4096) -> DataFrame:
    """One-dimensional k-means levels from a histogram of ``bins`` cells, which is all that leaves the executors."""
    low, high = values.agg(F.min(value), F.max(value)).first()
    step = (high - low) / bins or 1.0
    cell = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1))
    cells = values.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.sum(value).alias("s")).orderBy("c").toPandas()
    x, n = (cells["s"] / cells["n"]).to_numpy(), cells["n"].to_numpy()
    centres = np.interp((np.arange(levels) + 0.5) / levels, np.cumsum(n) / n.sum(), x)
    for _ in range(rounds):
        own = np.searchsorted((centres[1:] + centres[:-1]) / 2, x)
        weight = np.bincount(own, n, levels)
        centres = np.where(weight > 0, np.bincount(own, n * x, levels) / np.maximum(weight, 1), centres)
    return values.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(centres)], "level int, centre double")


def ffd_runs(histogram: dict[int, int], capacity: int, separator: int) -> list[tuple[int, int, int, int]]:
    """First-fit decreasing on a histogram of lengths: (length, first item, items, first bin).

    Neighbouring bins with the same fill are one group, so the work depends on the capacity and
    not on the number of items. Items after the first in a bin also need a separator.
    """
    groups: list[list[int]] = []  # fill, first bin, bins
    runs, total = [], 0
    for length in sorted(histogram, reverse=True):
        left, done = histogram[length], 0
        after: list[list[int]] = []
        for fill, start, bins in groups:
            each = (capacity - fill) // (length + separator)
            full = min(bins, left // each) if each else 0
            for b in range(each if full else 0):
                runs.append((length, done + b * full, full, start))
            done += each * full
            left -= each * full
            if full:
                after.append([fill + each * (length + separator), start, full])
            rest = left if each and full < bins else 0
            if rest:
                runs += [(length, done + b, 1, start + full) for b in range(rest)]
                done += rest
                left = 0
                after.append([fill + rest * (length + separator), start + full, 1])
                full += 1
            if full < bins:
                after.append([fill, start + full, bins - full])
        each = (capacity + separator) // (length + separator)
        while left:
            full = left // each
            count, per = (full, each) if full else (1, left)
            for b in range(per):
                runs.append((length, done + b * count, count, total))
            done += per * count
            left -= per * count
            after.append([per * (length + separator) - separator, total, count])
            total += count
        groups = after
    return runs


def ffd_bins(items: DataFrame, length: str, key: str, capacity: int, separator: int) -> DataFrame:
    """Add ``bin`` to items; the plan is a broadcast table whose size depends on the capacity."""
    histogram = {int(r[0]): int(r[1]) for r in items.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if histogram and max(histogram) > capacity:
        raise ValueError("an item is longer than a bin")
    plan = items.sparkSession.createDataFrame(
        [(n, f, f + c, b - f) for n, f, c, b in ffd_runs(histogram, capacity, separator)], "_length int, _first long, _end long, _shift long"
    )
    ranked = items.withColumn("_r", F.row_number().over(Window.partitionBy(length).orderBy(key)).cast("long") - 1)
    fits = (F.col(length) == F.col("_length")) & (F.col("_r") >= F.col("_first")) & (F.col("_r") < F.col("_end"))
    return ranked.join(F.broadcast(plan), fits).select(*items.columns, (F.col("_r") + F.col("_shift")).alias("bin"))


def weighted_draw(key: Column, seed: int, weights: dict[str, float]) -> Column:
    """A seeded draw by cumulative weight."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    total, below, pick = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        below += weights[name]
        share = round(below / total, 12)
        pick = F.when(u < share, name) if pick is None else pick.when(u < share, name)
    return F.lit(names[0]) if pick is None else pick.otherwise(names[-1])


def canonical_kinds(paths: DataFrame) -> DataFrame:
    """Type a path is to be coerced to: only paths with mixed types or unlike objects are listed.

    Objects with more than four key sets, or several without a common key, become text; whole and
    broken numbers become float; numbers and text go by the majority; else the most frequent type.
    """
    keys = paths.filter("kind = 'dict'").groupBy("path").agg(F.collect_set("keys").alias("sets"))
    split = F.transform("sets", lambda s: F.split(s, ","))
    common = F.aggregate(split, F.get(split, 0), lambda a, b: F.array_intersect(a, b))
    text = keys.filter((F.size("sets") > 4) | ((F.size("sets") > 1) & (F.size(F.filter(common, lambda k: k != "")) == 0))).select("path", F.lit("str").alias("kind"))
    counts = paths.filter("kind != 'null'").groupBy("path", "kind").agg(F.count("*").alias("n"))
    by_path = counts.groupBy("path").agg(
        F.collect_set("kind").alias("kinds"), F.sum(F.when(F.col("kind").isin("int", "float"), F.col("n")).otherwise(0)).alias("numbers"),
        F.sum(F.when(F.col("kind") == "str", F.col("n")).otherwise(0)).alias("texts"), F.max_by("kind", F.struct("n", "kind")).alias("top"),
    ).filter(F.size("kinds") > 1)
    only = lambda *names: F.size(F.array_except("kinds", F.array(*map(F.lit, names)))) == 0
    choice = F.when(only("int", "float"), "float").when(only("int", "float", "str"), F.when(F.col("numbers") >= F.col("texts"), "float").otherwise("str")).otherwise(F.col("top"))
    mixed = by_path.join(text, "path", "left_anti").select("path", choice.alias("kind"))
    return text.union(mixed)


def outlier_channels(rows: DataFrame, column: str, threshold: float = 6.0, least: float = 1e-8) -> DataFrame:
    """pos, top, outlier of each channel: its largest magnitude exceeds ``threshold`` times the median of all channels' largest.

    None is an outlier if that median is below ``least``. Maxima are partial sums of the scan; what is left has one row a channel.
    """
    flat = rows.select(F.posexplode(column).alias("pos", "x"))
    tops = flat.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.max(F.abs(F.col("x").cast("double"))).alias("top"))
    middle = tops.agg(F.median("top").alias("middle"))  # one row
    return tops.crossJoin(F.broadcast(middle)).select("pos", "top", ((F.col("top") > threshold * F.col("middle")) & (F.col("middle") >= least)).alias("outlier"))
