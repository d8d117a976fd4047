"""Bloom filters of a set size: a prefilter whose misses are certain, so results never depend on it."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 4


def build(keys: DataFrame, a: Column, b: Column, bits: int) -> np.ndarray:
    """Words of a filter over two non-negative long columns; at most bits / 32 rows reach the driver."""
    probes = F.array(*[F.pmod(a + F.lit(j) * b, F.lit(bits)) for j in range(PROBES)])
    words = (
        keys.select(F.explode(probes).alias("p")).select((F.col("p") / 32).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 32 AS int))").alias("m"))
        .groupBy("w").agg(F.bit_or("m").alias("m"))
    )
    table = np.zeros(bits // 32, dtype=np.int64)
    found = words.toPandas()
    table[found["w"].to_numpy()] = found["m"].to_numpy()
    return table


def hits(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the key pairs may be in the filter."""
    bits = len(table) * 32
    spots = [(a + j * b) % bits for j in range(PROBES)]
    return reduce(np.logical_and, [(table[p // 32] >> (p % 32)) & 1 == 1 for p in spots])
