"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and an equi-join, so a hub costs its edges once a step; no
neighbour list is ever gathered. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.storage import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("dst", "src"))
    least = stored(both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")), "star")
    return both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = stored(down.groupBy("src").agg(F.min("dst").alias("low")), "star")
    moved = down.join(least, "src").filter("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(least.select("src", F.col("low").alias("dst"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of ``edges`` (src, dst); the component is its smallest node.

    Self loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    clean = edges.filter("src != dst").select("src", "dst").distinct()
    current = stored(clean, "edges")
    mark = _mark(current)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = stored(_small_star(_large_star(current)), "edges")
        drop_stored(current)
        current, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = current.select(F.col("dst").alias("node")).distinct()
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
