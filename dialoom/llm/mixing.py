"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.ranking import ordered_rank
from dialoom.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
PARTS = 64  # hash parts of each size class of a source


def word_count(text: str = "text"):
    """Runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Add ``target`` to a table of sources (size, weight).

    ``share`` of all sizes is dealt by weight; a source stops at ``epochs`` times its size and
    what it cannot use is dealt again by weight until none is above. Each round is one pair of
    sums, and every round but the last clamps a source, so few rounds run.
    """
    sources = stored(sources, "sources")
    cap = F.col("size") * F.lit(float(epochs))
    total = share * (sources.agg(F.sum("size")).first()[0] or 0)
    level = 0.0
    while True:
        below = F.lit(False) if level == 0.0 else cap <= F.lit(level) * F.col("weight")
        used, left = sources.agg(
            F.coalesce(F.sum(F.when(below, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~below, F.col("weight"))), F.lit(0))
        ).first()
        if not left:
            break
        raised = (total - used) / left
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.when(cap <= F.lit(level) * F.col("weight"), cap).otherwise(F.lit(level) * F.col("weight")))


def weighted_sources(documents: DataFrame, weights: Sequence[int], partitions: int = 16) -> DataFrame:
    """(source, size, weight): word totals, with weights dealt in turn by code point order, null last."""
    totals = documents.groupBy("source").agg(F.sum("size").alias("size"))
    ranked = ordered_rank(totals, [F.col("source").asc_nulls_last()], partitions)
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    return ranked.select("source", "size", turn.alias("weight"))


def size_class():
    """Power of two of ``size``; -1 of nothing."""
    return F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(-1).cast("int")


def hash_part(seed: int):
    """One of PARTS parts, by MD5 of seed and ``_key``."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_key"))), 1, 6), 16, 10).cast("int"), F.lit(PARTS))


def draw_repeats(sized: DataFrame, sums: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Add source_size, target and ``copies`` to rows (_key, source, size, ...).

    A source with target t and size s gives each row floor(t/s) whole copies; the rest of t/s is
    a seeded sample. Rows are dealt by size class (power of two) and md5 of seed and doc_id into
    parts; the parts of a source are walked from large to small rows and a part is taken if that
    brings the taken words nearer to their share so far, so the sum misses its target by less
    than the last small parts hold. A walk sees at most 64 classes x PARTS sums, whatever the
    number of rows. Rows that repeat a doc_id are drawn together, rows without one by their
    ``_key``. Rows without words get the whole copies alone.
    """
    sized = sized.withColumn("_class", size_class()).withColumn("_part", hash_part(seed))
    walks = sums.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_class")).alias("k"), F.col("_part").alias("p"), "s"))).alias("walk")
    )
    joined = walks.alias("w").join(targets.alias("t"), F.col("w.source").eqNullSafe(F.col("t.source"))).select(
        "t.source", F.col("t.size").alias("source_size"), "target", "walk",
        F.when(F.col("t.size") > 0, F.floor(F.col("target") / F.col("t.size"))).otherwise(0).cast("int").alias("whole"),
    )
    joined = joined.withColumn("rest", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0))
    start = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("seen"), F.array().cast("array<boolean>").alias("picks"))

    def step(state, x):
        seen = state["seen"] + x["s"]
        pick = (x["s"] > 0) & (F.col("rest") * seen - state["taken"] >= x["s"] / F.lit(2.0))
        return F.struct((state["taken"] + F.when(pick, x["s"]).otherwise(0)).alias("taken"), seen.alias("seen"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    picks = F.aggregate("walk", start, step, lambda state: state["picks"])
    plan = joined.select("source", "source_size", "target", "whole", F.explode(F.arrays_zip("walk", picks.alias("pick"))).alias("z")).select(
        F.col("source").alias("_s"), "source_size", "target", (-F.col("z.walk.k")).alias("_k"), F.col("z.walk.p").alias("_p"),
        (F.col("whole") + F.when(F.col("z.pick"), 1).otherwise(0)).cast("int").alias("copies"),
    )
    plan = stored(plan, "mix")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_k")) & (F.col("_part") == F.col("_p"))
    return sized.join(plan, same).drop("_class", "_part", "_s", "_k", "_p")


def mix_documents(documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 3) -> DataFrame:
    """Every row with size, source_size, target and ``copies`` (0 and up): how often the mix takes it.

    No row is taken more than ``epochs`` times, rounded up. Sources without words have target 0 and their
    rows 0 copies; a null source is one of its own. Rows that repeat a doc_id are drawn
    together, rows without one by their text. Columns that bear the added names are replaced,
    all others pass.
    """
    kept = [c for c in documents.columns if c not in ("size", "source_size", "target", "copies")]
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("null"))
    sized = documents.select(*kept, word_count().alias("size"), key.alias("_key"))
    classes = sized.select("source", "size", size_class().alias("_class"), hash_part(seed).alias("_part"))
    sums = stored(classes.groupBy("source", "_class", "_part").agg(F.sum("size").alias("s")), "sums")
    targets = water_fill(weighted_sources(sums.select("source", F.col("s").alias("size")), weights), share, epochs)
    return draw_repeats(sized, sums, targets, seed).drop("_key")


def op3_mixing(documents: DataFrame) -> DataFrame:
    """Digest rows of the mix of all documents: doc_id, size, source_size, target, taken."""
    mixed = mix_documents(documents.select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
