"""Sharding by weighted rendezvous hashing: every key ranks the shards and goes to the best one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.ranking import ranked_in_group


def _score(key: Column, shard: int, weight: float, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return F.struct((-F.lit(float(weight)) / F.ln(u)).alias("s"), F.lit(-shard).alias("i"))


def rendezvous(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """The shard (place in ``weights``) with the highest -w / ln(u), u a uniform draw of (key, shard).

    Draws depend on key and shard alone, so a new shard only takes rows to itself and a removed
    one only gives rows away; a shard's share follows its weight. Null keys share one shard.
    """
    return (-_best(key, weights, seed)["i"]).cast("int")


def _best(key: Column, weights: Sequence[float], seed: int) -> Column:
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_max(F.array(*[_score(key, i, w, seed) for i, w in enumerate(weights)]))


def grown(rows: DataFrame, key: str, weights: Sequence[float], added: float, shard: str = "shard", grown_shard: str = "grown_shard", seed: int = 17) -> DataFrame:
    """Add the shard of each row, and its shard once one more of weight ``added`` exists: the same or the new one.

    Columns that already bear these names are replaced.
    """
    kept = [c for c in rows.columns if c not in (shard, grown_shard)]
    scored = rows.select(*kept, _best(F.col(key), weights, seed).alias("_best"))
    after = F.greatest(F.col("_best"), _score(F.col(key), len(weights), added, seed))
    return scored.select(*kept, (-F.col("_best.i")).cast("int").alias(shard), (-after["i"]).cast("int").alias(grown_shard))


def shard_records(rows: DataFrame, key: str, weights: Sequence[float], salts: int = 1024, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add the shard of each record and its place in that shard, gapless from 0.

    Slots are dealt in arbitrary order; rows with a null key share a shard, and equal rows take a
    slot each. Columns that already bear the names ``shard`` and ``slot`` are replaced.
    """
    return ranked_in_group(rows.withColumn(shard, rendezvous(F.col(key), weights)).drop(slot), [shard], [key], salts, slot)


def op8_sharding(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Digest rows of all documents over equal shards under the ``key`` law.

    A null text has no bytes and the CRC of nothing (0). Rows that repeat a doc_id share its
    shard and take a slot each.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return ranked_in_group(grown(rows, "doc_id", [1.0] * shards, 1.0), ["shard"], ["doc_id"], 1024, "slot")
