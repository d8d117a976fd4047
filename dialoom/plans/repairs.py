"""Queries on the repair of state walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.operators import repair
from dialoom.plans.base import Plans, dialog

P = Plans()
STATES = ("S0", "S1", "S2", "S3")


def _plans(spark, d):
    every = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a in STATES for b in STATES])
    return repair.repair_plans(repair.marked_turns(dialog(spark, d)), every, F.array(*map(F.lit, STATES)))


@P.query("win12_repair_moves")
def _(spark, d):
    return _plans(spark, d).groupBy("move", "reason").agg(F.count("*").alias("n"))


@P.query("rpr01_relabelled")
def _(spark, d):
    return repair.relabelled(dialog(spark, d), _plans(spark, d)).select("conv_id", "turn", "role", "content")


@P.query("rpr02_repair_loop")
def _(spark, d):
    plans = _plans(spark, d)
    left = repair.moving_calls(repair.relabelled(dialog(spark, d), plans)).groupBy("conv_id").agg(F.count("*").alias("left"))
    return plans.join(left, "conv_id", "left").select("conv_id", "move", F.size("bridges").alias("bridges"), F.coalesce("left", F.lit(0)).alias("left"))


@P.query("val05_no_moving_calls", "SELECT 0::BIGINT AS n")
def _(spark, d):
    return repair.moving_calls(repair.relabelled(dialog(spark, d), _plans(spark, d))).agg(F.count("*").alias("n"))


QUERIES, ORACLE = P.queries, P.oracle
