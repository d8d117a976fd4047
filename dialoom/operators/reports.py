"""Reports over scored conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import metrics


def state_report(scored: DataFrame, terminals: Column) -> DataFrame:
    """One row of six state metrics over conversations (pred, gold, trials, errors, recovered).

    ``pred`` and ``gold`` are arrays of (src, dst), ``trials`` an array of such arrays. Accuracy,
    sequence recall, completion and pass^k are means over conversations; the invalid and recovery
    rates divide sums by at least 1. No conversations give zeros.
    """
    p, g = F.col("pred"), F.col("gold")
    each = scored.select(
        metrics.transition_accuracy(p, g).alias("a"), metrics.sequence_recall(p, g).alias("s"), metrics.task_complete(p, terminals).cast("int").alias("c"),
        metrics.invalid_transitions(p, g).alias("i"), F.greatest(F.size(p), F.size(g)).alias("n"), "errors", "recovered", metrics.all_complete(F.col("trials"), terminals).cast("int").alias("k"),
    )
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    share = lambda part, whole: F.coalesce(F.sum(part) / F.greatest(F.sum(whole), F.lit(1)), F.lit(0.0))
    return each.agg(
        mean("a").alias("transition_accuracy"), mean("s").alias("sequence_recall"), mean("c").alias("completion"), share("i", "n").alias("invalid_rate"),
        share("recovered", "errors").alias("recovery_rate"), mean("k").alias("pass_all"),
    )
