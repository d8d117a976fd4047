"""Scores of predicted against true transitions, tool names and sequences, as column expressions."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _both_empty(pred: Column, true: Column, score: Column) -> Column:
    """1 if both are empty, 0 if only the truth is, else the score."""
    return F.when(F.size(true) == 0, F.when(F.size(pred) == 0, 1.0).otherwise(0.0)).otherwise(score)


def _per_truth(pred: Column, true: Column, points) -> Column:
    """Mean of points(pair, truth) over truth positions; a missing prediction gets 0."""
    got = F.transform(true, lambda t, i: F.coalesce(points(F.get(pred, i), t), F.lit(0.0)))
    return F.aggregate(got, F.lit(0.0), lambda a, x: a + x) / F.size(true)


def transition_accuracy(pred: Column, true: Column) -> Column:
    """Share of true positions that are predicted exactly."""
    return _both_empty(pred, true, _per_truth(pred, true, lambda p, t: F.when(p == t, 1.0)))


def invalid_transitions(pred: Column, true: Column) -> Column:
    """Predicted pairs that are neither right in place nor among the true pairs; none if the truth is empty."""
    wrong = F.filter(pred, lambda p, i: ~F.coalesce(p == F.get(true, i), F.lit(False)) & ~F.array_contains(true, p))
    return F.when(F.size(true) == 0, 0).otherwise(F.size(wrong))


def partial_state_match(pred: Column, true: Column) -> Column:
    """1 for an exact pair, 0.5 for the right source."""
    return _both_empty(pred, true, _per_truth(pred, true, lambda p, t: F.when(p == t, 1.0).when(p["src"] == t["src"], 0.5)))


def graded_state_match(pred: Column, true: Column) -> Column:
    """1 exact, 0.5 one end right, 0.3 reversed."""
    def points(p: Column, t: Column) -> Column:
        return F.when(p == t, 1.0).when((p["src"] == t["src"]) | (p["dst"] == t["dst"]), 0.5).when((p["src"] == t["dst"]) & (p["dst"] == t["src"]), 0.3)

    return _both_empty(pred, true, _per_truth(pred, true, points))


def state_sequence(pairs: Column) -> Column:
    """First source and all targets, with equal neighbours collapsed."""
    walk = F.concat(F.slice(F.transform(pairs, lambda p: p["src"]), 1, 1), F.transform(pairs, lambda p: p["dst"]))
    return F.filter(walk, lambda s, i: (i == 0) | (s != F.get(walk, i - 1)))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two short arrays: one row of the table at a time."""
    start = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            value = F.when(F.get(b, j) == x, F.get(before, j) + 1).otherwise(F.greatest(F.get(done, j), F.get(before, j + 1)))
            return F.concat(done, F.array(value))

        places = F.filter(F.sequence(F.lit(0), F.size(b)), lambda j: j < F.size(b))
        return F.aggregate(places, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(a, start, row), -1)


def sequence_recall(pred: Column, true: Column) -> Column:
    """LCS of the collapsed state sequences over the length of the true one."""
    p, t = state_sequence(pred), state_sequence(true)
    return F.when(F.size(t) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).otherwise(lcs_length(p, t) / F.size(t))


def task_complete(pred: Column, terminals: Column) -> Column:
    """Whether the last target is terminal."""
    return F.when(F.size(pred) == 0, False).otherwise(F.array_contains(terminals, F.element_at(pred, -1)["dst"]))


def all_complete(trials: Column, terminals: Column) -> Column:
    """Whether there are trials and the last target of each is terminal."""
    return (F.size(trials) > 0) & F.forall(trials, lambda t: task_complete(t, terminals))


def name_accuracy(pred: Column, true: Column) -> Column:
    """Share of positions, over the longer list, with equal tool names; both empty 1."""
    longer = F.greatest(F.size(pred), F.size(true))
    right = F.size(F.filter(F.arrays_zip(pred.alias("p"), true.alias("t")), lambda z: z["p"] == z["t"]))
    return F.when(longer == 0, 1.0).otherwise(right / longer)


def set_f1(pred: Column, true: Column) -> Column:
    """F1 of two sets; both empty 1, one empty 0."""
    p, t = F.array_distinct(pred), F.array_distinct(true)
    common = F.size(F.array_intersect(p, t))
    return F.when((F.size(p) == 0) & (F.size(t) == 0), 1.0).otherwise(2 * common / F.greatest(F.size(p) + F.size(t), F.lit(1)))


def bag_f1(pred: Column, true: Column) -> Column:
    """F1 of two bags of words: a word counts up to the smaller of both counts; 0 if either is empty, null if either is null."""

    @F.arrow_udf("long")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else sum((Counter(x.split(" ")) & Counter(y.split(" "))).values()) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    shared = common(F.array_join(pred, " "), F.array_join(true, " "))
    return F.when((F.size(pred) == 0) | (F.size(true) == 0), 0.0).otherwise(2 * shared / (F.size(pred) + F.size(true)))


def tokens(text: Column) -> Column:
    """Lower-cased words."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def weighted_score(state: Column, tool: Column, done: Column, sequence: Column | None = None) -> Column:
    """0.4 state + 0.4 tool + 0.2 completion; with ``sequence`` the better state score counts."""
    best = state if sequence is None else F.greatest(state, sequence)
    return F.lit(0.4) * best + F.lit(0.4) * tool + F.lit(0.2) * done


def product_success(done: Column, tool: Column, chain: Column, chains: Column) -> Column:
    """Completion times tool F1 capped at 0.8 times chain accuracy capped at 0.7 (1 without chains)."""
    tool_part = F.when(tool > 0, F.least(tool / 0.8, F.lit(1.0))).otherwise(0.0)
    chain_part = F.when(chains > 0, F.least(chain / 0.7, F.lit(1.0))).otherwise(1.0)
    return done * tool_part * chain_part


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; 1 where fewer than k fail."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n - c < k, 1.0).otherwise(1.0 - miss)


def renormalised(terms: list[tuple[float, Column, Column]]) -> Column:
    """Weighted mean over the (weight, applies, value) terms that apply; 0 if none does."""
    num = den = F.lit(0.0)
    for weight, applies, value in terms:
        num += F.when(applies, F.lit(weight) * value).otherwise(0.0)
        den += F.when(applies, F.lit(weight)).otherwise(0.0)
    return F.when(den > 0, num / den).otherwise(0.0)
