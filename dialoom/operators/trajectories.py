"""Alignment of model turns with a gold walk, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def align(turns: Column, gold: Column, stall_limit: int, max_turns: int) -> Column:
    """Fold over turns (arrays of pairs): cursor, stalls, and the reason at which the walk stops.

    Self-loops are neutral. A turn whose other pairs are exactly the next gold ones advances the
    cursor, one without any stalls, and anything else diverges. Reasons come in this order:
    diverged, gold_complete, stall, script_exhausted, turn_cap; turns after a stop do not count.
    """
    n_turns = F.size(turns)
    start = F.struct(F.lit(0).alias("cursor"), F.lit(0).alias("stalls"), F.lit(0).alias("run"), F.lit(0).alias("seen"), F.lit("").alias("reason"))

    def step(s: Column, turn: Column) -> Column:
        moves = F.filter(turn, lambda p: p["src"] != p["dst"])
        n = F.size(moves)
        fits = moves == F.slice(gold, s["cursor"] + 1, n)
        stalled = n == 0
        ahead = ~stalled & fits
        cursor = s["cursor"] + F.when(ahead, n).otherwise(0)
        run = F.when(stalled, s["run"] + 1).otherwise(0)
        seen = s["seen"] + 1
        reason = (
            F.when(~stalled & ~fits, "diverged").when(cursor >= F.size(gold), "gold_complete").when(run >= stall_limit, "stall")
            .when(seen >= n_turns, "script_exhausted").when(seen >= max_turns, "turn_cap").otherwise("")
        )
        after = F.struct(cursor.alias("cursor"), (s["stalls"] + stalled.cast("int")).alias("stalls"), run.alias("run"), seen.alias("seen"), reason.alias("reason"))
        return F.when(s["reason"] != "", s).otherwise(after)

    return F.aggregate(turns, start, step)


def coverage(state: Column, gold: Column) -> Column:
    return F.when(F.size(gold) > 0, state["cursor"] / F.size(gold)).otherwise(0.0)


def legality(pairs: Column, allowed: Column) -> Column:
    """Share of pairs that are allowed or self-loops; none 1."""
    good = F.filter(pairs, lambda p: (p["src"] == p["dst"]) | F.array_contains(allowed, p))
    return F.when(F.size(pairs) == 0, 1.0).otherwise(F.size(good) / F.size(pairs))


def chain_score(needs: Column, gives: Column) -> Column:
    """Share of consecutive results that the next call's values take up; at most one call scores 1."""
    links = F.filter(F.sequence(F.lit(0), F.size(needs)), lambda i: i < F.size(needs) - 1)
    kept = F.filter(links, lambda i: F.arrays_overlap(F.get(gives, i), F.get(needs, i + 1)))
    return F.when(F.size(links) == 0, 1.0).otherwise(F.size(kept) / F.greatest(F.size(links), F.lit(1)))
