"""Repair of state walks: calls stay where they are, the moves they claimed are queued for later prose turns.

A conversation is one fold over its marked assistant turns, so it needs no Python and no more
memory than the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import markers

STEP = "array<struct<turn:bigint,src:string,dst:string,action:string>>"
BRIDGE = "array<struct<turn:bigint,src:string,dst:string>>"


def marked_turns(messages: DataFrame) -> DataFrame:
    """One row a conversation: its marked assistant turns with ``call`` and ``failed`` (the message before is an error result)."""
    c = F.col("content")
    w = Window.partitionBy("conv_id").orderBy("turn")
    failed = (F.lag("role").over(w) == "tool") & F.lag(markers.is_error_result(c)).over(w)
    rows = messages.withColumn("failed", F.coalesce(failed, F.lit(False))).withColumn("t", F.get(markers.transitions(c), 0)).filter((F.col("role") == "assistant") & F.col("t").isNotNull())
    fields = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("t.src").alias("src"), F.col("t.dst").alias("dst"), (F.size(markers.call_blocks(c)) > 0).alias("call"), "failed")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(fields)).alias("turns"))


def _step(s: Column, x: Column) -> Column:
    moving = x["src"] != x["dst"]
    away = s["cur"] != x["src"]
    queued = F.size(s["queue"]) > 0
    head, tail = F.get(s["queue"], 0), F.slice(s["queue"], 2, F.greatest(F.size(s["queue"]), F.lit(1)))
    put = lambda queue, when: F.when(when, F.array_append(queue, x["dst"])).otherwise(queue)
    log = lambda a, b, what: F.array_append(s["steps"], F.struct(x["turn"].alias("turn"), a.alias("src"), b.alias("dst"), what.alias("action")))
    after = lambda cur, queue, steps, bridges, drift: F.struct(cur.alias("cur"), queue.alias("queue"), steps.alias("steps"), bridges.alias("bridges"), drift.alias("drift"))
    relabel, verbatim = F.lit("relabel"), F.lit("verbatim")

    waits = after(s["cur"], put(s["queue"], moving), log(s["cur"], s["cur"], relabel), s["bridges"], s["drift"])
    crossed = F.when(away, F.array_append(s["bridges"], F.struct(x["turn"].alias("turn"), s["cur"].alias("src"), x["src"].alias("dst")))).otherwise(s["bridges"])
    reached = F.when(away & queued & (head == x["src"]), tail).otherwise(s["queue"])
    stays = after(x["src"], put(reached, moving), log(x["src"], x["src"], F.when(moving, relabel).otherwise(verbatim)), crossed, s["drift"])
    drifts = F.when((head != x["dst"]) | away, F.array_append(s["drift"], x["turn"])).otherwise(s["drift"])
    pays = after(head, put(tail, moving & (x["dst"] != head)), log(s["cur"], head, relabel), s["bridges"], drifts)
    walks = after(x["dst"], s["queue"], log(s["cur"], x["dst"], verbatim), s["bridges"], s["drift"])
    return F.when(x["call"] & away & x["failed"], waits).when(x["call"], stays).when(queued, pays).otherwise(walks)


def repair_plans(turns: DataFrame, edges: Column, terminals: Column) -> DataFrame:
    """conv_id, move, reason, steps, bridges, drift of each conversation.

    move: none, relabel, insert_handoff_turn, append_closing_pair, or drop with its reason (more
    than one queued move at the end, an undeclared transition, or an end that is not terminal).
    """
    empty = lambda kind: F.array().cast(kind)
    start = F.struct(F.get("turns", 0)["src"].alias("cur"), empty("array<string>").alias("queue"), empty(STEP).alias("steps"), empty(BRIDGE).alias("bridges"), empty("array<bigint>").alias("drift"))
    done = turns.select("conv_id", F.aggregate("turns", start, _step).alias("s"))
    s = F.col("s")
    allowed = lambda a, b: (a == b) | F.array_contains(edges, F.struct(a.alias("src"), b.alias("dst")))
    legal = F.forall(s["steps"], lambda p: allowed(p["src"], p["dst"])) & F.forall(s["bridges"], lambda p: allowed(p["src"], p["dst"]))
    owed = F.get(s["queue"], 0)
    last = F.coalesce(owed, s["cur"])
    reason = (
        F.when(F.size(s["queue"]) > 1, "queued moves at the end").when(~legal, "undeclared transition")
        .when(owed.isNotNull() & ~allowed(s["cur"], owed), "undeclared transition").when(~F.array_contains(terminals, last), "end is not terminal")
    )
    changed = F.exists(s["steps"], lambda p: p["action"] == "relabel")
    move = (
        F.when(reason.isNotNull(), "drop").when(owed.isNotNull(), "append_closing_pair").when(F.size(s["bridges"]) > 0, "insert_handoff_turn")
        .when(changed, "relabel").otherwise("none")
    )
    return done.select("conv_id", move.alias("move"), reason.alias("reason"), "s.steps", "s.bridges", "s.drift")


def relabelled(messages: DataFrame, plans: DataFrame) -> DataFrame:
    """Messages of conversations that are not dropped, with the markers of the plan; the arrow glyph stays."""
    keep = plans.filter("move != 'drop'")
    steps = keep.select("conv_id", F.inline("steps")).filter("action = 'relabel'").select("conv_id", "turn", F.col("src").alias("_s"), F.col("dst").alias("_d"))
    rows = messages.join(keep.select("conv_id"), "conv_id", "left_semi").join(steps, ["conv_id", "turn"], "left")
    arrow = F.regexp_extract("content", r"\[STATE:\s*\w+\s*(→|->)", 1)
    mark = F.concat(F.lit("[STATE: "), "_s", F.lit(" "), arrow, F.lit(" "), "_d", F.lit("]"))
    at = F.regexp_instr(F.col("content"), F.lit(markers.MARKER))
    old = F.regexp_extract("content", markers.MARKER, 0)
    fixed = F.concat(F.substring(F.col("content"), F.lit(1), at - 1), mark, F.substring(F.col("content"), at + F.length(old), F.length("content")))
    return rows.withColumn("content", F.when(F.col("_s").isNotNull() & (at > 0), fixed).otherwise(F.col("content"))).drop("_s", "_d")


def moving_calls(messages: DataFrame) -> DataFrame:
    """Call turns that still claim a move: none may be left after a repair."""
    t = F.get(markers.transitions(F.col("content")), 0)
    return messages.filter((F.col("role") == "assistant") & (F.size(markers.call_blocks(F.col("content"))) > 0) & (t["src"] != t["dst"])).select("conv_id", "turn")
