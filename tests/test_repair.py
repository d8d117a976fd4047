import pytest
from pyspark.sql import functions as F

from dialoom.operators import repair

CALL = '<tool_call>{"name": "t"}</tool_call>'


def plan(spark, turns, edges=("AB", "BC"), terminals=("C",)):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in edges])
    plans = repair.repair_plans(repair.marked_turns(messages), pairs, F.array(*map(F.lit, terminals)))
    return plans.first(), repair.relabelled(messages, plans).orderBy("turn").collect()


def a(move, rest=""):
    return ("assistant", f"[STATE: {move[0]} → {move[1]}] {rest}")


@pytest.mark.parametrize(
    "turns,move,reason",
    [
        ([a("AB"), a("BC")], "none", None),
        ([a("AB", CALL), a("BC"), a("CC")], "relabel", None),
        ([a("AB"), a("BC", CALL)], "append_closing_pair", None),
        ([a("AB"), a("BB", CALL), a("BC")], "none", None),
        ([a("AA"), a("BB", CALL), a("BC")], "insert_handoff_turn", None),
        ([a("AB", CALL), a("BC", CALL)], "append_closing_pair", None),
        ([a("AC")], "drop", "undeclared transition"),
        ([a("AB")], "drop", "end is not terminal"),
        ([a("AB", CALL), a("AC", CALL)], "drop", "queued moves at the end"),
        ([a("AB", CALL), ("tool", '{"error": 1}'), a("BC", CALL), a("CC"), a("CC")], "relabel", None),
    ],
)
def test_moves(spark, turns, move, reason):
    got, _ = plan(spark, turns)
    assert (got.move, got.reason) == (move, reason)


def test_relabelled_texts(spark):
    got, rows = plan(spark, [a("AB", CALL), ("user", "hm"), ("assistant", "so [STATE: B -> C] x"), a("CC", "end")])
    assert [r.content for r in rows] == [f"[STATE: A → A] {CALL}", "hm", "so [STATE: A -> B] x", "[STATE: B → C] end"]
    assert list(got.drift) == [2, 3]
