"""Cases on literal inputs."""

import pytest
from pyspark.sql import functions as F

from dialoom.functions import graphs, jsonvalue, markers, metrics, stats, texts
from dialoom.operators import latency, messages, sampling, trajectories, vectors
from dialoom.sources import jsonl

PAIRS = "array<struct<src:string,dst:string>>"


def one(spark, schema, row, **columns):
    return spark.createDataFrame([row], schema).select(*[c().alias(k) for k, c in columns.items()]).first().asDict()


@pytest.mark.parametrize(
    "pred,true,accuracy,invalid",
    [
        ([("A", "B")], [("A", "B")], 1.0, 0), ([("A", "B"), ("B", "X")], [("A", "B"), ("B", "C")], 0.5, 1), ([("A", "B")], [], 0.0, 0), ([], [], 1.0, 0),
        ([], [("A", "B")], 0.0, 0), ([("B", "C")], [("A", "B"), ("B", "C")], 0.0, 0),
    ],
)
def test_transition_accuracy(spark, pred, true, accuracy, invalid):
    got = one(spark, f"p {PAIRS}, t {PAIRS}", (pred, true), a=lambda: metrics.transition_accuracy(F.col("p"), F.col("t")), i=lambda: metrics.invalid_transitions(F.col("p"), F.col("t")))
    assert got == {"a": accuracy, "i": invalid}


def test_graded_and_partial(spark):
    row = ([("A", "X"), ("X", "C"), ("D", "C"), ("Q", "R")], [("A", "B"), ("B", "C"), ("C", "D"), ("E", "F")])
    got = one(spark, f"p {PAIRS}, t {PAIRS}", row, g=lambda: metrics.graded_state_match(F.col("p"), F.col("t")), q=lambda: metrics.partial_state_match(F.col("p"), F.col("t")))
    assert got["g"] == pytest.approx((0.5 + 0.5 + 0.3) / 4) and got["q"] == pytest.approx(0.5 / 4)


@pytest.mark.parametrize("pred,true,want", [([("A", "B"), ("B", "B"), ("B", "C")], [("A", "B"), ("B", "C")], 1.0), ([("A", "C")], [("A", "B"), ("B", "C")], 2 / 3), ([], [], 1.0), ([("A", "B")], [], 0.0), ([], [("A", "B")], 0.0)])
def test_sequence_recall(spark, pred, true, want):
    assert one(spark, f"p {PAIRS}, t {PAIRS}", (pred, true), s=lambda: metrics.sequence_recall(F.col("p"), F.col("t")))["s"] == pytest.approx(want)


def test_markers_of_both_arrows(spark):
    text = "[STATE: A → B] hi [STATE: B -> C_1]"
    assert [tuple(p) for p in one(spark, "c string", (text,), t=lambda: markers.transitions(F.col("c")))["t"]] == [("A", "B"), ("B", "C_1")]


def test_call_forms(spark):
    rows = ['<tool_call>\n{"a": {"b": 1}}\n</tool_call>x<tool_call>{}</tool_call>', '<|tool_call|>{"n": 1}', "none", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "c string").select(markers.call_blocks(F.col("c"))).collect()]
    assert got == [['{"a": {"b": 1}}', "{}"], ['{"n": 1}'], [], []]


@pytest.mark.parametrize(
    "a,b,same", [("1", "1.0", True), ("true", "1", True), ("true", "false", False), ('{"a":1,"b":[2]}', '{"b":[2.0],"a":1}', True), ('"1"', "1", False), ("[1,2]", "[2,1]", False), ("null", "null", True)],
)
def test_json_equality(a, b, same):
    assert (jsonvalue.canonical(jsonvalue.parsed(a)[1]) == jsonvalue.canonical(jsonvalue.parsed(b)[1])) == same


def test_strict_parser_refuses_a_tail():
    assert not jsonvalue.parsed('{"a": 1} trailing')[0]


def calls(spark, pred, true):
    frame = spark.createDataFrame([(pred, true)], "p array<string>, t array<string>")
    shaped = frame
    for c in ("p", "t"):
        one_call = shaped.select("*", F.posexplode_outer(c).alias("i", "x")).withColumn("x", F.when(F.col("x").isNotNull(), jsonvalue.tool_call(F.col("x"))))
        keep = [k for k in shaped.columns if k != c]
        shaped = one_call.groupBy(*keep).agg(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("i", "x")), lambda a, b: a["i"] - b["i"]), lambda z: z["x"].isNotNull()), lambda z: z["x"]).alias(c)) if keep == ["t"] else shaped.join(
            one_call.agg(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("i", "x")), lambda a, b: a["i"] - b["i"]), lambda z: z["x"].isNotNull()), lambda z: z["x"]).alias("_" + c))).drop(c).withColumnRenamed("_" + c, c)
    r = shaped.select(jsonvalue.ast_f1(F.col("p"), F.col("t")).alias("a"), jsonvalue.graded_f1(F.col("p"), F.col("t")).alias("g")).first()
    return r.a, r.g


@pytest.mark.parametrize(
    "pred,true,ast,graded",
    [
        (['{"name":"f","arguments":{"x":1,"y":2}}'], ['{"name":"f","arguments":{"x":1}}'], 1.0, 1.0), ([], [], 1.0, 1.0), ([], ['{"name":"f"}'], 0.0, 0.0),
        (['{"function":{"name":"f","arguments":{"x":1}}}'], ['{"name":"f","parameters":{"x":true}}'], 1.0, 1.0), (['{"name":"f","arguments":"{\\"x\\": 2}"}'], ['{"name":"f","arguments":{"x":1,"z":2}}'], 0.0, 0.4),
        (['{"name":"f","arguments":{"x":2}}', '{"name":"f","arguments":{"x":1}}'], ['{"name":"f","arguments":{"x":1}}'], 2 / 3, 2 / 3),
    ],
)
def test_call_f1(spark, pred, true, ast, graded):
    got = calls(spark, pred, true)
    assert got == (pytest.approx(ast), pytest.approx(graded))


def test_graph_validity(spark):
    schema = f"n array<string>, e {PAIRS}, i string, t array<string>"
    rows = [
        (["A", "B", "C"], [("A", "B"), ("B", "C")], "A", ["C"], True), (["A", "B"], [], "A", ["B"], False), ([], [], "A", ["B"], False), (["A"], [], "A", [], False),
        (["A", "B", "X"], [("A", "B"), ("X", "B")], "A", ["B"], True), (["A", "B", "X"], [("A", "B")], "A", ["B"], False), (["A", "B"], [("A", "B")], "Z", ["B"], False),
    ]
    for *row, want in rows:
        assert one(spark, schema, tuple(row), v=lambda: graphs.is_valid(F.col("n"), F.col("e"), F.col("i"), F.col("t")))["v"] is want


def test_edit_distance():
    assert graphs.edit_distance(["A", "B"], {("A", "B")}, ["A", "B"], {("A", "B")}, 1000) == 0
    assert graphs.edit_distance(["A", "B"], {("A", "B")}, ["A", "B"], set(), 1000) == 1
    assert graphs.edit_distance(["A", "B"], {("A", "B")}, ["A", "C"], {("A", "C")}, 1000) == 1
    assert graphs.edit_distance([], set(), ["A"], {("A", "A")}, 1000) == 2


@pytest.mark.parametrize("values,p50,p95", [([42.0], 42, 42), ([300.0, 100.0, 200.0], 100, 200), ([float(x) for x in range(100, 200)], 149, 194)])
def test_percentiles(spark, values, p50, p95):
    rows = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    want = {"g": 1, "p50": p50, "p95": p95}
    assert latency.floor_percentiles(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first().asDict() == want
    assert rows.groupBy("g").agg(latency.floor_percentile("v", 0.5).alias("p50"), latency.floor_percentile("v", 0.95).alias("p95")).first().asDict() == want


def test_recovery_ignores_user_turns(spark):
    rows = [(1, 0, "tool", '{"error": 1}'), (1, 1, "user", "go"), (1, 2, "assistant", "[STATE: A → B]"), (1, 3, "assistant", "[STATE: B → C]")]
    assert messages.recoveries(spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")).first().asDict() == {"conv_id": 1, "errors": 1, "recovered": 1}


@pytest.mark.parametrize(
    "turns,cursor,stalls,reason",
    [
        ([[("A", "B")], [("B", "C")]], 2, 0, "gold_complete"), ([[("A", "B"), ("B", "C")]], 2, 0, "gold_complete"), ([[("A", "A")], []], 0, 2, "stall"),
        ([[("A", "C")], [("A", "B")]], 0, 0, "diverged"), ([[("A", "B")]], 1, 0, "script_exhausted"), ([], 0, 0, ""),
    ],
)
def test_alignment(spark, turns, cursor, stalls, reason):
    got = one(spark, f"turns array<{PAIRS}>, gold {PAIRS}", (turns, [("A", "B"), ("B", "C")]), s=lambda: trajectories.align(F.col("turns"), F.col("gold"), 2, 9))["s"]
    assert (got.cursor, got.stalls, got.reason) == (cursor, stalls, reason)


def ffd(lengths, capacity, separator):
    bins, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        for b, fill in enumerate(bins):
            if fill + separator + lengths[i] <= capacity:
                bins[b], place[i] = fill + separator + lengths[i], b
                break
        else:
            place[i] = len(bins)
            bins.append(lengths[i])
    return place


def test_first_fit_decreasing(spark):
    import random

    for seed in range(40):
        r = random.Random(seed)
        lengths = [r.randint(1, 30) for _ in range(r.randint(1, 80))]
        histogram = {n: lengths.count(n) for n in lengths}
        got = {}
        for n, first, count, b in vectors.ffd_runs(histogram, 30, 1):
            got |= {(n, first + k): b + k for k in range(count)}
        seen, want = {}, ffd(lengths, 30, 1)
        # equal items are interchangeable: compare how many of each length every bin holds
        for i in sorted(want, key=lambda i: (-lengths[i], i)):
            seen.setdefault((lengths[i], want[i]), 0)
            seen[lengths[i], want[i]] += 1
        mine = {}
        for (n, _), b in got.items():
            mine[n, b] = mine.get((n, b), 0) + 1
        assert mine == seen


def test_statistics():
    assert stats.binomial_two_sided(0, 0) == 1 and stats.binomial_two_sided(1, 5) == pytest.approx(0.375)
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.beta_share(2, 3, 0.4) == pytest.approx(0.5248)


def test_lloyd_max_and_rotation():
    import numpy as np

    levels = vectors.lloyd_max(64, 2)
    assert np.allclose(levels, -levels[::-1], atol=1e-3) and np.all(np.diff(levels) > 0)
    turn = vectors.rotation(16, 1)
    assert np.allclose(turn @ turn.T, np.eye(16))


def test_corrupted_arguments(spark):
    frame = spark.createDataFrame([({"a": "x", "b": "y"},), ({"a": "7"},), ({"a": "x", "b": "x"},), ({},)], "m map<string,string>")
    assert [r[0] for r in frame.select(texts.corrupted(F.col("m"))).collect()] == [{"a": "y", "b": "x"}, {"a": "8"}, {"a": "x"}, None]


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("g"))
    for draw in (lambda r: sampling.balance_to_scarcest(r, "g", "id", 1), lambda r: sampling.downsample_to_ratio(r, F.col("g") == 0, 0.5, "id", 1), lambda r: sampling.one_per_group(r, "g", "id", 1)):
        assert sorted(map(tuple, draw(rows).collect())) == sorted(map(tuple, draw(rows.repartition(7)).collect()))


def test_strict_scan_names_the_line(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('﻿{"a": 1}\n\n{"a": 2\n')
    rows = jsonl.lines(spark, str(tmp_path))
    assert [(r.stem, r.line_no) for r in rows.orderBy("line_no").collect()] == [("b", 0), ("b", 2)]
    assert jsonl.dropping(rows, "a int").collect()[0].a == 1
    with pytest.raises(Exception, match="b:3"):
        jsonl.strict(rows, "a int").collect()


def test_guarded_sinks(spark, tmp_path):
    rows = spark.range(3)
    jsonl.write_jsonl(rows, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exists"):
        jsonl.write_jsonl(rows, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        jsonl.write_if_clean(rows, rows, str(tmp_path / "y"))
    assert not (tmp_path / "y").exists()
    with pytest.raises(ValueError):
        jsonl.contract(rows.limit(0), ["id"])
