"""State reports and sane ground-truth calls on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from dialoom.functions import graphs, truth
from dialoom.operators import reports

PAIRS = "array<struct<src:string,dst:string>>"
SCORED = f"pred {PAIRS}, gold {PAIRS}, trials array<{PAIRS}>, errors long, recovered long"


def test_state_report(spark):
    gold = [("A", "B"), ("B", "Z")]
    rows = [(gold, gold, [gold, gold], 2, 1), ([("A", "C")], gold, [gold, [("A", "C")]], 1, 1), ([], [], [], 0, 0)]
    got = reports.state_report(spark.createDataFrame(rows, SCORED), F.array(F.lit("Z"))).first().asDict()
    assert got == pytest.approx({"transition_accuracy": 2 / 3, "sequence_recall": (1 + 1 / 3 + 1) / 3, "completion": 1 / 3, "invalid_rate": 1 / 4, "recovery_rate": 2 / 3, "pass_all": 1 / 3})
    empty = reports.state_report(spark.createDataFrame([], SCORED), F.array(F.lit("Z"))).first().asDict()
    assert set(empty.values()) == {0.0}


@pytest.mark.parametrize(
    "name,arguments,kept",
    [
        ("log", {"id": "TBD"}, False), ("log", {"id": "\t000 "}, False), ("log", {"id": "00"}, True), ("log", {"id": None}, True), ("log", {"region": "null"}, True),
        ("log", {"csat": -1}, False), ("log", {"NPS": 10.5}, False), ("log", {"rating": 10}, True), ("log", {"score": "11"}, True), ("log", {"score": False}, True),
        ("other", {"id": "none"}, True), ("log", None, True), ("log", {}, True), ("twice", {"id": "N/A"}, True), ("twice", {"x": "na"}, False),
    ],
)
def test_sane_calls(spark, name, arguments, kept):
    tool = lambda n, r: {"name": n, "parameters": {"required": r}}
    schemas = [{"function": tool("log", ["id"])}, tool("twice", ["id"]), tool("twice", ["x"]), {"type": "function"}]
    row = (json.dumps([{"name": name, "arguments": arguments}]), json.dumps(schemas))
    frame = spark.createDataFrame([row], "calls string, schemas string")
    assert frame.select(F.size(truth.sane_calls(F.col("calls"), F.col("schemas")))).first()[0] == kept


def test_odd_calls(spark):
    frame = spark.createDataFrame([(None, None), ("{bad", "{bad"), ("[]", "[]")], "calls string, schemas string")
    assert [r[0] for r in frame.select(F.size(truth.sane_calls(F.col("calls"), F.col("schemas")))).collect()] == [0, 0, 0]


@pytest.mark.parametrize(
    "nodes,edges,want",
    [
        ([("S1", "ASK"), ("S2", "END")], [("S1", "S2", 0)], []),
        ([("S1", "ASK"), ("S2", "ASK")], [("S1", "S2", 0)], ["duplicate_name"]),
        ([("S1", "Ask"), ("S2", "END")], [("S1", "S1", 1), ("S1", "S2", 1)], ["bad_name:Ask", "duplicate_priorities:S1", "self_loop:S1"]),
        ([("S1", "ASK"), ("S2", "END"), ("S3", "LOST")], [("S1", "S2", None)], ["invalid", "no_way_out:S3"]),
        ([("S1", "ASK"), ("S2", "END")], [("S1", "S2", 0), ("S1", "S9", 1)], ["unrenderable"]),
        ([("S 1", "ASK"), ("S2", "END")], [("S 1", "S2", 0)], ["invalid", "unrenderable"]),
        ([], [], ["invalid", "unrenderable"]),
    ],
)
def test_lint(spark, nodes, edges, want):
    row = spark.createDataFrame([(nodes, edges)], "n array<struct<id:string,name:string>>, e array<struct<src:string,dst:string,priority:int>>")
    assert row.select(graphs.lint(F.col("n"), F.col("e"), F.lit("S1"), F.array(F.lit("S2")))).first()[0] == want
