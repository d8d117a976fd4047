import re

import pytest
from pyspark.sql import functions as F

from dialoom.llm import mixing
from tests.llm.helpers import ODD, SCHEMA, documents, with_clashes


def fill(sizes, weights, total, epochs):
    """Brute force: clamp one round at a time."""
    clamped = {}
    while True:
        rest = total - sum(clamped.values())
        w = sum(weights[k] for k in sizes if k not in clamped)
        over = [k for k in sizes if k not in clamped and w and rest * weights[k] / w >= epochs * sizes[k]]
        if not over:
            return {k: clamped.get(k, rest * weights[k] / w if w else 0.0) for k in sizes}
        clamped |= {k: epochs * sizes[k] for k in over}


def make(spark, n=600):
    rows = []
    for i in range(n):
        source = None if i % 7 == 0 else f"s{min(i % 11, 6)}"
        rows.append((i, ("w " * (1 + i * i % 37 + (400 if i % 97 == 0 else 0))).strip(), "en", source, 0))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_targets_and_draws(spark):
    rows, docs = make(spark)
    got = mixing.op3_mixing(docs).toPandas().set_index("doc_id")
    sizes = {}
    for i, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for source in order:
        own = [i for i, _, _, s, _ in rows if s == source]
        part = got.loc[own]
        assert set(part.source_size) == {sizes[source]}
        assert part.target.iloc[0] == pytest.approx(want[source])
        assert abs(part.taken.sum() - want[source]) <= 0.01 * sizes[source] + 2
    assert (got.taken <= 2 * got["size"]).all()
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_wordless_rows_stay_within_the_epochs(spark):
    texts = ["a b c", "d e", "", None, " ", *["x y z " * 50] * 4]
    sources = ["s0"] * 5 + ["s1"] * 4
    rows = [(i, t, "en", s, 0) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    got = {r.doc_id: r for r in mixing.mix_documents(spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit("x"))).collect()}
    assert got[0].target == 2 * got[0].source_size and got[0].copies == 2
    assert all(0 <= r.copies <= 2 for r in got.values())


def test_reruns_and_partitions_agree(spark):
    _, docs = make(spark)
    a = {tuple(r) for r in mixing.op3_mixing(docs).collect()}
    assert a == {tuple(r) for r in mixing.op3_mixing(docs.repartition(7)).collect()}


def test_sizes_of_odd_rows(spark):
    got = {r.doc_id: r["size"] for r in mixing.op3_mixing(with_clashes(documents(spark, ODD))).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(ODD)}


def test_no_words_and_no_rows(spark):
    rows = mixing.op3_mixing(documents(spark, [None, "", " "])).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3
    assert mixing.op3_mixing(documents(spark, [])).count() == 0
