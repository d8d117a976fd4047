import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import ann
from dialoom.llm.storage import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, query, k=10):
    d = np.sqrt(((vectors - vectors[query]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if i != query][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_is_high(spark, sf):
    rows = table(spark, f"/root/testdata/{sf}", "embeddings")
    got = ann.op5_ann(rows).toPandas()
    local = rows.toPandas()
    ids, vectors = local.vec_id.to_numpy(), np.stack(local.embedding.to_numpy()).astype(np.float64)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        want = dict(brute(ids, vectors, q))
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(want) + 1))
        assert (own.sort_values(["score", "vec_id"]).vec_id == own.vec_id).all()
        place = {int(v): i for i, v in enumerate(ids)}
        for r in own.itertuples():
            assert r.score == pytest.approx(np.linalg.norm(vectors[place[r.vec_id]] - vectors[q]), rel=1e-12)
        hits += len(set(own.vec_id) & set(want))
        total += len(want)
    assert hits / total >= 0.9


def test_odd_vectors_take_no_part(spark):
    v = [float(x) for x in range(1, 5)]
    rows = [(0, v, 0), (1, v, 0), (2, [1.0, 2.0, 3.0, 9.0], 0), (3, None, 0), (4, [0.0] * 4, 0), (5, [1.0, None, 1.0, 1.0], 0), (6, [float("nan")] + v[1:], 0), (7, [float("inf")] + v[1:], 0), (8, [1.0], 0), (9, [], 0), (None, v, 0), (100, v, 0), (200, None, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit(1), "score": F.lit(2), "list": F.lit(3), "v": F.lit(4)})
    got = sorted(tuple(r) for r in ann.op5_ann(frame).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, 5.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 5.0)]


def test_many_equal_vectors_keep_the_smallest_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 1.0, 1.0, 1.0] if i % 3 else rng.normal(size=4).tolist(), 0) for i in range(600)]
    got = ann.op5_ann(spark.createDataFrame(rows, SCHEMA).repartition(5)).filter("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(600) if i % 3][:10]


def test_nothing(spark):
    assert ann.op5_ann(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.op5_ann(spark.createDataFrame([(1, [0.0], 0)], SCHEMA)).count() == 0
