import math
import struct
import zlib
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from dialoom.llm import sharding
from tests.llm.helpers import ODD, documents, with_clashes


def test_op8_on_odd_rows(spark):
    rows = sharding.op8_sharding(with_clashes(documents(spark, ODD))).toPandas().set_index("doc_id")
    for i, text in enumerate(ODD):
        data = (text or "").encode()
        assert (rows["size"][i], rows.text_crc32[i], rows.law[i]) == (len(data) + 16, zlib.crc32(data), "key")


def spark_hash(*values):
    """XXH64 as Spark chains it over columns: longs are 8 bytes, ints 4, and a null changes nothing."""
    h = 42
    for value, kind in values:
        if value is not None:
            h = xxhash.xxh64_intdigest(struct.pack(kind, value), h)
    return h


def best_shard(key, shards):
    def score(i):
        u = ((spark_hash((key, "<q"), (i, "<i"), (17, "<i")) >> 11) + 0.5) / 2**53
        return -1.0 / math.log(u)

    return max(range(shards), key=lambda i: (score(i), -i))


def test_shards_and_slots_against_brute_force(spark):
    ids = [*range(-20, 300), 2**62, None, None, 5, 5]
    rows = sharding.op8_sharding(documents(spark, [f"t{i}" for i in ids], ids=ids)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
    for r in rows:
        assert (r.shard, r.grown_shard) == (best_shard(r.doc_id, 40), best_shard(r.doc_id, 41))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_clashing_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, "a", "b")], "doc_id long, shard string, slot string")
    assert [tuple(r) for r in sharding.shard_records(rows, "doc_id", [1.0] * 3).select("doc_id", "shard", "slot").collect()] == [(1, best_shard(1, 3), 0)]


def test_slots_growth_and_determinism(spark):
    docs = documents(spark, [f"t{i}" for i in range(3000)])
    rows = sharding.op8_sharding(docs).toPandas().set_index("doc_id")
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    moved = rows[rows.grown_shard != rows.shard]
    assert set(moved.grown_shard) == {40} and 0 < len(moved) < 3000 * 2 / 41
    again = sharding.op8_sharding(docs.repartition(5)).toPandas().set_index("doc_id")
    assert (again.shard.sort_index() == rows.shard.sort_index()).all()


def test_weights_rule_shares(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"))
    n = {r.s: r["count"] for r in keys.groupBy(sharding.rendezvous(F.col("doc_id"), [1.0, 3.0]).alias("s")).count().collect()}
    assert math.isclose(n[1] / n[0], 3, rel_tol=0.1)


def test_one_key_for_many_rows(spark):
    docs = documents(spark, ["same"] * 500 + [None] * 10, ids=[7] * 500 + [None] * 10)
    rows = sharding.op8_sharding(docs).toPandas()
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert rows[rows.doc_id == 7].shard.nunique() == 1
    assert sharding.op8_sharding(documents(spark, [])).count() == 0
