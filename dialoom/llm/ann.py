"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.storage import stored

SAMPLE = 20_000  # vectors, about, that centroids and codebooks are fitted on
MAX_LISTS = 4096
PARTS = 16  # subspaces of the product quantiser
CODES = 256  # centroids of each
RERANKED = 200  # candidates a query keeps for the exact distances
BLOCK_VECTORS, BLOCK_PROBES = 16_384, 100_000  # vectors, and (query, list) rows, that meet in one task, about
TRIED, REACHED = 256, 0.95  # sampled queries that the share of lists is fitted on, and the share of their neighbours it must reach
AT_ONCE = 512  # queries ranked against all lists at a time
MAX_TASKS = 2048


class Index(NamedTuple):
    centroids: np.ndarray  # lists x dimension
    books: np.ndarray  # parts x codes x width


def k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from a seeded choice of distinct rows; an empty centre keeps its place."""
    points = points.astype(np.float32)
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(points, centres, 1)[:, 0]
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, own, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres).astype(np.float32)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` nearest centres of each point, nearest first."""
    d = (centres**2).sum(1)[None, :] - 2 * points.astype(np.float32) @ centres.T
    if n == 1:
        return d.argmin(1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _split(residuals: np.ndarray) -> np.ndarray:
    """Rows cut into PARTS equal subvectors, padded with zeros."""
    width = -(-residuals.shape[1] // PARTS)
    padded = np.zeros((len(residuals), PARTS * width), np.float32)
    padded[:, : residuals.shape[1]] = residuals
    return padded.reshape(len(residuals), PARTS, width)


def fit(sample: np.ndarray, lists: int, seed: int = 5) -> Index:
    centroids = k_means(sample, lists, 8, seed)
    rest = _split(sample - centroids[nearest(sample, centroids, 1)[:, 0]])
    books = np.zeros((PARTS, CODES, rest.shape[2]), np.float32)
    for p in range(PARTS):
        own = k_means(rest[:, p], CODES, 6, seed + p)
        books[p] = own[np.minimum(np.arange(CODES), len(own) - 1)]
    return Index(centroids, books)


def encode(vectors: np.ndarray, lists: np.ndarray, index: Index) -> np.ndarray:
    rest = _split(vectors - index.centroids[lists])
    return np.stack([nearest(rest[:, p], index.books[p], 1)[:, 0] for p in range(PARTS)], axis=1).astype(np.uint8)


def usable(embedding: str, dimension: int) -> Column:
    """Vectors of the dimension without null or non-finite components, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dimension) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float32)


def _coded(index, dimension: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("v"), dimension)
            own = nearest(x, index.value.centroids, 1)[:, 0]
            codes = encode(x, own, index.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "list", "codes"]
            )

    return run


def probe_count(sample: np.ndarray, index: Index, k: int, seed: int = 5) -> int:
    """Nearest lists that hold REACHED of the ``k`` nearest rows of TRIED rows of the sample, within the sample.

    Neighbours among all rows are nearer than those among the sample, so the count errs upwards.
    """
    chosen = np.random.default_rng(seed).permutation(len(sample))[:TRIED]
    own = nearest(sample, index.centroids, 1)[:, 0]
    order = nearest(sample[chosen], index.centroids, len(index.centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    found = nearest(sample[chosen], sample, min(k + 1, len(sample)))
    places = np.take_along_axis(place, own[found], axis=1)[found != chosen[:, None]]
    return int(np.quantile(places, REACHED, method="higher")) + 1 if len(places) else 1


def _probes(index, dimension: int, sizes: np.ndarray, probes: int, least: int):
    """Lists of each query: the ``probes`` nearest, and more while these hold fewer than ``least`` vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                near = nearest(_matrix(part.column("v"), dimension), index.value.centroids, len(sizes)).astype(np.int32)
                held = np.cumsum(sizes[near], axis=1)
                take = (np.arange(near.shape[1])[None, :] < probes) | (held - sizes[near] < least)
                rows, places = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(rows)), pa.array(near[rows, places])], ["query_id", "list"])

    return run


def _scan_block(index, kept: int):
    """Best ``kept`` vectors of a block of lists for each query, by asymmetric distance, then vec_id."""

    def run(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values(["list", "vec_id"], kind="stable")
        ids, lists = vectors["vec_id"].to_numpy(), vectors["list"].to_numpy()
        codes = np.frombuffer(b"".join(vectors["codes"]), np.uint8).reshape(-1, PARTS)
        bounds = {int(x): (int(lo), int(hi)) for x, lo, hi in zip(*_runs(lists), strict=True)}
        places = np.arange(PARTS)[None, :]
        out_query, out_vec, out_near = [], [], []
        for query, asked, v in zip(queries["query_id"], queries["lists"], queries["v"], strict=True):
            v = np.asarray(v, np.float32)
            near, found = [], []
            for own in asked:
                if int(own) in bounds:
                    lo, hi = bounds[int(own)]
                    rest = _split((v - index.value.centroids[int(own)])[None, :])[0]
                    table = ((rest[:, None, :] - index.value.books) ** 2).sum(2)
                    near.append(table[places, codes[lo:hi]].sum(1))
                    found.append(ids[lo:hi])
            if near:
                near, found = np.concatenate(near), np.concatenate(found)
                if len(near) > kept:
                    pick = np.flatnonzero(near <= np.partition(near, kept - 1)[kept - 1])
                    pick = pick[np.lexsort((found[pick], near[pick]))[:kept]]
                    near, found = near[pick], found[pick]
                out_query.append(np.full(len(near), query))
                out_vec.append(found)
                out_near.append(near)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.array([], kind)
        return pd.DataFrame({"query_id": join(out_query, np.int64), "vec_id": join(out_vec, np.int64), "near": join(out_near, np.float32)})

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, begin and end of each run of a sorted array."""
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.array([], int)
    return values[begins], begins, np.append(begins[1:], len(values)) if len(values) else begins


def build_index(vectors: DataFrame, dimension: int, k: int, seed: int = 5) -> tuple[Index | None, int]:
    """Centroids and codebooks from a sample of about SAMPLE rows chosen by a hash of vec_id, and the lists a query needs."""
    n = vectors.count()
    if not n:
        return None, 0
    share = min(1.0, SAMPLE / max(n, 1))
    chosen = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE)
    sample = np.array(chosen.select("v").toPandas()["v"].tolist(), np.float32).reshape(-1, dimension)
    if not len(sample):
        sample = np.array(vectors.select("v").limit(SAMPLE).toPandas()["v"].tolist(), np.float32)
    index = fit(sample, int(min(MAX_LISTS, max(1, n**0.5))))
    return index, probe_count(sample, index, k)


def nearest_neighbours(embeddings: DataFrame, is_query: Column, k: int = 10, probe_share: float | None = None, reranked: int = RERANKED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each query row but itself, by Euclidean distance.

    All rows are indexed. A query scans the nearest lists, at least 8 and as many as the sample
    shows to hold its neighbours (``probe_count``) or ``probe_share`` of all, by asymmetric distances, list by list in blocks of bounded size, and the best ``reranked`` candidates are
    measured exactly, in double precision, on the original vectors; ties go to the smaller vec_id.
    Vectors that are null, zero, of another than the most frequent dimension, without vec_id, or
    that hold null or non-finite components take no part. Of rows that repeat a vec_id the nearest
    counts. Other columns than vec_id, embedding and those of ``is_query`` are ignored.
    """
    sizes = embeddings.filter(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("d")).count()
    top = sizes.filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    spark = embeddings.sparkSession
    if top is None:
        return spark.createDataFrame([], schema)
    dimension = top["d"]
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable("embedding", dimension))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("q"))
    fitted, needed = build_index(vectors, dimension, k)
    if fitted is None:
        return spark.createDataFrame([], schema)
    index = spark.sparkContext.broadcast(fitted)
    lists = len(fitted.centroids)
    coded = stored(vectors.select("vec_id", "v").mapInArrow(_coded(index, dimension), "vec_id long, list int, codes binary"), "codes")
    held = np.zeros(lists, np.int64)
    for r in coded.groupBy("list").count().collect():  # at most MAX_LISTS rows
        held[r["list"]] = r["count"]
    queries = vectors.filter("q").select(F.col("vec_id").alias("query_id"), "v")
    probes = max(8, needed if probe_share is None else int(lists * probe_share))
    asked = stored(queries.mapInArrow(_probes(index, dimension, held, probes, 2 * reranked), "query_id long, list int"), "probes")
    asks = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    plan, at, room, rows_of = [], 0, BLOCK_VECTORS, {}
    for i in sorted(asks):  # neighbouring small lists share a block, a large one has several
        if not held[i]:
            continue
        if held[i] > room and room < BLOCK_VECTORS:
            at, room = at + 1, BLOCK_VECTORS
        parts = int(-(-held[i] // BLOCK_VECTORS))
        plan.append((i, at, parts))
        rows_of[at] = rows_of.get(at, 0) + asks[i]
        at, room = (at + parts, BLOCK_VECTORS) if parts > 1 else (at, room - int(held[i]))
    qblocks = int(-(-max(rows_of.values(), default=1) // BLOCK_PROBES))
    blocks = F.broadcast(spark.createDataFrame(plan, "list int, first int, parts int"))  # at most MAX_LISTS rows
    left = asked.join(blocks, "list").select(F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(qblocks)).cast("int").alias("qblock"), "list", "query_id")
    left = left.groupBy("block", "qblock", "query_id").agg(F.collect_list("list").alias("lists"))  # at most the lists of one block
    left = left.join(queries.groupBy("query_id").agg(F.first("v").alias("v")), "query_id")  # one vector a block
    right = coded.join(blocks, "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qblock"), "list", "vec_id", "codes")
    key = ["block", "qblock"]
    tasks = min(MAX_TASKS, max(1, len(rows_of) * qblocks))  # a set number, so that blocks are not dealt to few tasks by their bytes
    found = left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInPandas(_scan_block(index, reranked), "query_id long, vec_id long, near float")
    best = Window.partitionBy("query_id").orderBy("near", "vec_id")
    candidates = stored(found.filter("query_id != vec_id").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= reranked).select("query_id", "vec_id"), "candidates")
    with_query = candidates.join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
    pairs = with_query.join(vectors.select("vec_id", "v"), "vec_id")
    square = F.aggregate(F.zip_with("qv", "v", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "vec_id", F.sqrt(square).alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(embeddings: DataFrame) -> DataFrame:
    """The 10 nearest rows of every row whose vec_id is divisible by 100."""
    return nearest_neighbours(embeddings, F.col("vec_id") % 100 == 0)
