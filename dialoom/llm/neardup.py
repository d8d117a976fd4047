"""Near-duplicate detection: BagMinHash signatures of word-shingle multisets, bands, exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm import bloom
from dialoom.llm.components import connected_components
from dialoom.llm.storage import arrow_batches, drop_stored, release_shuffles, stored, stored_by
from dialoom.llm.workers import drop_kept, give_back, kept


class Settings(NamedTuple):
    shingle: int = 5  # words
    similarity: float = 0.8  # least weighted Jaccard of a link
    bands: int = 30
    rows: int = 5  # signature components a band
    seed: int = 11


KEY_MASK = np.uint64((1 << 60) - 1)
BLOCK_WORDS = 100_000
BLOOM_BITS = 1 << 24
PAIRS_AT_ONCE = 256
SPOKES = 512  # texts, about, that meet one copy of their hub's bag
TEXTS_AT_ONCE = 1024
REMEMBERED = 1 << 16  # words, or texts, that a worker remembers to save work
HOT, MOST_HOT = 4096, 1 << 17  # rows that make a token of a hub hot; hot tokens at most
SMALL = 16  # texts of a bucket up to which pairs are compared without further proof
AT_HAND = 1 << 20  # differences from a hub, of all its texts, up to which one task searches them
PAIRS_MET = 1 << 18  # candidates of such a search held at once
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) of hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Words(dict):
    """Hash of each word, remembered while there is room."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of characters between white space."""
    return text.lower().split() if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(kept("words", _Words).__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted hashes of the multiset of shingles; a shorter text is one shingle, no words are none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out = mix(out * _STEP + hashes[k : n - width + 1 + k])
    out.sort()
    return out


def text_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two 60-bit halves of the hash of a word sequence."""
    h = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return h & int(KEY_MASK), (h >> 64) & int(KEY_MASK)


def signatures(bags: list[np.ndarray], components: int, seed: int) -> np.ndarray:
    """BagMinHash signatures (Ertl, 2018) of multisets given as sorted hashes; an empty one is infinite.

    Each element is a Poisson process on weight times time. Weights are discretised to whole
    numbers and grouped in a binary hierarchy, [0,1) [1,2) [2,4) ...; the process of a group runs
    at a rate of its width and each of its points draws a component and a weight in the group,
    so points of a weight at or above the element's are rejected and two bags share the points
    below the smaller weight. The signature holds the least time of each component. Points are
    drawn only up to a time that almost surely covers all components; a bag with an uncovered
    component is drawn further.
    """
    out = np.full((len(bags), components), np.inf)
    element, count, owner = [], [], []
    for i, bag in enumerate(bags):
        if len(bag):
            first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
            element.append(bag[first])
            count.append(np.diff(np.append(first, len(bag))))
            owner.append(np.full(len(first), i))
    if not element:
        return out
    element, count, owner = np.concatenate(element), np.concatenate(count).astype(np.float64), np.concatenate(owner)
    totals = np.array([len(b) for b in bags], np.float64)
    limit = components / np.maximum(totals, 1) * (math.log(components) + 4)
    parts = [(element, owner, count, 0.0, 1.0)]
    low = 1.0
    while (heavy := count > low).any():
        parts.append((element[heavy], owner[heavy], count[heavy], low, low))
        low *= 2
    open_bags = np.ones(len(bags), bool)
    flat = out.reshape(-1)
    while True:
        for e, own, weight, start, width in parts:
            at = open_bags[own]
            e, own, weight = e[at], own[at], weight[at]
            state = mix(e ^ mix(np.full(1, np.uint64(seed * 1000 + int(start)))))
            time = np.zeros(len(e))
            while len(e):
                state = state + _STEP
                draw = mix(state)
                time = time - np.log(uniform(draw)) / width
                keep = time <= limit[own]
                state, time, own, weight, e, draw = state[keep], time[keep], own[keep], weight[keep], e[keep], draw[keep]
                second = mix(draw ^ _M1)
                component = (second >> np.uint64(32)) % np.uint64(components)
                level = start + np.floor((second & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width)
                hit = level < weight
                np.minimum.at(flat, own[hit] * components + component[hit].astype(np.int64), time[hit])
        open_bags = (totals > 0) & np.isinf(out).any(axis=1)
        if not open_bags.any():
            return out
        limit = limit * 2


def band_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit key a band of each signature; equal keys mean equal components of the same band."""
    bits = signature.view(np.uint64).reshape(len(signature), settings.bands, settings.rows)
    keys = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(settings.rows):
        keys = mix(keys * _STEP + bits[:, :, k])
    return keys.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted multisets."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = np.minimum(ca[i], cb[j]).sum()
    return float(common / (len(a) + len(b) - common)) if len(a) + len(b) else 0.0


def _sign(settings: Settings):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("text"), 0
            while at < len(batch):
                bags, keys, total, begin = [], [], 0, at
                while at < len(batch) and total < BLOCK_WORDS:
                    hashes = word_hashes(words_of(texts[at].as_py()))
                    keys.append(text_key(hashes))
                    bags.append(shingles(hashes, settings.shingle))
                    total += len(hashes) + 50
                    at += 1
                bands = band_keys(signatures(bags, settings.bands * settings.rows, settings.seed), settings)
                own = [None if not len(bag) else keys_ for bag, keys_ in zip(bags, bands, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(begin, at - begin) for c in ("_row", "doc_id", "_hash")], pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(own, pa.list_(pa.int64()))],
                    ["_row", "doc_id", "_hash", "_t0", "_t1", "_bands"],
                )
        give_back()

    return run


def _bags_of(settings: Settings, wanted):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            texts, at = batch.column("text"), 0
            while at < len(batch):
                hashes, total = [], 0
                while at < len(batch) and total < BLOCK_WORDS:
                    hashes.append(word_hashes(words_of(texts[at].as_py())))
                    total += len(hashes[-1]) + 50
                    at += 1
                keys = [text_key(h) for h in hashes]
                pairs = np.array(keys, np.int64)
                out = []
                for i in np.flatnonzero(bloom.hits(wanted.value, pairs[:, 0], pairs[:, 1])):
                    if keys[i] not in done:
                        if len(done) < REMEMBERED:
                            done.add(keys[i])
                        out.append((*keys[i], shingles(hashes[i], settings.shingle).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["_t0", "_t1", "_bag"]
                )
        give_back()

    return run


def levels(bag: np.ndarray) -> np.ndarray:
    """A sorted multiset as a set: its n-th copy of an element becomes (element, n)."""
    starts = np.concatenate([[True], bag[1:] != bag[:-1]])
    first = np.maximum.accumulate(np.where(starts, np.arange(len(bag)), 0))
    return np.unique(mix(bag ^ mix((np.arange(len(bag)) - first).astype(np.uint64) + np.uint64(1))))


def _compared(least: float):
    """Exact similarity of each pair, and for ``wide`` ones what sets the first text apart from the second.

    Rows come sorted by (b, _salt), the bag of b itself first (its ``a`` is null), then those of its partners.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        at, hub = None, np.empty(0, np.uint64)
        for batch in batches:
            ids, linked, missing, extra, size, tokens = [], [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("b", "_salt", "a", "wide")]
            for b, salt, a, wide, bag in zip(*columns, batch.column("_bag"), strict=True):
                own = levels(np.frombuffer(bag.as_py(), np.uint64))
                if a is None:
                    at, hub = (b, salt), own
                    continue
                if at != (b, salt):
                    raise RuntimeError(f"the bag of text {b} did not come before those of its partners")
                common = len(np.intersect1d(own, hub, assume_unique=True))
                ids.append((a, b))
                linked.append(bool(common >= least * (len(own) + len(hub) - common) - 1e-9))
                missing.append(len(hub) - common)
                extra.append(len(own) - common)
                size.append(len(hub))
                tokens.append(np.setxor1d(own, hub, assume_unique=True).view(np.int64) if wide else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array(linked, pa.bool_()), pa.array(missing, pa.int32()), pa.array(extra, pa.int32()), pa.array(size, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                ["a", "b", "linked", "missing", "extra", "size", "tokens"],
            )
        give_back()

    return run


def links_beyond_hub(linked: np.ndarray, missing: np.ndarray, extra: np.ndarray, size: int, tokens: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of places of texts of one hub that join all texts with a link, where the hub itself does not.

    Candidates are those of ``_wide_bucket_pairs``. Their exact similarity follows from what sets both
    texts apart from the hub; a pair that other links have joined already is left out.
    """
    if linked.all() or len(tokens) < 2:
        return []
    total, weight = missing + extra, missing + least * extra
    slack = weight - (1 - least) * size
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, token, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    free = np.bincount(token, weights=~linked[owner])
    common = (n > 1) & (free > 0)
    owner, token = owner[common[token]], token[common[token]]
    order = np.lexsort((token, n[token], owner))
    owner, token = owner[order], token[order]
    shared = np.bincount(owner, minlength=len(tokens))
    nth = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner] + 1
    place = (total - shared)[owner] + nth
    later = total[owner] - place
    early = lambda w: place <= (total - np.maximum(np.ceil(w / (1 + least) - 1e-9), 1) + 1)[owner]
    xs, ys = np.flatnonzero(early(slack) & ~linked[owner]), np.flatnonzero(early(weight))
    ys = ys[np.argsort(token[ys], kind="stable")]
    start = np.searchsorted(token[ys], token[xs])
    met = np.searchsorted(token[ys], token[xs], "right") - start
    parent = list(range(len(tokens) + 1))  # the last is the hub

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in np.flatnonzero(linked).tolist():
        parent[i] = len(tokens)
    out, at, ends = [], 0, np.cumsum(met)
    while at < len(xs):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_MET, "right")))
        width = met[at:end]
        i = np.repeat(xs[at:end], width)
        j = ys[np.repeat(start[at:end] - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        at, x, y = end, owner[i], owner[j]
        most = np.minimum(np.minimum(missing[x], missing[y]) + np.minimum(extra[x], extra[y]), 1 + np.minimum(later[i], later[j]))
        enough = (x != y) & (linked[y] | (x < y)) & ((1 + least) * most >= slack[x] + weight[y] - 1e-9)
        for code in np.unique(x[enough] * len(tokens) + y[enough]).tolist():
            x, y = divmod(code, len(tokens))
            if (a := root(x)) == (b := root(y)):
                continue
            both = len(np.intersect1d(tokens[x], tokens[y], assume_unique=True))
            if size - missing[x] - missing[y] + both >= least * (size + extra[x] + extra[y] - both) - 1e-9:
                parent[a] = b
                out.append((x, y))
    return out


def _searched(least: float):
    """Links (a, b) between texts of each hub; rows come sorted by the hub ``b``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        hub, rows = None, []

        def links() -> pa.RecordBatch:
            ids, linked, missing, extra, size, tokens = zip(*rows, strict=True) if rows else [()] * 6
            found = links_beyond_hub(np.array(linked, bool), np.array(missing, np.int64), np.array(extra, np.int64), size[0] if rows else 0, list(tokens), least)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("b", "a", "linked", "missing", "extra", "size")]
            for b, *row, tokens in zip(*columns, batch.column("tokens"), strict=True):
                if b != hub:
                    yield links()
                    hub = b
                rows.append((*row, tokens.values.to_numpy()))
        yield links()
        give_back()

    return run


def _verified(pairs: DataFrame, busy: DataFrame, bags: DataFrame, least: float, name: str) -> DataFrame:
    """a, b, linked, missing, extra, size, tokens of distinct pairs of text ids (a, b, wide).

    A text b of many pairs, such as a hub, has its bag copied once for about SPOKES of them. The places
    where a bag is wanted go to the bags, which are stored by their texts' keys, so that bags are sent
    once, from there to every such place, and meet there in sorted order.
    """
    copies = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("_copies")), "copies")
    partners = pairs.join(copies, "b").select(F.col("a").alias("_rep"), "b", F.pmod(F.xxhash64("a"), F.col("_copies")).cast("int").alias("_salt"), "a", "wide")
    own = copies.select(F.col("b").alias("_rep"), "b", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_salt"), F.lit(None).cast("long").alias("a"), F.lit(False).alias("wide"))
    places = stored(partners.union(own).join(busy, "_rep").select("_t0", "_t1", "b", "_salt", "a", "wide"), "places")
    sent = bags.join(places, ["_t0", "_t1"]).select("b", "_salt", "a", "wide", "_bag").repartition("b", "_salt")
    with arrow_batches(pairs.sparkSession, PAIRS_AT_ONCE):  # a row holds a whole bag
        met = sent.sortWithinPartitions("b", "_salt", F.col("a").asc_nulls_first())
        done = stored(met.mapInArrow(_compared(least), "a long, b long, linked boolean, missing int, extra int, size int, tokens array<long>"), name)
    drop_stored(places)
    drop_stored(copies)
    release_shuffles(pairs.sparkSession)
    return done


def near_duplicate_classes(documents: DataFrame, settings: Settings = Settings(), bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """doc_id, class_id, class_size, kept and _hash (of the text) of every row.

    Texts are multisets of ``shingle`` consecutive lower-cased words. Two texts are linked when
    they share a band and their exact weighted Jaccard is at least ``similarity``; classes are the
    connected components. Rows with one word sequence are one text; a text without words (null,
    empty) is linked to no other text. class_id is the smallest doc_id of the class (null if it
    has none) and one row of each class is kept: the smallest doc_id, null last, then any.

    Texts of a bucket are not compared all with all. Each is compared with the bucket's hub, the
    text that shares most buckets, and two texts linked to the hub need no more. In buckets of at
    most SMALL texts the other pairs are compared. In larger ones an unlinked text x and any y
    can be linked only if they share enough of what sets both apart from the hub: with m tokens
    of the hub missing, e extra ones and c shared ones of these, their similarity is
    (hub - mx - my + c) / (hub + ex + ey - c), and as x is not linked to the hub, c must reach
    (my + s ey) / (1 + s). So their first shared token, rarest first, lies early in both and
    enough tokens follow it; only such pairs are compared, and no link between texts of a bucket
    is missed.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.xxhash64("text").alias("_hash"), "text")
    with arrow_batches(documents.sparkSession, TEXTS_AT_ONCE):
        signed = stored(rows.mapInArrow(_sign(settings), "_row long, doc_id long, _hash long, _t0 long, _t1 long, _bands array<long>"), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))
    texts = stored(
        signed.groupBy("_t0", "_t1").agg(F.min("_row").alias("_rep"), F.first("_bands").alias("_bands"), F.min(order).alias("_first"), F.count("*").alias("_n")), "texts"
    )
    banded = texts.filter(F.col("_bands").isNotNull()).select("_rep", F.explode("_bands").alias("_key"))
    shared = banded.withColumn("_n", F.count("*").over(Window.partitionBy("_key"))).filter("_n > 1")  # keys are sent once
    members = stored(shared.select("_key", "_rep"), "members")
    with_bands, signed, texts = (signed, texts), stored(signed.drop("_bands"), "rows"), stored(texts.drop("_bands"), "named_texts")
    for spent in with_bands:  # most of their bytes are bands
        drop_stored(spent)
    release_shuffles(documents.sparkSession)
    classes = _classes(documents, texts, members, settings, bloom_bits)
    labels = stored(
        texts.join(classes, "_rep", "left").select("_t0", "_t1", F.coalesce("_class", "_rep").alias("_class"), "_first", "_n"), "labels"
    )
    drop_stored(texts)
    drop_stored(members)
    found = stored(labels.groupBy("_class").agg(F.min("_first").alias("_best"), F.sum("_n").alias("_size")), "classes")
    named = stored(labels.select("_t0", "_t1", "_class").join(found, "_class").select("_t0", "_t1", "_best", "_size"), "named")
    drop_stored(labels)
    drop_stored(found)
    release_shuffles(documents.sparkSession)
    return signed.select("_row", "doc_id", "_hash", "_t0", "_t1").join(named, ["_t0", "_t1"]).select(
        "doc_id", F.col("_best.d").alias("class_id"), F.col("_size").alias("class_size"), (F.col("_row") == F.col("_best.r")).alias("kept"), "_hash"
    )


def _classes(documents: DataFrame, texts: DataFrame, members: DataFrame, settings: Settings, bloom_bits: int) -> DataFrame:
    """_rep, _class of the texts that are linked to another one."""
    spark = documents.sparkSession
    busy = texts.join(members.select("_rep").distinct(), "_rep", "left_semi").select("_t0", "_t1", "_rep")
    busy = stored(busy, "busy")
    wanted = spark.sparkContext.broadcast(bloom.build(busy, F.col("_t0"), F.col("_t1"), bloom_bits))
    raw = documents.select("text").mapInArrow(_bags_of(settings, wanted), "_t0 long, _t1 long, _bag binary")
    with arrow_batches(spark, TEXTS_AT_ONCE):
        found = raw.join(busy, ["_t0", "_t1"]).groupBy("_t0", "_t1").agg(F.first("_bag").alias("_bag"))  # grouped and stored where the join left them
        bags = stored_by(found, "bags", ["_t0", "_t1"])
    release_shuffles(spark)

    sizes = stored(members.groupBy("_key").agg(F.count("*").alias("_n")), "sizes")
    ranks = stored(members.join(sizes, "_key").groupBy("_rep").agg(F.sum("_n").alias("_score")), "ranks")
    hubs = members.join(ranks, "_rep").groupBy("_key").agg(F.count("*").alias("_n"), F.max(F.struct("_score", (-F.col("_rep")).alias("_least"))).alias("_best"))
    hubs = stored(hubs.select("_key", "_n", (-F.col("_best._least")).alias("_hub")), "hubs")
    stars = stored(members.join(hubs, "_key"), "stars")
    for spent in (sizes, ranks, hubs):
        drop_stored(spent)
    spokes = stars.filter("_rep != _hub").groupBy(F.col("_rep").alias("a"), F.col("_hub").alias("b")).agg((F.max("_n") > SMALL).alias("wide"))
    checked = _verified(spokes, busy, bags, settings.similarity, "spokes")

    near, far = _by_load(checked)
    with arrow_batches(spark, TEXTS_AT_ONCE):
        beyond = stored(near.repartition("b").sortWithinPartitions("b").mapInArrow(_searched(settings.similarity), "a long, b long"), "beyond")
    others = _small_bucket_pairs(stars, checked)
    if far is not None:
        others = others.union(_wide_bucket_pairs(far, settings.similarity))
    others = others.distinct()
    tested = stored(checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tested")
    rest = others.join(tested, ["a", "b"], "left_anti").withColumn("wide", F.lit(False))
    more = _verified(rest, busy, bags, settings.similarity, "others")
    links = checked.filter("linked").select("a", "b").union(more.filter("linked").select("a", "b")).union(beyond)
    components = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    for spent in (bags, busy, stars, tested):
        drop_stored(spent)
    return components.select(F.col("node").alias("_rep"), F.col("component").alias("_class"))


def _by_load(checked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The wide rows of hubs whose differences one task can search, and those of the other hubs, None if there are none.

    Hubs to which every text is linked need no search.
    """
    wide = checked.filter(F.col("tokens").isNotNull())
    loads = wide.groupBy("b").agg(F.sum(F.size("tokens")).alias("_load"), F.count("*").alias("_texts"), F.bool_and("linked").alias("_done"))
    loads = stored(loads.filter("_texts > 1 AND NOT _done").select("b", "_load"), "loads")
    near = wide.join(loads.filter(F.col("_load") <= AT_HAND), "b", "left_semi")
    heavy = loads.filter(F.col("_load") > AT_HAND)
    return near, None if heavy.isEmpty() else wide.join(heavy, "b", "left_semi")


def _small_bucket_pairs(stars: DataFrame, checked: DataFrame) -> DataFrame:
    """Pairs (a < b) of buckets of at most SMALL texts that are not both linked to the hub."""
    small = stars.filter((F.col("_n") <= SMALL) & (F.col("_n") > 2) & (F.col("_rep") != F.col("_hub")))
    near = checked.filter("linked").select(F.col("a").alias("_rep"), F.col("b").alias("_hub"), F.lit(True).alias("_near"))
    marked = stored(small.join(near, ["_rep", "_hub"], "left").select("_key", "_rep", F.coalesce("_near", F.lit(False)).alias("_near")), "small")
    x = marked.filter("NOT _near").select("_key", F.col("_rep").alias("x"))
    y = marked.select("_key", F.col("_rep").alias("y"))
    return x.join(y, "_key").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _wide_bucket_pairs(checked: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) of one hub that share a rare enough difference from it to be linked; ``checked`` holds wide rows only.

    Only tokens of several texts, one of them not linked to the hub, can bring forth a pair; all
    others count as the rarest ones. Hot tokens, such as one that every text of a
    hub lacks, are counted by partial sums and sent to all tasks, so that their rows gather nowhere.
    """
    apart = checked.select(F.col("b").alias("hub"), F.col("a").alias("y"), "linked", "missing", "extra", "size", F.explode("tokens").alias("token"))
    apart = stored(apart, "apart")
    least_hot = max(HOT, -(-apart.count() // MOST_HOT))  # so many rows have at most MOST_HOT tokens as frequent
    free = F.count(F.when(~F.col("linked"), 1))
    times = apart.groupBy("hub", "token").agg(F.count("*").alias("hot_n"), free.alias("hot_free")).filter(F.col("hot_n") >= least_hot)
    hot = F.broadcast(stored(times, "hot"))
    spread = F.when(F.col("hot_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("y"), F.lit(1024)))
    marked = apart.join(hot, ["hub", "token"], "left").withColumn("spread", spread)
    same = Window.partitionBy("hub", "token", "spread")  # fewer than least_hot rows, or one of 1024 parts of a hot token
    counted = marked.withColumns({"n": F.coalesce("hot_n", F.count("*").over(same)), "free": F.coalesce("hot_free", free.over(same))})
    common = counted.filter("n > 1 AND free > 0").drop("hot_n", "hot_free", "spread", "free")
    total = F.col("missing") + F.col("extra")
    weight = F.col("missing") + least * F.col("extra")
    slack = weight - (1 - least) * F.col("size")  # above 0 for texts that are not linked to the hub
    need = lambda w: F.greatest(F.ceil(w / (1 + least) - 1e-9), F.lit(1))
    each = Window.partitionBy("hub", "y")
    nth = F.row_number().over(each.orderBy("n", "token"))
    ranked = common.withColumns({"shared": F.count("*").over(each), "nth": nth})
    place = total - F.col("shared") + F.col("nth")  # tokens that bring forth no pair are the rarest
    ranked = stored(
        ranked.select("hub", "token", "y", "linked", "missing", "extra", "size", place.alias("place"), (total - place).alias("later"), weight.alias("weight"), slack.alias("slack"), total.alias("total")), "ranked"
    )
    y = ranked.filter(F.col("place") <= F.col("total") - need(F.col("weight")) + 1).select("hub", "token", "y", F.col("missing").alias("my"), F.col("extra").alias("ey"), F.col("weight").alias("wy"), F.col("later").alias("ly"))
    x = ranked.filter(~F.col("linked") & (F.col("place") <= F.col("total") - need(F.col("slack")) + 1)).select(
        "hub", "token", F.col("y").alias("x"), F.col("missing").alias("mx"), F.col("extra").alias("ex"), F.col("slack").alias("sx"), F.col("later").alias("lx")
    )
    # At the first token that a pair shares, no more than one and what follows in either can be shared.
    most = F.least(F.least("mx", "my") + F.least("ex", "ey"), 1 + F.least("lx", "ly"))
    enough = (1 + least) * most >= F.col("sx") + F.col("wy") - 1e-9
    return x.join(y, ["hub", "token"]).filter((F.col("x") != F.col("y")) & enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def drop_near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` that ``near_duplicate_classes`` keeps, one a class, with all columns."""
    none, ident, text_hash = ("_" * max(map(len, ["", *documents.columns])) + c for c in ("none", "id", "hash"))  # names that no column has
    key = {none: F.col("doc_id").isNull(), ident: F.coalesce("doc_id", F.lit(0).cast("long"))}
    kept = near_duplicate_classes(documents, settings).filter("kept").withColumns(key).select(F.col("_hash").alias(text_hash), none, ident)
    kept = stored(kept, "kept").hint("merge")
    rows = documents.withColumns({text_hash: F.xxhash64("text"), **key})
    same = [text_hash, none, ident]  # never null, so that one exchange of the texts serves both steps
    return rows.join(kept, same, "left_semi").dropDuplicates(same).select(*documents.columns)


def op10_neardup(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept of every document."""
    return near_duplicate_classes(documents).drop("_hash")
