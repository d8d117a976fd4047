"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.storage import BATCH_BYTES, BATCH_BYTES_NAME, BATCH_ROWS_NAME
from dialoom.llm.workers import drop_kept, give_back

UNKNOWN = "und"
SAMPLE_ROWS = 64  # labelled rows a language is learned from
SAMPLE_CHARS = 512  # characters taken of each, from a place that its id decides
SALTS = 64  # parts of a language's rows when the sample is drawn
LANE = 256  # bytes parsed in a row; the lanes of a text are parsed at once, then joined
BLOCK = 1 << 22  # bytes a worker parses at a time
ROWS_AT_ONCE = 2048


class Automaton(NamedTuple):
    """Dense suffix automaton: ``steps[state * symbols + symbol]`` is the next state, 0 if there is none."""

    lang: str
    steps: np.ndarray
    bits: float  # log2 of the length of the text


class Models(NamedTuple):
    classes: np.ndarray  # byte: symbol
    symbols: int
    automata: list[Automaton]


def folded(text: str) -> bytes:
    return text.lower().encode()


def _classes(samples: Iterable[bytes]) -> tuple[np.ndarray, int]:
    """Symbol of each byte: every letter byte seen has its own, all other ASCII is one, the rest is 0."""
    seen = set(b"".join(samples))
    table = np.zeros(256, np.int32)
    table[:128] = 1
    own = sorted(b for b in seen if b >= 128 or chr(b).isalpha())
    for k, b in enumerate(own, 2):
        table[b] = k
    return table, len(own) + 2


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Online construction (Blumer et al., 1985), returned as a dense table."""
    links, lengths, edges = [-1], [0], [{}]
    last = 0
    for c in symbols:
        new = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = links[p]
        if p >= 0:
            q = edges[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                copy = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                edges.append(dict(edges[q]))
                links[q] = links[new] = copy
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = links[p]
        last = new
    table = np.zeros(len(links) * width, np.int32)
    for state, own in enumerate(edges):
        for c, to in own.items():
            table[state * width + c] = to
    return table


def train(samples: dict[str, list[str]]) -> Models:
    """One automaton a language over its sample texts."""
    texts = {lang: b" ".join(folded(x) for x in parts) for lang, parts in samples.items()}
    classes, symbols = _classes(texts.values())
    return Models(classes, symbols, [
        Automaton(lang, suffix_automaton(classes[np.frombuffer(data, np.uint8)].tolist(), symbols), math.log2(len(data) + 2))
        for lang, data in sorted(texts.items())
    ])


def phrase_counts(texts: list[bytes], models: Models) -> np.ndarray:
    """Phrases (rows: texts, columns: languages) of the greedy parse: each is the longest match in the
    automaton, and a byte that matches nothing is one.

    Texts are cut into lanes that are parsed side by side as if a phrase began at each; then the
    parse of the lane before is carried into each lane until both reach one state, and the
    phrases up to there are counted anew. So the counts are those of one parse of the whole text.
    """
    data = models.classes[np.frombuffer(b"".join(texts), np.uint8)]
    sizes = np.array([len(x) for x in texts])
    lanes = -(-sizes // LANE)
    owner = np.repeat(np.arange(len(texts)), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begins = np.repeat(np.cumsum(sizes) - sizes, lanes) + nth * LANE
    lengths = np.minimum(LANE, np.repeat(sizes, lanes) - nth * LANE)
    order = np.argsort(-lengths, kind="stable")
    sorted_begins, sorted_lengths = begins[order], lengths[order]
    states = [np.zeros(len(owner), np.int32) for _ in models.automata]
    counts = [np.zeros(len(owner), np.int32) for _ in models.automata]
    for t in range(int(sorted_lengths[0]) if len(owner) else 0):
        live = int(np.searchsorted(-sorted_lengths, -t, side="left"))  # lanes longer than t
        symbol = data[sorted_begins[:live] + t]
        for k, model in enumerate(models.automata):
            states[k][:live], fresh = _step(model.steps, models.symbols, states[k][:live], symbol)
            counts[k][:live] += fresh
    out = np.zeros((len(texts), len(models.automata)))
    for k, model in enumerate(models.automata):
        ends, total = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int64)
        ends[order], total[order] = states[k], counts[k]
        total += _carried(model.steps, models.symbols, data, begins, lengths, np.flatnonzero(nth > 0), ends)
        out[:, k] = np.bincount(owner, weights=total, minlength=len(texts))
    return out


def _step(steps: np.ndarray, symbols: int, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next states, and where a phrase begins with this symbol."""
    after = steps[state * symbols + symbol]
    miss = after == 0
    return np.where(miss, steps[symbol], after), miss | (state == 0)


def _carried(steps, symbols, data, begins, lengths, later: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the parse of the lane before adds to the phrases of each of the ``later`` lanes."""
    added = np.zeros(len(begins), np.int64)
    ends = ends.copy()
    while len(later):
        lane, own, fresh = later, ends[later - 1], np.zeros(len(later), np.int32)
        change = np.zeros(len(later), np.int64)
        place, changed = np.arange(len(later)), []
        for t in range(LANE):
            live = lengths[lane] > t
            if not live.all():  # the lane ends before both parses meet
                changed.append((lane[~live], own[~live]))
                lane, own, fresh, place = lane[live], own[live], fresh[live], place[live]
            if not len(lane):
                break
            symbol = data[begins[lane] + t]
            own, a = _step(steps, symbols, own, symbol)
            fresh, b = _step(steps, symbols, fresh, symbol)
            change[place] += a.astype(np.int64) - b
            apart = own != fresh
            lane, own, fresh, place = lane[apart], own[apart], fresh[apart], place[apart]
        else:
            changed.append((lane, own))
        added[later] = change
        moved = []
        for at, state in changed:
            differs = ends[at] != state
            ends[at[differs]] = state[differs]
            moved.append(at[differs] + 1)
        after = np.concatenate([*moved, np.zeros(0, int)]).astype(int)
        after = after[after < len(begins)]
        later = np.sort(after[begins[after] == begins[after - 1] + LANE]) if len(after) else after
    return added


def predict(texts: pa.Array | list[str | None], models: Models) -> list[tuple[str, float]]:
    """(language, score) of each text: fewest bits, phrases times log2 of the sample's length.

    The score is the runner-up's share of the bits of the best two: 0.5 is a tie; 1 if only one
    language is known, 0 for ``und``.
    """
    found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    weights = np.array([m.bits for m in models.automata])
    at = 0
    while at < len(texts) and models.automata:
        block, real, total = [], [], 0
        while at < len(texts) and total < BLOCK:
            text = texts[at].as_py() if isinstance(texts, pa.Array) else texts[at]
            if text and any(map(str.isalpha, text)):
                block.append(folded(text))
                real.append(at)
                total += len(block[-1])
            at += 1
        if not block:
            continue
        bits = phrase_counts(block, models) * weights
        ranks = np.argsort(bits, axis=1, kind="stable")
        for i, row, rank in zip(real, bits, ranks, strict=True):
            best = row[rank[0]]
            score = 1.0 if len(rank) == 1 else float(row[rank[1]] / (best + row[rank[1]]))
            found[i] = (models.automata[rank[0]].lang, score)
    return found


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Texts to learn from, at most ``rows`` slices of ``chars`` characters a language.

    Only rows with doc_id and lang that are not held out count; a seeded order of doc_id chooses
    them, before any text is read.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = known.select("doc_id", "lang").distinct().withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    for group in (["lang", "_salt"], ["lang"]):  # first within parts of a language, so that no task gets all its rows
        nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        picked = picked.withColumn("_r", nth).filter(F.col("_r") <= rows).drop("_r")
    picked = picked.drop("_salt")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    texts = known.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select("lang", "doc_id", F.substring("text", start, F.lit(chars)).alias("x"))
    found: dict[str, list[str]] = {}
    for r in texts.filter(F.col("x").rlike(r"\p{L}")).groupBy("lang", "doc_id").agg(F.min("x").alias("x")).orderBy("lang", "doc_id").collect():
        found.setdefault(r["lang"], []).append(r["x"])
    return found


def identify(documents: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """Add lang_pred and score to ``documents``; every whole text is parsed, nothing else is looked at.

    A null text, or one without a letter, is ``und`` with score 0. Columns that already bear
    these names are replaced; all others, repeated rows too, pass by untouched: only texts go to
    the Python workers, in batches of at most ROWS_AT_ONCE rows and about BATCH_BYTES (settings of the
    session that are lowered here, as the returned frame runs later; they change no result).
    """
    spark = documents.sparkSession
    if not 0 < int(spark.conf.get(BATCH_ROWS_NAME)) <= ROWS_AT_ONCE:
        spark.conf.set(BATCH_ROWS_NAME, ROWS_AT_ONCE)
    spark.conf.set(BATCH_BYTES_NAME, BATCH_BYTES)
    models = spark.sparkContext.broadcast(train(samples))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def found(texts: pa.Array) -> pa.Array:
        drop_kept()
        rows = predict(texts, models.value)
        give_back()
        parts = [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.float64())]
        return pa.StructArray.from_arrays(parts, ["lang_pred", "score"])

    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    return documents.select(*kept, found("text").alias("_found")).select(*kept, "_found.lang_pred", "_found.score")


def op6_langid(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = identify(documents.select("doc_id", "text"), labelled_sample(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
