"""Token counts by way of distinct pre-tokens: each is counted once, and documents sum up counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.storage import stored

SPACE = "▁"  # how the model writes a space
HOT = 1 << 18  # most frequent pre-tokens whose counts every task gets
FLUSH = 1 << 19  # distinct pre-tokens a task gathers before it hands them on
_SPACED = re.compile(" *[^ ]+| +$")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text: a run of spaces with the word after it, cut also before newlines.

    No piece of the model crosses such a cut. A pre-token is written without its first space; one
    that begins with a newline has none.
    """
    found: list[str] = []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    for k, line in enumerate(text.split("\n")):
        words = line.split(" ")
        if "" in words[1:] or (k == 0 and not words[0]):
            if k:
                head = line[: len(line) - len(line.lstrip(" "))] and "" or words[0]
                found.append("\n" + head)
                found += [x[1:] for x in _SPACED.findall(line[len(head) :])]
            else:
                found += [x[1:] for x in _SPACED.findall(" " + line)]
        else:
            if k:
                words[0] = "\n" + words[0]
            found += words
    return found


class PieceCounter:
    """Counts the pieces of pre-tokens."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            self.model.id_to_piece(i) for i in range(self.model.get_piece_size())
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
        ]
        if any("\n" in x or SPACE in x.lstrip(SPACE) for x in plain):
            raise ValueError("pieces of this model cross the cuts of pre_tokens")
        if self.model.encode("  a ", out_type=str)[-1] != SPACE or self.model.encode("a", out_type=str)[0][0] != SPACE:
            raise ValueError("this model trims or does not mark spaces")

    def __call__(self, tokens: list[str]) -> list[int]:
        ids = self.model.encode(tokens, num_threads=1)
        return [(len(x) if t else 1) - (t[:1] == "\n") for t, x in zip(tokens, ids, strict=True)]


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of a task with their frequencies."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "freq"])

    for batch in batches:
        for text in batch.column("text"):
            if x := text.as_py():
                seen.update(pre_tokens(x))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
    yield out()


def _count(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path)
        for batch in batches:
            n = counter(batch.column("token").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("freq"), pa.array(n, pa.int32())], ["token", "freq", "n"])

    return run


def piece_table(documents: DataFrame, path: str) -> DataFrame:
    """token, freq, n: every distinct pre-token of the corpus with its frequency and pieces."""
    seen = documents.select("text").mapInArrow(_gather, "token string, freq long")
    distinct = seen.groupBy("token").agg(F.sum("freq").alias("freq"))
    return stored(distinct.mapInArrow(_count(path), "token string, freq long, n int"), "pieces")


def frequent(pieces: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: all from the least frequency that leaves at most ``most``."""
    capped = pieces.select(F.least("freq", F.lit(1 << 16)).alias("f"))
    total, floor = 0, None
    for f, n in sorted(((r[0], r[1]) for r in capped.groupBy("f").count().collect()), reverse=True):  # at most 2**16 rows
        total += n
        if total > most:
            break
        floor = f
    if floor is None:
        return {}
    rows = pieces.filter(F.col("freq") >= floor).select("token", "n").toPandas()
    return dict(zip(rows["token"], rows["n"].astype(int), strict=True))


def _sum_up(hot):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        row = 0
        for batch in batches:
            rows, ids, sizes, sums, tokens, freqs = [], [], [], [], [], []
            for key, doc, text in zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                x, total = text.as_py(), 0
                rest = []
                if x:
                    for token, k in Counter(pre_tokens(x)).items():
                        n = known.get(token)
                        if n is None:
                            rest.append((token, k))
                        else:
                            total += n * k
                rows += [key] * (1 + len(rest))
                ids.append(doc)
                ids += [None] * len(rest)
                sizes.append(len(x.encode()) if x else 0)
                sizes += [None] * len(rest)
                sums.append(total)
                sums += [0] * len(rest)
                tokens.append(None)
                freqs.append(0)
                for token, k in rest:
                    tokens.append(token)
                    freqs.append(k)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(tokens, pa.string()), pa.array(freqs, pa.int32())],
                ["_row", "doc_id", "n_bytes", "_sum", "token", "_k"],
            )

    return run


def token_counts(documents: DataFrame, path: str, limit: int = 4096, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null counts as empty, which has no tokens.

    The piece table is joined in two ways with the same counts: its ``hot`` most frequent
    entries are sent to every task, which sums them in place, and the rest is an equi-join on
    the pre-token. Rows that repeat a doc_id are counted one by one.
    """
    pieces = piece_table(documents, path)
    known = documents.sparkSession.sparkContext.broadcast(frequent(pieces, hot))
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    parts = stored(rows.mapInArrow(_sum_up(known), "_row long, doc_id long, n_bytes long, _sum long, token string, _k int"), "parts")
    rare = parts.filter("token is not null").join(pieces.select("token", "n"), "token").groupBy("_row").agg(F.sum(F.col("n") * F.col("_k")).alias("_rare"))
    total = (F.col("_sum") + F.coalesce("_rare", F.lit(0))).cast("long")
    return parts.filter("token is null").join(rare, "_row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
