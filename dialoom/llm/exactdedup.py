"""Exact dedup by composable polynomial fingerprints, with a chunkwise comparison of equal ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import bloom
from dialoom.llm.storage import stored

BLANK = b" \t\n\x0b\x0c\r"
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 69069069)
CHUNK = 2048  # bytes a chunk hash covers; 255 * 2**31 * CHUNK stays below 2**53
SEGMENT = 1 << 24  # code points of a text hashed as one row; longer texts are dealt as several
COMPARED = 1 << 16  # bytes of a chunk of the comparison


class Scheme(NamedTuple):
    moduli: tuple[int, int] = MODULI
    bases: tuple[int, int] = BASES


def chunk_powers(scheme: Scheme) -> np.ndarray:
    """Powers of the bases from CHUNK - 1 down to 0, a column for each modulus."""
    out = np.empty((CHUNK, 2))
    for k, (p, b) in enumerate(zip(scheme.moduli, scheme.bases, strict=True)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, k], x = x, x * b % p
    return out


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int, scheme: Scheme) -> tuple[int, int]:
    """Fingerprint of two joined byte strings: the left one is shifted by the length of the right one."""
    return tuple((x * pow(b, right_length, p) + y) % p for x, y, p, b in zip(left, right, scheme.moduli, scheme.bases, strict=True))


def fingerprint(data: bytes, powers: np.ndarray, scheme: Scheme) -> tuple[int, int]:
    """Hash all chunks at once, then combine them from left to right."""
    raw = np.frombuffer(data, dtype=np.uint8)
    whole = len(raw) // CHUNK
    state = (0, 0)
    for at in range(0, whole, 512):
        part = raw[at * CHUNK : min(whole, at + 512) * CHUNK].reshape(-1, CHUNK)
        for h in (part.astype(np.float64) @ powers).astype(np.int64).tolist():
            state = combine(state, (h[0] % scheme.moduli[0], h[1] % scheme.moduli[1]), CHUNK, scheme)
    rest = raw[whole * CHUNK :]
    if len(rest):
        h = rest.astype(np.float64) @ powers[CHUNK - len(rest) :]
        state = combine(state, (int(h[0]) % scheme.moduli[0], int(h[1]) % scheme.moduli[1]), len(rest), scheme)
    return state


_HASHED = "_row long, doc_id long, _points long, _part int, _parts int, _len long, _h0 long, _h1 long, _s0 long, _s1 long, _sha string"


def _hash_rows(scheme: Scheme):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = chunk_powers(scheme)
        for batch in batches:
            lens, hashes, shifts, shas = [], [], [], []
            for data, sha in zip(batch.column("_data"), batch.column("_sha"), strict=True):
                plain = data.as_py().translate(None, BLANK)
                lens.append(len(plain))
                hashes.append(fingerprint(plain, powers, scheme))
                shifts.append(tuple(pow(b, len(plain), p) for p, b in zip(scheme.moduli, scheme.bases, strict=True)))
                shas.append(sha.as_py() or hashlib.sha256(plain).hexdigest())
            column = lambda rows, k: pa.array([r[k] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("_row", "doc_id", "_points", "_part", "_parts")], pa.array(lens, pa.int64()), column(hashes, 0), column(hashes, 1), column(shifts, 0), column(shifts, 1), pa.array(shas, pa.string())],
                ["_row", "doc_id", "_points", "_part", "_parts", "_len", "_h0", "_h1", "_s0", "_s1", "_sha"],
            )

    return run


def fingerprints(documents: DataFrame, scheme: Scheme = Scheme(), segment: int = SEGMENT) -> DataFrame:
    """_row, doc_id, _points, _len, _h0, _h1, _sha of every row.

    A text beyond ``segment`` code points is dealt as several rows whose hashes are combined.
    """
    text = F.coalesce("text", F.lit(""))
    cuts = F.ceil(F.length(text) / F.lit(segment)).cast("int")
    long = F.length(text) > segment
    pieces = F.when(long, F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substring(text, i * segment + 1, F.lit(segment)))).otherwise(F.array(text))
    sha = F.when(long, F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""), 256))
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text").select(
        "_row", "doc_id", F.length(text).cast("long").alias("_points"), sha.alias("_sha"),
        F.when(long, cuts).otherwise(1).alias("_parts"), F.posexplode(pieces).alias("_part", "_piece"),
    ).select("*", F.col("_piece").cast("binary").alias("_data")).drop("_piece")
    hashed = stored(rows.mapInArrow(_hash_rows(scheme), _HASHED), "hashed")
    p0, p1 = scheme.moduli
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_part", "_len", "_h0", "_h1", "_s0", "_s1"))),
        F.struct(*[F.lit(0).cast("long").alias(c) for c in ("_len", "_h0", "_h1")]),
        lambda a, x: F.struct(
            (a["_len"] + x["_len"]).alias("_len"), ((a["_h0"] * x["_s0"] + x["_h0"]) % p0).alias("_h0"), ((a["_h1"] * x["_s1"] + x["_h1"]) % p1).alias("_h1")
        ),
    )
    one = ["_row", "doc_id", "_points", "_len", "_h0", "_h1", "_sha"]
    joined = hashed.filter("_parts > 1").groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("_points").alias("_points"), fold.alias("_f"), F.first("_sha").alias("_sha")
    )
    return hashed.filter("_parts = 1").select(one).union(joined.select("_row", "doc_id", "_points", "_f._len", "_f._h0", "_f._h1", "_sha"))


def _suspect_chunks(scheme: Scheme, filter_words):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, words = chunk_powers(scheme), filter_words.value
        for batch in batches:
            plain = [x.as_py().translate(None, BLANK) for x in batch.column("_data")]
            if not plain:
                continue
            h = np.array([fingerprint(x, powers, scheme) for x in plain], dtype=np.int64)
            for i in np.flatnonzero(bloom.hits(words, h[:, 0], h[:, 1])):
                x = plain[i]
                parts = [x[k : k + COMPARED] for k in range(0, len(x), COMPARED)]
                n = len(parts)
                yield pa.RecordBatch.from_pydict({
                    "_len": pa.array([len(x)] * n, pa.int64()), "_h0": pa.array([int(h[i, 0])] * n, pa.int64()), "_h1": pa.array([int(h[i, 1])] * n, pa.int64()),
                    "_no": pa.array(range(n), pa.int64()), "_chunk": pa.array(parts, pa.binary()),
                })

    return run


def conflicting(documents: DataFrame, repeated: DataFrame, scheme: Scheme, bits: int) -> DataFrame:
    """Fingerprints (_len, _h0, _h1) of ``repeated`` that stand for more than one text.

    Texts whose fingerprint repeats stream by as chunks; equal chunks at one place collapse
    before they are shuffled, and a place with two contents shows a conflict.
    """
    words = documents.sparkSession.sparkContext.broadcast(bloom.build(repeated, F.col("_h0"), F.col("_h1"), bits))
    data = documents.select(F.coalesce("text", F.lit("")).cast("binary").alias("_data"))
    chunks = data.mapInArrow(_suspect_chunks(scheme, words), "_len long, _h0 long, _h1 long, _no long, _chunk binary")
    contents = chunks.groupBy("_len", "_h0", "_h1", "_no", "_chunk").agg(F.lit(1).alias("_one"))
    places = contents.groupBy("_len", "_h0", "_h1", "_no").agg(F.count("*").alias("_n")).filter("_n > 1")
    return stored(places.select("_len", "_h0", "_h1").distinct(), "conflicts")


def exact_duplicates(documents: DataFrame, scheme: Scheme = Scheme(), segment: int = SEGMENT, bloom_bits: int = 1 << 23) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when they are so after ASCII white space is deleted; null counts as empty.
    Of equal ones the row with the most code points stays, then the smallest doc_id (null last);
    of rows equal in both exactly one is kept. A fingerprint that stands for several texts is
    told apart by SHA-256.
    """
    rows = stored(fingerprints(documents, scheme, segment), "fingerprints")
    key = ["_len", "_h0", "_h1"]
    repeated = stored(rows.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").select(*key), "repeated")
    rows = rows.withColumn("_variant", F.lit(""))
    conflicts = conflicting(documents, repeated, scheme, bloom_bits)
    if not conflicts.isEmpty():
        flagged = conflicts.withColumn("_bad", F.lit(True))
        rows = rows.join(flagged, key, "left").withColumn("_variant", F.when(F.col("_bad"), F.col("_sha")).otherwise("")).drop("_bad")
    key.append("_variant")
    order = F.struct("_points", F.col("doc_id").isNotNull().alias("_has"), F.bitwise_not("doc_id").alias("_id"), F.bitwise_not("_row").alias("_at"))
    groups = rows.groupBy(*key).agg(F.max(order).alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
    groups = stored(groups.select(*key, F.bitwise_not("_best._id").alias("_keep"), F.bitwise_not("_best._at").alias("_keep_row"), "_n"), "groups")
    alone = F.col("_n").isNull()
    return rows.join(groups, key, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST) AS k FROM t)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY s ORDER BY k) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, k = 1 AS kept, s AS text_sha256 FROM r
"""
