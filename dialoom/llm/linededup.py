"""Line dedup over overlapping three-line windows; a text of one or two lines is one window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.storage import drop_stored, stored

WINDOW = 3
BLANK = " \t\r"
LAST = 2**63 - 1


def _numbered_lines(text):
    """Non-blank lines as (i: place in the text, a, b: two hashes of the trimmed line)."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("k")))
    return F.transform(
        F.filter(lines, lambda x: x["k"] != ""),
        lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["k"]).alias("a"), F.xxhash64(F.lit("line"), x["k"]).alias("b")),
    )


def _text_key():
    """60 bits of the text's MD5; orders rows that repeat a doc_id or have none."""
    return F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")


def _windows(documents: DataFrame) -> DataFrame:
    """One row a window: _owner, _text, _lines (places, null beyond a short text), _h, _g (128 bits of hash)."""
    lines = documents.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("_owner"), _text_key().alias("_text"), _numbered_lines(F.col("text")).alias("x")
    ).filter(F.size("x") > 0)
    at = lambda j, k: F.get(F.col("x"), j + k)
    starts = F.sequence(F.lit(0), F.greatest(F.size("x") - WINDOW, F.lit(0)))
    window = lambda j: F.struct(
        F.array(*[at(j, k)["i"] for k in range(WINDOW)]).alias("lines"),
        F.xxhash64(*[at(j, k)["a"] for k in range(WINDOW)]).alias("h"),
        F.xxhash64(*[at(j, k)["b"] for k in range(WINDOW)]).alias("g"),
    )
    return lines.select("_owner", "_text", F.explode(F.transform(starts, window)).alias("w")).select(
        "_owner", "_text", F.col("w.lines").alias("_lines"), F.col("w.h").alias("_h"), F.col("w.g").alias("_g")
    )


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """Replace ``text`` by what stays and add n_lines and n_removed.

    Lines end at newlines and are compared without surrounding blanks; blank lines neither count
    nor go. Three consecutive non-blank lines form a window, and so do all lines of a text that
    has only one or two: it equals no longer window. Of equal windows the first by doc_id (null
    last), then by the text's hash, then by place, stays; every line that a later one covers
    goes, so each distinct line survives at its first place. Rows equal in doc_id and text are
    one; a null text stays null. Columns named n_lines or n_removed are replaced, others pass.
    """
    windows = _windows(documents)
    owner = F.struct("_owner", "_text")
    firsts = windows.groupBy("_h", "_g").agg(F.min(owner).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    firsts = stored(firsts.drop("_n"), "windows")
    repeats = stored(windows.join(firsts.hint("merge"), ["_h", "_g"]).select("_owner", "_text", "_lines", "_h", "_g", (owner > F.col("_first")).alias("_later")), "repeats")
    later = repeats.filter("_later").select("_owner", "_text", "_lines")
    own = repeats.filter("NOT _later").groupBy("_owner", "_text", "_h", "_g").agg(F.array_sort(F.collect_set("_lines")).alias("_all"))
    again = own.filter(F.size("_all") > 1).select("_owner", "_text", F.explode(F.slice("_all", 2, F.size("_all") - 1)).alias("_lines"))
    gone = (
        later.union(again).select("_owner", "_text", F.explode("_lines").alias("_i")).filter("_i IS NOT NULL")
        .groupBy("_owner", "_text").agg(F.collect_set("_i").alias("_gone"))
    )
    gone = stored(gone, "covered")
    drop_stored(firsts)
    drop_stored(repeats)
    kept_columns = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    keyed = documents.select(*kept_columns, F.coalesce("doc_id", F.lit(LAST)).alias("_owner"), _text_key().alias("_text"))
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    cleaned = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return keyed.join(gone.hint("merge"), ["_owner", "_text"], "left").select(
        *[cleaned.alias("text") if c == "text" else F.col(c) for c in kept_columns],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed"),
    )


def op7_linededup(documents: DataFrame) -> DataFrame:
    """doc_id, text (cleaned), n_lines, n_removed of every document."""
    return drop_repeated_lines(documents.select("doc_id", "text"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS o, text, x.i AS i, x.k AS k FROM (
    SELECT doc_id, text, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i - 1, 'k': trim(x, chr(32) || chr(9) || chr(13))})) AS x
    FROM documents)),
b AS (
  SELECT *, row_number() OVER (PARTITION BY o, text ORDER BY i) AS r, count(*) OVER (PARTITION BY o, text) AS n, ('0x' || left(md5(text), 15))::BIGINT AS m
  FROM (SELECT DISTINCT o, text, i, k FROM l WHERE k <> '')),
w AS (
  SELECT o, m, text, r, n, i AS i0, lead(i) OVER d AS i1, lead(i, 2) OVER d AS i2,
    k AS k0, lead(k) OVER d AS k1, lead(k, 2) OVER d AS k2 FROM b WINDOW d AS (PARTITION BY o, text ORDER BY i)),
c AS (
  SELECT *, first_value(o) OVER f AS fo, first_value(m) OVER f AS fm FROM w WHERE i2 IS NOT NULL OR (n < 3 AND r = 1)
  WINDOW f AS (PARTITION BY k0, k1, k2 ORDER BY o, m)),
d AS (SELECT *, min(r) OVER (PARTITION BY o, text, k0, k1, k2) AS r0 FROM c),
g AS (
  SELECT o, text, list(DISTINCT i) AS gone FROM (
    SELECT o, text, unnest([i0, i1, i2]) AS i FROM d WHERE o > fo OR m <> fm OR r > r0) WHERE i IS NOT NULL GROUP BY o, text)
SELECT t.doc_id,
  CASE WHEN g.gone IS NULL THEN t.text ELSE array_to_string(list_filter(string_split(t.text, chr(10)), lambda x, i: NOT list_contains(g.gone, i - 1)), chr(10)) END AS text,
  coalesce(len(string_split(t.text, chr(10))), 0)::INTEGER AS n_lines, coalesce(len(g.gone), 0)::INTEGER AS n_removed
FROM documents t LEFT JOIN g ON coalesce(t.doc_id, 9223372036854775807) = g.o AND t.text = g.text
"""
