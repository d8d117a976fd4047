"""Text similarity and text repair helpers."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import metrics


CACHED_WORDS = 4096
RARE = 32


def lcs_of_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit a place of ``a`` as the row of the table.

    Where ``a`` is long, only words with more than RARE places keep their bits.
    """
    places: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    bits: dict[str, int] = {}
    row = full = (1 << len(a)) - 1
    for w in b:
        if w not in places:
            continue
        if (at := bits.get(w)) is None:
            at = sum(1 << i for i in places[w])
            if len(a) <= CACHED_WORDS or len(places[w]) > RARE:
                bits[w] = at
        hit = row & at
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(pred: Column, true: Column) -> Column:
    """F-measure of the longest common subsequence of lower-cased words."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else lcs_of_words(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype="Int64")

    p, t = metrics.tokens(pred), metrics.tokens(true)
    common = F.pandas_udf(run, "long")(F.array_join(p, " "), F.array_join(t, " "))
    return F.when((F.size(p) == 0) | (F.size(t) == 0), 0.0).otherwise(2 * common / (F.size(p) + F.size(t)))


def edit_similarity(pred: Column, true: Column) -> Column:
    """Matching-blocks ratio of two texts; both empty 1, one empty 0."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if not x and not y else 0.0 if not x or not y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "double")(pred, true)


def category_score(category: Column, pred: Column, true: Column) -> Column:
    """100 times the score that a task category asks for; unknown ones compare stripped texts."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    of = lambda name: [F.when(category == name, c).otherwise("") for c in (pred, true)]  # noqa: E731  # Python gets all rows
    score = (
        F.when(category.isin("single_doc_qa", "multi_doc_qa", "few_shot", "synthetic"), metrics.bag_f1(metrics.tokens(pred), metrics.tokens(true)))
        .when(category == "summarization", rouge_l(*of("summarization")))
        .when(category == "code", edit_similarity(*of("code")))
        .otherwise((strip(pred) == strip(true)).cast("double"))
    )
    return score * 100


def folded_key(text: Column) -> Column:
    """Comparison key: compatibility-folded, without control and format characters, case-folded, blanks collapsed."""

    def run(texts: pd.Series) -> pd.Series:
        def key(t: str | None) -> str | None:
            if t is None:
                return None
            folded = unicodedata.normalize("NFKC", t)
            return " ".join("".join(c for c in folded if unicodedata.category(c)[0] != "C" or c.isspace()).casefold().split())

        return texts.map(key, na_action=None)

    return F.pandas_udf(run, "string")(text)


def mentions(text: Column, anchor: Column) -> Column:
    """Whether an anchor stands in a text with no word character at either end."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(anchor, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return F.regexp_like(text, quoted)


def sections(text: Column) -> Column:
    """Blocks between blank lines."""
    return F.filter(F.split(text, r"\n\s*\n"), lambda s: F.regexp_replace(s, r"\s", "") != "")


def haystack(needle: Column, filler: str, length: int, depth: float) -> Column:
    """A text of ``length`` characters of filler with a needle at the sentence end next before a depth."""
    body = F.substring(F.lit(filler * (length // len(filler) + 1)), 1, length)
    head = F.regexp_extract(F.substring(body, 1, int(length * depth)), r"(?s)^(.*\. )", 1)
    return F.concat(head, needle, F.lit(" "), F.substring(body, F.length(head) + 1, F.lit(length)))


def corrupted(args: Column) -> Column:
    """Arguments (string map) with one value changed: two strings swapped, else a digit moved, else the last one dropped; null if empty.

    Keys are taken in order, so the same call always breaks in the same way.
    """
    keys = F.array_sort(F.map_keys(args))
    value = lambda i: F.element_at(args, F.get(keys, i))
    swapped = F.map_concat(F.map_filter(args, lambda k, v: ~F.array_contains(F.slice(keys, 1, 2), k)), F.map_from_arrays(F.slice(keys, 1, 2), F.array(value(1), value(0))))
    first_digit = F.map_from_arrays(keys, F.transform(keys, lambda k, i: F.when(i == 0, F.translate(F.element_at(args, k), "0123456789", "1234567890")).otherwise(F.element_at(args, k))))
    dropped = F.map_filter(args, lambda k, v: k != F.element_at(keys, -1))
    return F.when(F.size(keys) == 0, None).when((F.size(keys) > 1) & (value(0) != value(1)), swapped).when(value(0).rlike("[0-9]"), first_digit).otherwise(dropped)
