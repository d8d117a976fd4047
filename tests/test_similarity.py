"""Text similarities over whole texts against brute force."""

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialoom.functions import metrics, texts
from dialoom.plans import registry

RNG = random.Random(5)
LONG = [" ".join(RNG.choice("ab b cd Cd x yy z zz q".split()) for _ in range(n)) for n in (30, 90, 400, 700)]
TEXTS = ["", "  ", "one", *LONG, "w" * 500 + " tail", "\n".join(LONG[:2])]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def rouge(a, b):
    a, b = a.lower().split(), b.lower().split()
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def bag(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return 2 * (a & b).total() / (a.total() + b.total()) if a and b else 0.0


def ratio(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else difflib.SequenceMatcher(None, a, b).ratio()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sim"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name,skip,score", [("sim02_rouge_l", 20, rouge), ("sim03_edit_similarity", 10, ratio)])
def test_whole_texts_are_scored(spark, sf, name, skip, score):
    got = {r.doc_id: r.score for r in registry.queries()[name](spark, sf).collect()}
    assert got == pytest.approx({i: score(t, t[skip:]) for i, t in enumerate(TEXTS)})


@pytest.mark.parametrize("cached", [0, 4096])
def test_common_words_in_order(monkeypatch, cached):
    monkeypatch.setattr(texts, "CACHED_WORDS", cached)
    for _ in range(300):
        a, b = ([RNG.choice("abcde") for _ in range(RNG.randrange(90))] for _ in "ab")
        assert texts.lcs_of_words(a, b) == lcs(a, b)


def test_scores_of_unlike_texts(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    frame = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = frame.select("a", "b", texts.rouge_l(a, b).alias("r"), metrics.bag_f1(metrics.tokens(a), metrics.tokens(b)).alias("f")).collect()
    assert len(rows) == len(pairs)
    assert [(r.r, r.f) for r in rows] == [pytest.approx((rouge(r.a, r.b), bag(r.a, r.b))) for r in rows]


def test_every_category_over_the_whole_table(spark, sf):
    kinds = ["single_doc_qa", "multi_doc_qa", "few_shot", "synthetic", "summarization", "code", "other"]
    want = {}
    for i, t in enumerate(TEXTS):
        pred, kind = t[10:] if i % 2 else f" {t}\n", kinds[i % 7]
        score = {"summarization": rouge, "code": ratio, "other": lambda a, b: float(a.strip() == b.strip())}.get(kind, bag)
        want[i] = (kind, pytest.approx(100 * score(pred, t)))
    got = {r.doc_id: (r.category, r.score) for r in registry.queries()["sim05_category_scores"](spark, sf).collect()}
    assert got == want and {k for k, _ in got.values()} == set(kinds)
