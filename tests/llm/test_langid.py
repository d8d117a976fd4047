import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.llm import langid
from dialoom.llm.storage import table
from tests.llm.helpers import ODD, documents, with_clashes


def phrases(data, sample):
    """Greedy parse of the whole text by substring search."""
    count = i = 0
    while i < len(data):
        n = 1
        while i + n < len(data) and data[i : i + n + 1] in sample:
            n += 1
        count += 1
        i += n
    return count


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=600), min_size=1, max_size=5), st.text("abc", min_size=1, max_size=60))
def test_parse_counts(texts, sample):
    models = langid.train({"x": [sample]})
    assert langid.phrase_counts([t.encode() for t in texts], models)[:, 0].tolist() == [phrases(t, sample) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.text("ab", min_size=1, max_size=30), st.text("ab", min_size=1, max_size=10))
def test_automaton_accepts_substrings_only(text, probe):
    code = {"a": 1, "b": 2}
    table_ = langid.suffix_automaton([code[c] for c in text], 3)
    state, inside = 0, True
    for c in probe:
        state = table_[state * 3 + code[c]]
        inside = inside and state != 0
        if not inside:
            break
    assert inside == (probe in text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=90), min_size=1, max_size=5), st.text("abc", min_size=1, max_size=200))
def test_short_lanes_join_to_one_parse(texts, sample):
    models = langid.train({"x": [sample]})
    before, langid.LANE = langid.LANE, 7
    try:
        assert langid.phrase_counts([t.encode() for t in texts], models)[:, 0].tolist() == [phrases(t, sample) for t in texts]
    finally:
        langid.LANE = before


def test_predictions_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(40)
    samples = langid.labelled_sample(docs, rows=3, chars=200)
    joined = {lang: b" ".join(langid.folded(x) for x in parts) for lang, parts in samples.items()}
    models = langid.train(samples)

    def symbols(data):
        return bytes(models.classes[b] for b in data)

    for r in langid.identify(docs, samples).collect():
        text = symbols(langid.folded(r.text))[:3000]
        bits = {lang: phrases(text, symbols(own)) * math.log2(len(own) + 2) for lang, own in joined.items()}
        if len(r.text.encode()) < 3000:
            assert r.lang_pred == min(sorted(bits), key=bits.get)


def test_only_letters_count(spark):
    got = langid.identify(documents(spark, ["½ ² Ⅷ", "1 _ 2", "日本"]), {"en": ["the cat"], "ja": ["日本語"]}).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["und", "und", "ja"]


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.op6_langid(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_held_out_labels_are_not_read(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = ({tuple(r) for r in langid.op6_langid(x).collect()} for x in (docs, spoiled))
    assert a == b


def test_odd_rows(spark):
    docs = with_clashes(documents(spark, ODD))
    got = {r.doc_id: r for r in langid.op6_langid(docs).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        has = bool(text) and any(c.isalpha() for c in text)
        assert got[i].lang_pred == ("en" if has else "und")
    assert langid.op6_langid(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.op6_langid(documents(spark, ["abc"], lang=None)).collect()} == {"und"}
    assert np.isfinite([r.score for r in got.values()]).all()
