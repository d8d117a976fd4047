from collections import defaultdict

import numpy as np
import pytest

from dialoom.llm import neardup as N
from dialoom.llm.storage import table
from tests.llm.helpers import ODD, documents, with_clashes


def brute(texts, least=0.8):
    """Classes by comparing all pairs of texts; equal word sequences are one text."""
    words = [tuple(N.words_of(t)) for t in texts]
    bags = [N.shingles(N.word_hashes(list(w)), 5) for w in words]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if words[i] == words[j] or (words[i] and words[j] and N.similarity(bags[i], bags[j]) >= least):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(texts))}


def run(frame, **more):
    rows = N.near_duplicate_classes(frame, **more).collect()
    by_class = defaultdict(list)
    for r in rows:
        by_class[r.class_id].append(r)
    for members in by_class.values():
        assert sum(r.kept for r in members) == 1
        assert {r.class_size for r in members} == {len(members)}
    return {r.doc_id: r.class_id for r in rows}


def edited(rng, words, share):
    out = list(words)
    for i in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[i] = f"e{rng.integers(10**6)}"
    return " ".join(out)


def family(rng, n, size, share):
    words = [f"w{rng.integers(5000)}" for _ in range(size)]
    return [" ".join(words), *[edited(rng, words, share) for _ in range(n)]]


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(2)
    v = rng.integers(1, 2**60, 300).astype(np.uint64)
    a = rng.integers(0, 9, 300)
    b = np.where(rng.random(300) < 0.7, a, rng.integers(0, 30, 300))
    x, y = np.sort(np.repeat(v, a)), np.sort(np.repeat(v, b))
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert N.similarity(x, y) == pytest.approx(true)
    got = [np.mean(np.equal(*N.signatures([x, y], 150, seed))) for seed in range(80)]
    assert np.mean(got) == pytest.approx(true, abs=4 * np.std(got) / 80**0.5)


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(3)
    bags = [np.sort(rng.integers(1, 2**60, n).astype(np.uint64)) for n in (1, 2, 40, 3000)]
    together = N.signatures(bags, 150, 1)
    for bag, row in zip(bags, together, strict=True):
        assert np.isfinite(row).all() and (N.signatures([bag], 150, 1)[0] == row).all()
    assert np.isinf(N.signatures([np.array([], np.uint64)], 150, 1)).all()


def test_planted_families(spark):
    rng = np.random.default_rng(4)
    texts = []
    for share in (0.004, 0.01, 0.02, 0.1, 0.3):
        texts += family(rng, 6, 400, share)
    texts += [f"clean {i} " + " ".join(f"c{rng.integers(10**6)}" for _ in range(60)) for i in range(30)]
    texts += ["tiny text", "tiny text", "Tiny  TEXT", "other text", "a b c d e", "a b c d e f"]
    assert run(documents(spark, texts)) == brute(texts)


def test_chains_and_a_large_family(spark):
    rng = np.random.default_rng(5)
    words = [f"w{rng.integers(5000)}" for _ in range(300)]
    chain = [" ".join(words)]
    for k in range(12):
        words[k * 20 : k * 20 + 4] = [f"z{k}{j}" for j in range(4)]
        chain.append(" ".join(words))
    texts = chain + family(rng, 120, 250, 0.012)
    assert run(documents(spark, texts).repartition(5)) == brute(texts)


def test_a_family_with_many_degrees_of_change(spark):
    """Most texts are near the hub, many are not but near one another: pairs beyond the hub decide."""
    rng = np.random.default_rng(6)
    words = [f"w{rng.integers(5000)}" for _ in range(200)]
    texts = [" ".join(words)]
    for share in rng.uniform(0.005, 0.06, 70):
        far = edited(rng, words, share)
        texts += [far, edited(rng, far.split(), 0.01)] if share > 0.045 else [far]
    assert len(set(brute(texts).values())) > 3
    assert run(documents(spark, texts)) == brute(texts)


def test_odd_rows(spark):
    assert run(with_clashes(documents(spark, ODD))) == brute(ODD)
    assert N.op10_neardup(documents(spark, [])).count() == 0


def test_repeated_ids_keep_one_row_of_a_class(spark):
    docs = documents(spark, ["a b c", "a b c", "x y z", None, "a b c"], ids=[1, 1, 2, None, None])
    kept = sorted((r.doc_id or -1, r.text or "") for r in N.drop_near_duplicates(docs).collect())
    assert kept == [(-1, ""), (1, "a b c"), (2, "x y z")]


def test_small_table_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = {rows[i].doc_id: rows[j].doc_id for i, j in brute([r.text for r in rows]).items()}
    assert run(docs) == want


def degrees_of_change(rng, n):
    words = [f"w{rng.integers(5000)}" for _ in range(200)]
    texts = [" ".join(words)]
    for share in rng.uniform(0.005, 0.06, n):
        far = edited(rng, words, share)
        texts += [far, edited(rng, far.split(), 0.01)] if share > 0.045 else [far]
    return texts


@pytest.mark.parametrize("at_hand", [0, N.AT_HAND])
def test_differences_become_rows_only_beyond_a_bound(spark, monkeypatch, at_hand):
    """Hubs of moderate size are searched without a row for each difference, larger ones with them; classes are the same."""
    made, stored = {}, N.stored

    def counted(frame, name):
        table = stored(frame, name)
        made[name] = made.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(N, "stored", counted)
    monkeypatch.setattr(N, "AT_HAND", at_hand)
    texts = degrees_of_change(np.random.default_rng(8), 70)
    assert run(documents(spark, texts)) == brute(texts)
    assert made["loads"] > 0
    assert (made.get("apart", 0) > 0) == (at_hand == 0)


@pytest.mark.parametrize("pairs_met", [1, N.PAIRS_MET])
def test_search_beyond_a_hub_joins_what_all_pairs_join(monkeypatch, pairs_met):
    monkeypatch.setattr(N, "PAIRS_MET", pairs_met)
    rng = np.random.default_rng(9)
    for seed in range(12):
        hub, *bags = (N.levels(N.shingles(N.word_hashes(N.words_of(t)), 5)) for t in degrees_of_change(rng, 10 + 4 * seed))
        tokens = [np.setxor1d(b, hub).view(np.int64) for b in bags]
        missing = np.array([len(np.setdiff1d(hub, b)) for b in bags])
        extra = np.array([len(np.setdiff1d(b, hub)) for b in bags])
        near = np.array([N.similarity(b, hub) >= 0.8 for b in bags])
        assert not near.all()
        parts = []
        for links in (N.links_beyond_hub(near, missing, extra, len(hub), tokens, 0.8), [(i, j) for i in range(len(bags)) for j in range(i) if N.similarity(bags[i], bags[j]) >= 0.8]):
            label = np.where(near, -1, np.arange(len(bags)))
            for i, j in links:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
            parts.append(label.tolist())
        assert parts[0] == parts[1]
    assert N.links_beyond_hub(np.ones(0, bool), np.ones(0, int), np.ones(0, int), 0, [], 0.8) == []


def test_bags_and_keys_are_sent_once(spark, monkeypatch):
    """Bags do not move to meet the places where they are wanted, and band keys move in one exchange."""
    plans, stored = {}, N.stored

    def planned(frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return stored(frame, name)

    monkeypatch.setattr(N, "stored", planned)
    texts = family(np.random.default_rng(10), 12, 120, 0.02)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert run(documents(spark, texts)) == brute(texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans["spokes"].count("Exchange ") == 2  # the places to the bags, then the bags to their places
    assert plans["members"].count("Exchange ") == 1
    assert not spark.catalog.listTables()
