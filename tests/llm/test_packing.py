import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dialoom.llm import packing
from tests.llm.helpers import ODD, documents, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expand(runs):
    bins = {}
    for r in runs:
        for k in range(r.count):
            bins.setdefault(r.bin + k, []).append((r.offset, r.length))
    return bins


def bins_one_at_a_time(histogram, capacity):
    """The same rule on single items: large ones pair with the largest that fits, small ones best-fit."""
    items = sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True)
    large, gaps = [n for n in items if 3 * n > capacity], []
    while large:
        a = large.pop(0)
        k = next((k for k, b in enumerate(large) if a + b <= capacity), None)
        gaps.append(capacity - a - (0 if k is None else large.pop(k)))
    for n in (n for n in items if 3 * n <= capacity):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 30), max_size=20))
def test_plan_is_a_packing(histogram):
    runs = packing.plan_bins(histogram, 50)
    placed = {}
    for r in runs:
        assert r.first == placed.get(r.length, 0)
        placed[r.length] = r.first + r.count
    assert placed == {n: c for n, c in histogram.items() if c}
    for items in expand(runs).values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 50
        assert sum(3 * n > 50 for _, n in items) <= 2
    assert len(expand(runs)) == bins_one_at_a_time(histogram, 50)


def test_plan_is_tight_on_many_lengths():
    rng = np.random.default_rng(0)
    lengths = np.minimum(1024, rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1)
    histogram = dict(zip(*np.unique(lengths, return_counts=True), strict=True))
    runs = packing.plan_bins({int(k): int(v) for k, v in histogram.items()}, 1024)
    assert len(expand(runs)) <= 1.01 * lengths.sum() / 1024 + 1
    assert len(runs) < 20_000


def test_bad_lengths_are_refused():
    with pytest.raises(ValueError):
        packing.plan_bins({51: 1}, 50)


TEXT = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "be", "é", "1", "'s", "'", ".", ",", "!?", "-", "\n\n", "\r", "<|endoftext|>", "<|", "\0", " ", "\x1c", "\u180e", "×", "日"]), max_size=30).map("".join)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_forgetting_changes_no_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 40)
    rng, tokenizer, encoder = np.random.default_rng(1), Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH)
    for _ in range(30):
        texts = [" ".join(f"w{rng.integers(60)},\nx" for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in encoder(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.places) <= 40 + 200


class Counted:
    """A model that counts the strings it gets."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def __getattr__(self, name):
        return getattr(self.model, name)

    def tokenize(self, text):
        self.calls += 1
        return self.model.tokenize(text)


def invented(n, first=0):
    return ["".join(chr(97 + (k * 7_919 + 1_000_003) // 26**i % 26) for i in range(5)) for k in range(first, first + n)]


def test_new_words_go_to_the_model_together():
    words, encoder, tokenizer = invented(6_400), packing.ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    encoder.model = Counted(encoder.model)
    assert encoder([" ".join(words)])[0].tolist() == tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert 0 < encoder.model.calls <= 101


def test_words_met_before_are_not_encoded_again():
    encoder = packing.ChunkEncoder(PATH)
    texts = [" ".join(invented(20_000, k)) for k in range(0, 200_000, 20_000)]
    first = [encoder([x])[0] for x in texts]
    encoder.model = Counted(encoder.model)
    assert all((encoder([x])[0] == y).all() for x, y in zip(texts, first, strict=True))
    assert encoder.model.calls == 0


def test_words_alone_if_no_mark_is_free():
    encoder, texts = packing.ChunkEncoder(PATH), ["Ein Wort, été 12\nund x", " ".join(invented(200))]
    encoder.mark = None
    assert [x.tolist() for x in encoder(texts)] == [x.tolist() for x in packing.ChunkEncoder(PATH)(texts)]


def test_forgetting_long_pieces_and_many_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 40)
    rng, tokenizer, encoder = np.random.default_rng(2), Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH)
    for _ in range(60):
        texts = [" ".join("éxy%"[k % 4] * int(k) for k in rng.integers(1, 60, 20)) for _ in range(3)]
        assert [x.tolist() for x in encoder(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.forget()
    assert len(encoder.ids) <= 160 and len(encoder.places) <= 20


@pytest.mark.parametrize("clash", [False, True])
def test_places_are_those_of_a_dictionary(monkeypatch, clash):
    if clash:
        monkeypatch.setattr(packing._Places, "at", lambda self, keys: np.full(len(keys), len(self.slots) - 3))
    rng, places, known = np.random.default_rng(3), packing._Places(), {}
    for _ in range(12):
        pieces = list({"éa"[k % 2] * (int(k) % 40) + str(k % 7) for k in rng.integers(0, 4_000, 60 if clash else 2_000)})
        got, new = places(pa.array(["-", *pieces], pa.string())[1:])
        assert [pieces[k] for k in new] == [x for x in pieces if x not in known]
        known |= {pieces[k]: len(known) + i for i, k in enumerate(new)}
        assert got.tolist() == [known[x] for x in pieces] and len(places) == len(known)
        kept = np.flatnonzero(rng.random(len(known)) < 0.7)
        places.keep(kept)
        known = {list(known)[k]: i for i, k in enumerate(kept)}


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_chunks_give_the_tokenizers_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in packing._encoder(PATH)(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("length,pieces", [(1, [(0, 1)]), (4, [(0, 4)]), (9, [(0, 1), (1, 4), (5, 4)]), (8, [(0, 4), (4, 4)])])
def test_cuts(length, pieces):
    assert packing.cuts(length, 4) == pieces


def test_op1_on_odd_rows(spark):
    docs = with_clashes(documents(spark, ODD))
    rows = packing.op1_packing(docs, PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    for doc, text in enumerate(ODD):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == doc].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own)))
        assert own.length.sum() == len(ids)
        assert (own.length.iloc[1:] == 1024).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024


def test_sequences_hold_the_ids(spark):
    texts = ["a b", None, "c " * 3000]
    rows = packing.packed_sequences(documents(spark, texts), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(sum(([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts), []))
    assert sorted(x for r in rows for x in r.ids) == want
    assert max(len(r.ids) for r in rows) <= 1024


def test_repeats_ties_and_nothing(spark):
    twice = documents(spark, ["same", "same", "other"], ids=[1, 1, None])
    assert packing.op1_packing(twice, PATH).count() == 3
    assert packing.op1_packing(documents(spark, []), PATH).count() == 0
