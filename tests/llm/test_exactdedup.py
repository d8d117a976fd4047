import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.llm import exactdedup as X
from tests.llm.helpers import ODD, documents, with_clashes

POWERS = X.chunk_powers(X.Scheme())


def brute(pairs):
    groups = {}
    for row, (doc, text) in enumerate(pairs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, row))
    out = {}
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            doc = None if m[1] else m[2]
            out.setdefault((doc, None if keep[1] else keep[2], len(members), hashlib.sha256(norm.encode()).hexdigest()), []).append(m == keep)
    return {k: sorted(v) for k, v in out.items()}


def run(frame, **more):
    out = {}
    for r in X.exact_duplicates(frame, **more).collect():
        out.setdefault((r.doc_id, r.keep_id, r.group_size, r.text_sha256), []).append(r.kept)
    return {k: [sum(v), len(v)] for k, v in out.items()}


def summed(found):
    return {k: [sum(v), len(v)] for k, v in found.items()}


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=6000), st.binary(max_size=3000))
def test_fingerprints_compose(a, b):
    s = X.Scheme()
    assert X.combine(X.fingerprint(a, POWERS, s), X.fingerprint(b, POWERS, s), len(b), s) == X.fingerprint(a + b, POWERS, s)


TEXTS = [*ODD, "a b", "ab", "a\nb ", "ab ", "ba", "wW" * 3000, "w W" * 3000]


@pytest.mark.parametrize("more", [{}, {"segment": 7}, {"scheme": X.Scheme((17, 13), (5, 3))}, {"bloom_bits": 32}])
def test_against_brute_force(spark, more):
    pairs = list(enumerate(TEXTS))
    assert run(with_clashes(documents(spark, TEXTS)), **more) == summed(brute(pairs))


def test_repeated_and_null_ids(spark):
    texts, ids = ["x y", "x y", "xy", "q", "q", "q"], [3, 3, 1, None, 9, None]
    got = run(documents(spark, texts, ids=ids))
    assert got == summed(brute(list(zip(ids, texts, strict=True))))
    assert X.exact_duplicates(documents(spark, [])).count() == 0
