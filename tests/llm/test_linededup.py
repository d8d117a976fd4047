import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dialoom.llm import linededup
from tests.llm.helpers import ODD, documents, with_clashes


def brute(pairs):
    """pairs of (doc_id, text) with distinct ids; windows in order of id (null last) and place."""
    seen, out = {}, {}
    ordered = sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0))
    for doc, text in ordered:
        if text is None:
            out[doc] = (None, 0, 0)
            continue
        lines = text.split("\n")
        real = [(i, x.strip(" \t\r")) for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for j in range(max(len(real) - 2, min(len(real), 1))):
            key = tuple(x for _, x in real[j : j + 3])
            if key in seen:
                gone |= {i for i, _ in real[j : j + 3]}
            seen.setdefault(key, doc)
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def run(frame):
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.op7_linededup(frame).collect()}


LINES = st.lists(st.sampled_from(["a", "b", " b", "c", "", "  "]), max_size=9).map("\n".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINES, min_size=1, max_size=8))
def test_against_brute_force(spark, texts):
    assert run(documents(spark, texts)) == brute(list(enumerate(texts)))


def test_odd_rows(spark):
    texts = [*ODD, "a\nb\nc\na\nb\nc", "\n".join("q" for _ in range(50)), "\n".join(str(i) for i in range(5000))]
    assert run(with_clashes(documents(spark, texts))) == brute(list(enumerate(texts)))
    assert linededup.op7_linededup(documents(spark, [])).count() == 0


def test_rows_without_id_lose_repeats_too(spark):
    texts = ["a\nb\nc", "k\na\nb\nc", "a\nb\nc\nz"]
    rows = linededup.op7_linededup(documents(spark, texts, ids=[None] * 3)).collect()
    assert sorted(r.n_removed for r in rows) == [0, 3, 3]


def test_repeated_ids_are_one_owner(spark):
    rows = linededup.op7_linededup(documents(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc"], ids=[1, 1, None])).collect()
    assert sorted(((r.doc_id or 99), r.text, r.n_removed) for r in rows) == [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (99, "", 3)]


@pytest.mark.parametrize("texts", [["x\ny\nz\nw", "k\nx\ny\nz", None, "y\nz\nw", "one", " one", "a\nb", "a\n\nb ", "one\ntwo\none"]])
def test_sql_twin(spark, texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert {r[0]: tuple(r[1:]) for r in con.execute(linededup.ORACLE).fetchall()} == run(documents(spark, texts))
