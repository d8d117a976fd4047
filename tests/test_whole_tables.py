"""Queries without a SQL twin against brute force on small tables whose ids pass every former bound."""

import itertools

import pytest

from dialoom.plans import registry

KEYS = [7, 301, 2501, 3001, 70_001]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """lineitem with ids on both sides of 300, 2500, 3000 and 4000."""
    at = str(tmp_path_factory.mktemp("whole"))
    rows = [(k, i, (k * 7 + i * i) % 23, (k + 2 * i) % 11, i / 100, (k + i) % 9 / 100) for k in KEYS for i in range(1, 5)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_tax double"
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/lineitem.parquet")
    return at, rows


def distance(edges, fewer):
    """Least edits from a graph to one of its own subgraphs, over all placements of its nodes."""
    a, b = sorted({x for e in edges for x in e}), sorted({x for e in edges for x in e})
    best = len(a) + len(b) + len(edges) + len(fewer)
    for to in itertools.permutations([*b, *[None] * len(a)], len(a)):
        at = dict(zip(a, to, strict=True))
        moved = {(at[x], at[y]) for x, y in edges if at[x] is not None and at[y] is not None}
        lost = sum(at[x] is None or at[y] is None for x, y in edges)
        nodes = sum(x != y for x, y in at.items()) + sum(y not in at.values() for y in b)
        best = min(best, nodes + lost + len(moved ^ set(fewer)))
    return best


def test_edit_distance_of_every_graph(spark, sf):
    at, rows = sf
    got = {r.g: r.distance for r in registry.queries()["grf04_edit_distance"](spark, at).collect()}
    want = {}
    for k in KEYS:
        edges = sorted({(f"N{p % 4}", f"N{(p + i) % 5}") for key, i, p, *_ in rows if key == k})
        size = len({x for e in edges for x in e}) + len(edges)
        want[k] = min(distance(edges, edges[:-1]) / size, 1.0)
    assert got == pytest.approx(want)


def test_bootstrap_over_every_delta(spark, sf):
    at, rows = sf
    got = {r.g: r for r in registry.queries()["mth05_bootstrap"](spark, at).collect()}
    deltas = {g: [float(round(x * 10 - t * 10)) for *_, s, x, t in rows if s % 3 == g] for g in range(3)}
    assert {g: r["mean"] for g, r in got.items()} == pytest.approx({g: sum(v) / len(v) for g, v in deltas.items()})
    assert all(min(deltas[g]) <= r.low <= r["mean"] <= r.high <= max(deltas[g]) for g, r in got.items())


def test_runs_of_every_source(spark, tmp_path):
    rows = [(i, f"src{i % 3}", "aab"[i // 3 % 3]) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.source, r.run) for r in registry.queries()["win15_runs_by_source"](spark, str(tmp_path)).collect()}
    last, run, want = {}, dict.fromkeys(["src0", "src1", "src2"], 0), {}
    for i, source, lang in rows:
        run[source] += last.get(source) != lang
        last[source] = lang
        want[i] = (source, run[source])
    assert got == want
