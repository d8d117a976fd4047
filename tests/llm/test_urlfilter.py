import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.llm import components, urlfilter

PAGES = "page_id long, url string, html string"


def judge(spark, rows, **more):
    frame = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("h"), "rule": F.lit("r"), "node": F.lit("n"), "src": F.lit(1)})
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(frame, urlfilter.RULES, **more).collect()}


def test_rules_hosts_and_paths(spark):
    got = judge(spark, [
        (1, "http://WWW.Example.COM/en/a?x#y", None), (2, "https://example.com/en/", ""), (3, "https://a.net/es/1", ""), (4, "https://net/fr/", ""),
        (5, "https://a.org/en/", ""), (6, None, None), (7, "no scheme", ""), (8, "x://a.com", ""), (9, "x://a.com?q=/en/", ""), (10, "u://É.COM/en/\n", ""), (11, "a://b://c.com/", ""), (12, "", ""), (13, "http://xnet/es/", ""),
    ])
    assert got == {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("example.com", "/en/", "example.com/en/", "block"), 3: ("a.net", "/es/1", "net/es/", "block"),
        4: ("net", "/fr/", "net/fr/", "block"), 5: ("a.org", "/en/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("a.com", "", None, "allow"),
        9: ("a.com", "", None, "allow"), 10: ("É.com", "/en/\n", "com/", "allow"), 11: ("b:", "//c.com/", None, "allow"), 12: ("", "", None, "allow"), 13: ("xnet", "/es/", None, "allow"),
    }


def test_blocks_follow_links_and_allow_stands(spark):
    link = '<LINK href="{}" rel=canonical>'
    rows = [
        (1, "http://a.org/1", link.format("http://b.org/2#top")), (2, "https://b.org/2", '<meta http-equiv="refresh" content="0; url=http://c.net/es/3">'),
        (3, "http://d.com/4", link.format("http://a.org/1")), (4, "http://e.org/5", link.format("/6")), (5, "http://e.org/6", ""), (6, "http://e.org/x/7", link.format("../x/7")), (7, "http://f.org/9", ""),
    ]
    got = {k: v[3] for k, v in judge(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    redirects = spark.createDataFrame([("http://f.org/9", "http://b.org/2"), ("http://e.org/6", None)], "src string, dst string")
    assert {k: v[3] for k, v in judge(spark, rows, redirects=redirects).items()}[7] == "block"


def test_relative_targets(spark):
    rows = [(1, "http://h.org/a/b", '<link rel="canonical" href="c">'), (2, "http://h.org/a/b2", "<link rel='canonical' href='//i.org/z'>"), (3, "http://h.org", '<link rel="canonical" href="c">')]
    edges = {tuple(r) for r in urlfilter.link_edges(spark.createDataFrame(rows, PAGES)).collect()}
    assert edges == {("h.org/a/b", "h.org/a/c"), ("h.org/a/b2", "i.org/z"), ("h.org/", "h.org/c")}


def test_targets_of_odd_links(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    cases = [
        ("http://a.org", canonical("http://a.org/"), None), ("http://a.org/p", canonical("http://c.org/q?a=1&amp;b=2"), "c.org/q?a=1&b=2"),
        ("http://h.org/a/b/c", canonical("../d"), "h.org/a/d"), ("http://h.org/a/b", canonical("?x=2"), "h.org/a/b?x=2"), ("http://h.org/a/b", canonical("./../../e/."), "h.org/e/"),
        ("http://h.org/a", "<!-- " + canonical("http://net/es/1") + " -->", None), ("http://h.org/a", "<script>'" + canonical("/z") + "'</script>", None),
        ("https://h.org/a", canonical("https://h.org:443/z"), "h.org/z"), ("http://h.org/a", canonical("https://h.org:80/z"), "h.org:80/z"), ("http://h.org/a", canonical("&#x2F;&#122;"), "h.org/z"),
        ("http://h.org/a", canonical("#top"), None), ("http://h.org/a", canonical("javascript:void(0)"), None), ("http://h.org/a", canonical(""), None),
        ("http://h.org/a", "<link data-rel='canonical' href=/z>", None), ("http://h.org/a", "<LINK HREF=/z REL='alternate Canonical'", None), ("http://h.org/a", "<LINK HREF=/z REL='alternate Canonical'>", "h.org/z"),
        ("http://h.org/a", '<meta content="5;URL=\'z\'" http-equiv=Refresh>', "h.org/z"), ("http://h.org/a", '<meta http-equiv="refresh" content="5">', None), ("http://h.org/a", None, None),
    ]
    rows = [(i, url, html) for i, (url, html, _) in enumerate(cases)]
    for (i, url, html), (_, _, want) in zip(rows, cases, strict=True):
        got = [r.dst for r in urlfilter.link_edges(spark.createDataFrame([(i, url, html)], PAGES)).collect() if r.dst is not None and r.dst != r.src]
        assert got == ([want] if want else []), (url, html)


def test_judgements_against_a_walk_over_links(spark):
    rng = random.Random(5)
    hosts = ["a.org", "b.org", "c.net", "d.com", "e.example.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'x'])}/{i}" for i in range(60)]
    links = [(u, rng.choice(urls)) for u in urls if rng.random() < 0.6]
    rows = [(i, u, "".join(f'<link rel="canonical" href="{v}">' for s, v in links if s == u)) for i, u in enumerate(urls)]

    def rule(url):
        host, _, path = url.removeprefix("http://").partition("/")
        fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path), default=None)

    near = {u: {u} for u in urls}
    for a, b in links:
        near[a].add(b), near[b].add(a)
    want = {}
    for i, u in enumerate(urls):
        seen, todo = {u}, [u]
        while todo:
            for v in near[todo.pop()] - seen:
                seen.add(v), todo.append(v)
        own = rule(u)
        want[i] = own.verdict if own else "block" if any((r := rule(v)) and r.verdict == "block" for v in seen) else "allow"
    assert {k: v[3] for k, v in judge(spark, rows).items()} == want
    assert {"block", "allow"} == set(want.values())


def test_nothing(spark):
    assert judge(spark, []) == {}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(pairs or [], "src long, dst long")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert got == {x: find(x) for x in parent}


def test_long_path_and_hub(spark):
    path = [(i, i + 1) for i in range(60)]
    hub = [(1000, 2000 + i) for i in range(300)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(path + hub, "src long, dst long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[2000 + i] for i in range(300)} == {1000}
