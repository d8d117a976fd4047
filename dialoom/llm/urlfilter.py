"""URL filtering with block decisions that follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.components import connected_components
from dialoom.llm.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1000  # rules are literals of the plan; a longer list is refused


class Rule(NamedTuple):
    """A host (with its subdomains), a path prefix and ``allow`` or ``block``."""

    host: str
    path: str
    verdict: str


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = []
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found.append(F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` segments resolved; a path without a leading slash gets one."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    last = F.element_at(parts, -1)
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    folder = last.isin(".", "..") & (F.size(walked) > 0)
    return F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(folder, "/").otherwise(""))


def url_node(url: Column) -> Column:
    """Identity of a page: host, path and query; null without ``://``.

    Scheme, fragment and the scheme's own port do not count, an empty path is ``/`` and dot
    segments are resolved.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    port = F.when(url.rlike("(?i)^https:"), ":443").otherwise(":80")
    host = url_host(url)
    plain = F.regexp_replace(host, F.concat(port, F.lit("$")), F.lit(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(plain, without_dots(url_path(url)), query))


def decoded(text: Column) -> Column:
    """Character references that URLs hold, resolved: numeric ones of ASCII and the five named ones of markup."""
    numeric = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(0)))
    code = lambda r: F.when(r.rlike("^&#[xX]"), F.conv(F.regexp_extract(r, "[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(r, "([0-9]+)", 1)).cast("int")
    plain = F.aggregate(numeric, text, lambda done, r: F.when(code(r).between(33, 126), F.replace(done, r, F.char(code(r)))).otherwise(done))
    for name, value in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(value))
    return plain


def resolved(base: Column, to: Column) -> Column:
    """A link's target as an absolute URL; null if it does not lead to a page (another scheme, a fragment)."""
    scheme = F.lower(F.regexp_extract(base, r"(?s)^(.*?)://", 1))
    root = F.concat(scheme, F.lit("://"), url_host(base))
    path = url_path(base)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(to.rlike(r"(?i)^https?://"), to)
        .when((to == "") | to.startswith("#") | to.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(root, path, to))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), to))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not; empty if the tag has none."""
    value = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.btrim(F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)]), F.lit(" \t\r\n\f"))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes: a page and the target of its canonical link or refresh redirect.

    Comments, scripts, styles and templates do not count. Targets are taken relative to the
    page's URL; character references in them are resolved. A null url or html has no links.
    """
    shown = F.col("html")
    for hidden in ("<!--.*?-->", r"<script\b.*?</script\s*>", r"<style\b.*?</style\s*>", r"<template\b.*?</template\s*>"):
        shown = F.regexp_replace(shown, f"(?is){hidden}", "")
    tags = F.regexp_extract_all(shown, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")),
        lambda t: _attribute(t, "href"),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike("(?i)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh")),
        lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?["']?\s*([^"'\s]+)""", 1),
    )
    linked = F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b")
    found = pages.filter(F.contains("url", F.lit("://")) & linked).select(
        "url", F.explode(F.filter(F.concat(canonical, refresh), lambda t: t != "")).alias("_to")
    )
    target = resolved(F.col("url"), decoded(F.col("_to")))
    return found.select(url_node(F.col("url")).alias("src"), url_node(target).alias("dst"))


def blocked_aliases(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Nodes (node) of components in which a rule blocks some member."""
    members = connected_components(edges)
    as_url = F.concat(F.lit("http://"), "node")
    match = matched_rule(url_host(as_url), url_path(as_url), rules)["verdict"]
    bad = stored(members.filter(match == "block").select("component").distinct(), "blocked")
    return members.join(bad, "component", "left_semi").select("node")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A rule that fits the page itself decides, so an explicit allow is never overruled. A page
    without a rule is blocked if a redirect or canonical chain, in either direction and of any
    length, ties it to a URL that a rule blocks; else it is allowed. ``redirects`` (src, dst URLs)
    adds known redirects. Null or malformed URLs have empty host and path and no aliases. Rows
    that repeat a page_id or url are judged one by one, and each one's links count; other columns
    than page_id, url and html are ignored.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(url_node(F.col("src")), url_node(F.col("dst"))))
    aliases = stored(blocked_aliases(edges, rules), "aliases").select(F.col("node").alias("_node"), F.lit(True).alias("_bad"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = pages.select(
        "page_id", host.alias("host"), path.alias("path"), matched_rule(host, path, rules).alias("_m"), url_node(F.col("url")).alias("_node")
    )
    verdict = F.coalesce(F.col("_m.verdict"), F.when(F.col("_bad"), "block").otherwise("allow"))
    return judged.join(aliases, "_node", "left").select("page_id", "host", "path", F.col("_m.rule").alias("rule"), verdict.alias("verdict"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url ELSE '' END AS u FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(h, s, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT page_id, host, path, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v
  FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id, host, path)
SELECT q.page_id, q.host, q.path, best.rule, coalesce(best.v, 'allow') AS verdict
FROM q LEFT JOIN best ON q.page_id = best.page_id AND q.host = best.host AND q.path = best.path
"""
