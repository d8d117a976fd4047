"""Queries on calls, graphs, validators, paired statistics and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions import graphs, jsonvalue, stats
from dialoom.functions import truth as truths
from dialoom.operators import vectors
from dialoom.plans.base import Plans
from dialoom.sources import table

P = Plans()

# A call a line item; the prediction differs in every third name and every fourth argument and carries an extra one.
_CALLS = """SELECT l_orderkey AS k, l_linenumber AS i, 't' || CAST(l_linenumber AS STRING) AS name, CASE WHEN l_partkey % 3 = 0 THEN 'tx' ELSE 't' || CAST(l_linenumber AS STRING) END AS pname,
  CAST(l_quantity AS INT) AS q, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END AS pq FROM {lineitem}"""


def _calls(spark, d):
    """One row an order: true and predicted calls as structs."""
    rows = spark.sql(_CALLS, lineitem=table(spark, d, "lineitem"))
    text = lambda n, q, extra: F.concat(F.lit('{"name": "'), n, F.lit('", "arguments": {"q": '), q, F.lit(extra + "}}"))
    rows = rows.select("k", "i", jsonvalue.tool_call(text(F.col("name"), F.col("q").cast("string"), "")).alias("t"), jsonvalue.tool_call(text(F.col("pname"), F.concat(F.col("pq").cast("string"), F.lit(".0")), ', "z": [1]')).alias("p"))
    both = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "t", "p")), lambda a, b: a["i"] - b["i"]).alias("m"))
    return both.select("k", F.transform("m", lambda m: m["t"]).alias("true"), F.transform("m", lambda m: m["p"]).alias("pred"))


def _over_calls(body: str) -> str:
    return "WITH c AS (" + _CALLS.replace("{lineitem}", "lineitem") + ") " + body


@P.query("scr05_ast_f1", _over_calls("SELECT k, avg((name = pname AND q = pq)::INT)::DOUBLE AS f1 FROM c GROUP BY k"))
def _(spark, d):
    return _calls(spark, d).select("k", jsonvalue.ast_f1(F.col("pred"), F.col("true")).alias("f1"))


@P.query("scr05_graded_f1", _over_calls("SELECT k, avg(CASE WHEN name <> pname THEN 0 WHEN q = pq THEN 1 ELSE 0.4 END)::DOUBLE AS f1 FROM c GROUP BY k"))
def _(spark, d):
    return _calls(spark, d).select("k", jsonvalue.graded_f1(F.col("pred"), F.col("true")).alias("f1"))


@P.query("agg02_tool_rollup", _over_calls("SELECT avg(f1) AS f1, avg(named) AS named FROM (SELECT k, avg((name = pname AND q = pq)::INT)::DOUBLE AS f1, avg((name = pname)::INT)::DOUBLE AS named FROM c GROUP BY k)"))
def _(spark, d):
    named = F.aggregate(F.zip_with("pred", "true", lambda p, t: (p["name"] == t["name"]).cast("double")), F.lit(0.0), lambda a, x: a + x) / F.size("true")
    return _calls(spark, d).select(jsonvalue.ast_f1(F.col("pred"), F.col("true")).alias("f1"), named.alias("named")).agg(F.avg("f1").alias("f1"), F.avg("named").alias("named"))


@P.query("jsn05_subtree", _over_calls("SELECT k, i, name = pname AND q = pq AS hit FROM c"))
def _(spark, d):
    pairs = _calls(spark, d).select("k", F.posexplode(F.arrays_zip("true", "pred")).alias("i", "z"))
    return pairs.select("k", (F.col("i") + 1).alias("i"), jsonvalue.subtree_match(F.col("z.pred"), F.col("z.true")).alias("hit")).join(
        spark.sql(_CALLS, lineitem=table(spark, d, "lineitem")).select("k", F.col("i").alias("n"), F.row_number().over(Window.partitionBy("k").orderBy("i")).alias("r")), "k"
    ).filter("i = r").select("k", F.col("n").alias("i"), "hit")


@P.query("jsn03_deep_equal", "SELECT event_id, (props::JSON->>'k')::DOUBLE = (event_id % 10) AS same FROM events")
def _(spark, d):
    other = F.concat(F.lit('{ "k" : '), (F.col("event_id") % 10).cast("string"), F.lit(".0 }"))
    return table(spark, d, "events").select("event_id", (jsonvalue.canonical_text(F.col("props")) == jsonvalue.canonical_text(other)).alias("same"))


@P.query("jsn04_canonical", "SELECT event_id, '{\"a\":1,\"k\":' || (props::JSON->>'k') || '}' AS canon FROM events")
def _(spark, d):
    text = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": true}'))
    return table(spark, d, "events").select("event_id", jsonvalue.canonical_text(text).alias("canon"))


@P.query("jsn06_leaves", "SELECT event_id, (props::JSON->>'k') AS leaf FROM events UNION ALL SELECT event_id, 'x' FROM events")
def _(spark, d):
    text = F.concat(F.lit('{"a": ["x"], "b": '), F.col("props"), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.explode(jsonvalue.leaf_texts(text)).alias("leaf"))


@P.query("jsn07_propagated", "SELECT event_id, (props::JSON->>'k')::INT = event_id % 10 AS used FROM events")
def _(spark, d):
    args = F.concat(F.lit('{"id": ['), (F.col("event_id") % 10).cast("string"), F.lit("]}"))
    return table(spark, d, "events").select("event_id", F.arrays_overlap(jsonvalue.leaf_texts(F.col("props")), jsonvalue.leaf_texts(args)).alias("used"))


@P.query("jsn01_embedded_object", "SELECT event_id, '{\"k\": ' || (props::JSON->>'k') || '}' AS found FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", jsonvalue.embedded_object(F.concat(F.lit("so {x "), F.col("props"), F.lit(" } tail"))).alias("found"))


@P.query("jsn08_required_args", "SELECT p_brand, min(p_size) AS least, count(*) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand")
def _(spark, d):
    sizes = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("sizes"))
    as_map = sizes.agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "sizes"))).alias("m"))  # one entry a brand
    return as_map.select(F.explode("m").alias("p_brand", "sizes")).select("p_brand", F.array_min("sizes").alias("least"), F.size("sizes").cast("long").alias("n"))


_TYPES = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"a\": {\"b\": 1}}' WHEN event_id % 3 = 1 THEN '{\"a\": {\"b\": 1.5}}' ELSE '{\"a\": {\"b\": 2, \"c\": [null]}}' END AS j FROM events"


@P.query("prj13_type_survey", """SELECT * FROM (VALUES ('a', 'dict'), ('a.b', 'x')) v(path, k) WHERE false UNION ALL SELECT path, kind || ':' || n AS k FROM (
  SELECT 'a' AS path, 'dict' AS kind, count(*) AS n FROM events UNION ALL SELECT 'a.b', 'int', count(*) FILTER (WHERE event_id % 3 <> 1) FROM events UNION ALL SELECT 'a.b', 'float', count(*) FILTER (WHERE event_id % 3 = 1) FROM events
  UNION ALL SELECT 'a.c', 'list', count(*) FILTER (WHERE event_id % 3 = 2) FROM events UNION ALL SELECT 'a.c.[]', 'null', count(*) FILTER (WHERE event_id % 3 = 2) FROM events)""")
def _(spark, d):
    rows = spark.sql(_TYPES.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    paths = rows.select(F.inline(jsonvalue.typed_paths(F.col("j"))))
    return paths.groupBy("path", "kind").agg(F.count("*").alias("n")).select("path", F.concat_ws(":", "kind", F.col("n").cast("string")).alias("k"))


@P.query("prj13_canonical_types", "SELECT 'a.b' AS path, 'float' AS kind FROM (SELECT 1) WHERE (SELECT count(*) FROM events) > 3")
def _(spark, d):
    rows = spark.sql(_TYPES.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    paths = rows.select(F.inline(jsonvalue.typed_paths(F.col("j"))))
    return vectors.canonical_kinds(paths)


_SCHEMAS = '[{"function": {"name": "log", "parameters": {"required": ["id"]}}}, {"name": "rate", "parameters": {"required": ["score"]}}]'
_TRUTHS = (  # two of them are made up: a placeholder where an id is required, a score of 11
    '{"name": "log", "arguments": {"id": " N/A ", "region": "x"}}', '{"name": "log", "arguments": {"id": "A1", "region": "unknown"}}', '{"name": "rate", "arguments": {"Score": 11}}',
    '{"name": "rate", "arguments": {"score": true}}', '{"name": "rate", "arguments": {"score": 9.5, "id": "0000"}}', '{"name": "other", "arguments": {"id": "none"}}',
)


@P.query("flt09_null_sentinels", "SELECT event_id, 2 - (event_id % 6 IN (0, 2))::INT - ((event_id + 1) % 6 IN (0, 2))::INT AS n_kept, CASE event_id % 6 WHEN 0 THEN 'log' WHEN 1 THEN 'log' WHEN 2 THEN 'rate' WHEN 3 THEN 'rate' WHEN 4 THEN 'rate' ELSE 'other' END AS first_kept FROM events")
def _(spark, d):
    truth = lambda shift: F.get(F.array(*map(F.lit, _TRUTHS)), ((F.col("event_id") + shift) % len(_TRUTHS)).cast("int"))
    kept = truths.sane_calls(F.concat(F.lit("["), truth(0), F.lit(","), truth(1), F.lit("]")), F.lit(_SCHEMAS))
    return table(spark, d, "events").select("event_id", F.size(kept).alias("n_kept"), F.get(kept, 0)["name"].alias("first_kept"))


@P.query("flt10_placeholder_args", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE '{\"k\":' || (props::JSON->>'k') || '}' END AS args FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, '{"placeholder": "value"}').otherwise(F.col("props"))
    canon = jsonvalue.canonical_text(raw)
    return table(spark, d, "events").select("event_id", F.when(canon == '{"placeholder":"value"}', "{}").otherwise(canon).alias("args"))


# Graphs: an order is a graph over N0..N6 whose edges come from its lines.
_EDGES = "SELECT l_orderkey AS g, 'N' || CAST(l_partkey % 4 AS STRING) AS src, 'N' || CAST((l_partkey + l_linenumber) % 5 AS STRING) AS dst, l_linenumber AS i FROM {lineitem}"


def _graphs(spark, d):
    rows = spark.sql(_EDGES, lineitem=table(spark, d, "lineitem"))
    edges = rows.groupBy("g").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    ends = lambda k: F.transform("edges", lambda e: e[k])
    return edges.withColumn("nodes", F.array_sort(F.array_distinct(F.concat(ends("src"), ends("dst")))))


def _over_edges(body: str) -> str:
    text = _EDGES.replace("{lineitem}", "lineitem")
    return f"WITH RECURSIVE e AS (SELECT DISTINCT g, src, dst FROM ({text})), n AS (SELECT g, src AS x FROM e UNION SELECT g, dst FROM e), r AS (SELECT g, 'N0' AS x FROM (SELECT DISTINCT g FROM e) UNION SELECT e.g, e.dst FROM r JOIN e ON r.g = e.g AND r.x = e.src), b AS (SELECT g, 'N4' AS x FROM (SELECT DISTINCT g FROM e) UNION SELECT e.g, e.src FROM b JOIN e ON b.g = e.g AND b.x = e.dst) " + body


@P.query("grf02_valid", _over_edges("""SELECT g, EXISTS (SELECT 1 FROM n WHERE n.g = q.g AND x = 'N0') AND EXISTS (SELECT 1 FROM n WHERE n.g = q.g AND x = 'N4') AND EXISTS (SELECT 1 FROM r WHERE r.g = q.g AND x = 'N4')
  AND NOT EXISTS (SELECT 1 FROM n WHERE n.g = q.g AND x NOT IN (SELECT x FROM r WHERE r.g = q.g) AND x NOT IN (SELECT x FROM b WHERE b.g = q.g)) AS valid FROM (SELECT DISTINCT g FROM e) q"""))
def _(spark, d):
    return _graphs(spark, d).select("g", graphs.is_valid(F.col("nodes"), F.col("edges"), F.lit("N0"), F.array(F.lit("N4"))).alias("valid"))


@P.query("grf03_terminal_reached", _over_edges("SELECT g, EXISTS (SELECT 1 FROM r WHERE r.g = q.g AND x = 'N4') AS reached FROM (SELECT DISTINCT g FROM e) q"))
def _(spark, d):
    return _graphs(spark, d).select("g", graphs.terminals_reached(F.col("nodes"), F.col("edges"), F.lit("N0"), F.array(F.lit("N4"))).alias("reached"))


@P.query("grf05_back_edges", _over_edges("SELECT g, count(*) AS n FROM e WHERE dst < src GROUP BY g"))
def _(spark, d):
    return _graphs(spark, d).select("g", F.size(graphs.back_edges(F.col("nodes"), F.col("edges"))).cast("long").alias("n")).filter("n > 0")


_WAYS = "(SELECT DISTINCT g, src, dst, i % 3 AS p FROM (" + _EDGES.replace("{lineitem}", "lineitem") + "))"


@P.query("grf06_lint", _over_edges(f"""SELECT g, 'self_loop:' || src AS defect FROM e WHERE src = dst UNION ALL SELECT g, 'no_way_out:' || x FROM n WHERE x <> 'N4' AND (g, x) NOT IN (SELECT g, src FROM e)
  UNION ALL SELECT g, 'duplicate_priorities:' || src FROM {_WAYS} GROUP BY g, src HAVING count(*) > count(DISTINCT p) UNION ALL SELECT g, 'bad_name:n1' FROM n WHERE x = 'N1' AND g % 7 = 0
  UNION ALL SELECT g, 'duplicate_name' FROM n WHERE g % 11 = 0 AND x IN ('N2', 'N3') GROUP BY g HAVING count(*) = 2
  UNION ALL SELECT g, 'invalid' FROM n GROUP BY g HAVING NOT (bool_or(x = 'N0') AND bool_or(x = 'N4') AND bool_or(x = 'N4' AND (g, x) IN (SELECT g, x FROM r)) AND bool_and((g, x) IN (SELECT g, x FROM r) OR (g, x) IN (SELECT g, x FROM b)))"""))
def _(spark, d):
    rows = spark.sql(_EDGES, lineitem=table(spark, d, "lineitem"))
    ways = rows.groupBy("g").agg(F.array_sort(F.collect_set(F.struct("src", "dst", (F.col("i") % 3).cast("int").alias("priority")))).alias("ways"))
    ids = F.array_distinct(F.flatten(F.transform("ways", lambda e: F.array(e["src"], e["dst"]))))
    name = lambda n: F.when((n == "N1") & (F.col("g") % 7 == 0), "n1").when((n == "N3") & (F.col("g") % 11 == 0), "N2").otherwise(n)
    nodes = F.transform(ids, lambda n: F.struct(n.alias("id"), name(n).alias("name")))
    return ways.select("g", F.explode(graphs.lint(nodes, F.col("ways"), F.lit("N0"), F.array(F.lit("N4")))).alias("defect"))


@P.query("grf08_legality", _over_edges("SELECT g, count(*) FILTER (WHERE a = b OR EXISTS (SELECT 1 FROM e WHERE e.g = q.g AND e.src = a AND e.dst = b)) AS legal FROM (SELECT DISTINCT g FROM e) q, (VALUES ('N0', 'N1'), ('N2', 'N2'), ('N3', 'N4')) v(a, b) GROUP BY g"))
def _(spark, d):
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in (("N0", "N1"), ("N2", "N2"), ("N3", "N4"))])
    return _graphs(spark, d).select("g", F.size(F.filter(pairs, lambda p: graphs.is_legal(p, F.col("edges")))).cast("long").alias("legal"))


@P.query("grf10_tool_placement", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier) s WHERE s.s_suppkey = l_suppkey AND s_nationkey < p_size % 25)")
def _(spark, d):
    called = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    allowed = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return called.join(allowed, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") < F.col("p_size") % 25), "left_anti").select("l_orderkey", "l_linenumber")


@P.query("grf04_edit_distance")
def _(spark, d):
    g = _graphs(spark, d)
    fewer = F.slice("edges", 1, F.greatest(F.size("edges") - 1, F.lit(0)))
    return g.select("g", graphs.normalised_edit_distance(F.col("nodes"), F.col("edges"), F.col("nodes"), fewer).alias("distance"))


@P.query("str17_mermaid", _over_edges("SELECT g, 'graph TD' || chr(10) || string_agg('  ' || src || ' --> ' || dst, chr(10) ORDER BY src, dst) AS text FROM e GROUP BY g"))
def _(spark, d):
    return _graphs(spark, d).select("g", graphs.mermaid(F.col("edges")).alias("text"))


@P.query("val01_workflow", _over_edges("SELECT g, (CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.g = q.g AND x = 'N0') THEN 'no initial;' ELSE '' END) || (CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.g = q.g AND x = 'N4') THEN 'no terminal;' ELSE '' END) || (CASE WHEN g % 11 = 0 THEN 'bad level;' ELSE '' END) AS errors FROM (SELECT DISTINCT g FROM e) q"))
def _(spark, d):
    level = F.when(F.col("g") % 11 == 0, "L9").otherwise("L1")
    errors = [F.when(~F.array_contains("nodes", "N0"), "no initial;"), F.when(~F.array_contains("nodes", "N4"), "no terminal;"), F.when(~level.isin("L1", "L2", "L3", "L4", "L5"), "bad level;")]
    return _graphs(spark, d).select("g", F.array_join(F.array_compact(F.array(*errors)), "").alias("errors"))


_DELTA = "SELECT CAST(l_suppkey % 3 AS INT) AS g, round(l_discount * 10 - l_tax * 10) AS delta FROM {lineitem}"


def _deltas(spark, d):
    return spark.sql(_DELTA, lineitem=table(spark, d, "lineitem"))


def _over_deltas(body: str) -> str:
    return "WITH x AS (" + _DELTA.replace("{lineitem}", "lineitem") + ") " + body


@P.query("mth07_paired_t", _over_deltas("SELECT g, count(*) AS n, avg(delta) / (stddev_samp(delta) / sqrt(count(*))) AS t FROM x GROUP BY g"))
def _(spark, d):
    return stats.paired_t(_deltas(spark, d), ["g"], "delta").select("g", "n", "t")


@P.query("mth07_wilcoxon", _over_deltas("""SELECT g, count(*) AS n, least(sum(rank) FILTER (WHERE delta > 0), sum(rank) FILTER (WHERE delta < 0))::DOUBLE AS w FROM (
  SELECT g, delta, avg(r) OVER (PARTITION BY g, abs(delta)) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(delta)) AS r FROM x WHERE delta <> 0)) GROUP BY g"""))
def _(spark, d):
    return stats.wilcoxon(_deltas(spark, d), ["g"], "delta").select("g", "n", "w")


@P.query("mth05_sign_test", "SELECT w, l, least(1, 2 * p)::DOUBLE AS p FROM (VALUES (0, 0, 0.5), (3, 1, 5 / 16), (5, 0, 1 / 32), (2, 2, 11 / 16)) v(w, l, p)")
def _(spark, d):
    rows = spark.createDataFrame([(0, 0), (3, 1), (5, 0), (2, 2)], "w int, l int")
    return rows.select("w", "l", stats.sign_test(F.col("w"), F.col("l")).alias("p"))


@P.query("mth05_bootstrap")
def _(spark, d):
    return stats.bootstrap_mean(_deltas(spark, d), "g", "delta", 2000)


@P.query("srt15_ffd_packing", "SELECT sum(n)::BIGINT AS items, sum(n * (p_size + 1))::BIGINT AS used FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size)")
def _(spark, d):
    packed = vectors.ffd_bins(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 101, 1)
    bins = packed.groupBy("bin").agg(F.count("*").alias("n"), F.sum("p_size").alias("s"))
    return bins.filter((F.col("s") + F.col("n") - 1) <= 101).agg(F.sum("n").alias("items"), F.sum(F.col("s") + F.col("n")).alias("used"))


@P.query("vec01_codebook")
def _(spark, d):
    book = vectors.lloyd_max(64, 3)
    return table(spark, d, "embeddings").select("vec_id", vectors.encode(vectors.unit(F.col("embedding")), book).alias("codes"))


@P.query("vec02_rotation_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def _(spark, d):
    turned = vectors.rotated(F.col("embedding"), vectors.rotation(64, 3))
    norm = F.sqrt(F.aggregate(turned, F.lit(0.0), lambda a, x: a + x * x))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm, 4).alias("norm"))


@P.query("vec04_nuq_codebook")
def _(spark, d):
    values = table(spark, d, "embeddings").select(F.explode("embedding").alias("x")).select(F.col("x").cast("double").alias("x"))
    return vectors.nuq_codebook(values, "x", 8)


@P.query("gen02_weighted_draws", "SELECT i, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS pick FROM (SELECT i, ('0x' || substr(md5('11|' || i), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM range(1000) t(i))")
def _(spark, d):
    return spark.range(1000).select(F.col("id").alias("i"), vectors.weighted_draw(F.col("id"), 11, {"a": 0.5, "b": 0.3, "c": 0.2}).alias("pick"))


@P.query("gen01_conversations", "SELECT i AS sample, t AS turn, CASE WHEN t % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM (SELECT i, 2 + ('0x' || substr(md5('4|' || i), 1, 8))::UBIGINT % 5 AS n FROM range(200) r(i)), range(8) s(t) WHERE t < n")
def _(spark, d):
    n = 2 + F.conv(F.substring(F.md5(F.concat(F.lit("4|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % 5
    rows = spark.range(200).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("turn"))
    return rows.select("sample", F.col("turn").cast("long").alias("turn"), F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"))


QUERIES, ORACLE = P.queries, P.oracle
