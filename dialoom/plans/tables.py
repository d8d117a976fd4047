"""Queries on samples, splits, windows, latency reports, frontiers and dimension joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.operators import latency, sampling, vectors
from dialoom.plans.base import Plans
from dialoom.sources import table

P = Plans()


def _docs(spark, d):
    return table(spark, d, "documents")


@P.query("flt01_levels", "SELECT lang, count(*) AS kept FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def _(spark, d):
    return _docs(spark, d).filter(F.col("lang").isin("en", "fr")).groupBy("lang").agg(F.count("*").alias("kept"))


@P.query("flt02_provenance", "SELECT s AS source, count(*) AS n FROM (SELECT coalesce(nullif(CASE WHEN doc_id % 10 = 0 THEN '' ELSE source END, ''), '<missing>') AS s FROM documents) WHERE s NOT IN ('src1', 'src2') GROUP BY s")
def _(spark, d):
    s = F.coalesce(F.nullif(F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("source")), F.lit("")), F.lit("<missing>"))
    return _docs(spark, d).select(s.alias("source")).filter(~F.col("source").isin("src1", "src2")).groupBy("source").agg(F.count("*").alias("n"))


@P.query("flt12_disqualified", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    defects = table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.lit("toxic").alias("code"))
    return _docs(spark, d).join(defects.filter(F.col("code").startswith("tox")), "doc_id", "left_anti").select("doc_id")


@P.query("flt08_required_fields", "SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN 'missing lang;' ELSE '' END) || (CASE WHEN doc_id % 5 = 0 THEN 'missing source;' ELSE '' END) AS errors FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def _(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    errors = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c};")) for c in ("lang", "source")]))
    return rows.select("doc_id", F.array_join(errors, "").alias("errors")).filter("errors != ''")


@P.query("flt11_first_drop_reason", "SELECT doc_id, CASE WHEN length(text) < 100 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN contains(text, '!!') THEN 'noise' END AS reason FROM documents")
def _(spark, d):
    reason = F.when(F.length("text") < 100, "short").when(F.col("lang") != "en", "language").when(F.contains("text", F.lit("!!")), "noise")
    return _docs(spark, d).select("doc_id", reason.alias("reason"))


@P.query("agg17_drop_reasons", "SELECT CASE WHEN length(text) < 100 THEN 'short' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    reason = F.when(F.length("text") < 100, "short").when(F.col("lang") != "en", "language").otherwise("kept")
    return _docs(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@P.query("agg16_validation", "SELECT count(*) AS total, count(*) FILTER (WHERE length(text) >= 100) AS valid, count(*) FILTER (WHERE length(text) < 100) AS errors, count(*) FILTER (WHERE contains(text, '!!')) AS warnings FROM documents")
def _(spark, d):
    short = F.length("text") < 100
    return _docs(spark, d).agg(F.count("*").alias("total"), F.count_if(~short).alias("valid"), F.count_if(short).alias("errors"), F.count_if(F.contains("text", F.lit("!!"))).alias("warnings"))


@P.query("agg18_triage_sets", "SELECT lang, source, count(*) AS n, grouping(lang)::INTEGER AS gl, grouping(source)::INTEGER AS gs FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def _(spark, d):
    docs = _docs(spark, d)
    return spark.sql("SELECT lang, source, count(*) AS n, cast(grouping(lang) AS int) AS gl, cast(grouping(source) AS int) AS gs FROM {docs} GROUP BY GROUPING SETS ((lang), (source), ())", docs=docs)


@P.query("agg15_profile", "SELECT 'lang' AS what, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'length', (length(text) // 1000)::VARCHAR, count(*) FROM documents GROUP BY length(text) // 1000")
def _(spark, d):
    facts = F.array(F.struct(F.lit("lang").alias("what"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("what"), F.col("source").alias("value")), F.struct(F.lit("length").alias("what"), F.expr("cast(length(text) div 1000 AS string)").alias("value")))
    return _docs(spark, d).select(F.inline(facts)).groupBy("what", "value").agg(F.count("*").alias("n"))


@P.query("agg33_having", "SELECT doc_id, source FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) WHERE n >= 8")
def _(spark, d):
    return _docs(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("source", "lang"))).filter("n >= 8").select("doc_id", "source")


@P.query("agg37_distinct_counts", "SELECT lang, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def _(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("texts"), F.countDistinct("source").alias("sources"))


@P.query("agg35_max_per_key", "SELECT source, max(n_chars) AS most FROM documents GROUP BY source")
def _(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.max("n_chars").alias("most"))


@P.query("win03_keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, d):
    return sampling.keep_first(_docs(spark, d).select("doc_id", F.sha2("text", 256).alias("k")), ["k"], ["doc_id"]).select("doc_id")


@P.query("win04_rename_repeats", "SELECT doc_id, source || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)")
def _(spark, d):
    return sampling.rename_repeats(_docs(spark, d).select("doc_id", "source"), "source", ["doc_id"])


@P.query("win16_first_mention", "SELECT source, row_number() OVER (ORDER BY f) AS ordinal FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)")
def _(spark, d):
    firsts = _docs(spark, d).groupBy("source").agg(F.min("doc_id").alias("f"))
    return firsts.select("source", F.row_number().over(Window.orderBy("f")).cast("long").alias("ordinal"))


@P.query("agg36_first_seen_sets", "SELECT lang, string_agg(source, ',' ORDER BY f) AS sources FROM (SELECT lang, source, min(doc_id) AS f FROM documents GROUP BY lang, source) GROUP BY lang")
def _(spark, d):
    firsts = _docs(spark, d).groupBy("lang", "source").agg(F.min("doc_id").alias("f"))
    return firsts.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "source"))), lambda x: x["source"]), ",").alias("sources"))


@P.query("win15_runs_by_source", "SELECT source, doc_id, sum(CASE WHEN p IS NULL OR p <> lang THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS run FROM (SELECT source, doc_id, lang, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents)")
def _(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = _docs(spark, d).withColumn("p", F.lag("lang").over(w))
    return rows.select("source", "doc_id", F.sum(F.when(F.col("p").isNull() | (F.col("p") != F.col("lang")), 1).otherwise(0)).over(w).alias("run"))


@P.query("srt05_reserved_share", "SELECT f FROM (SELECT f, row_number() OVER (ORDER BY md5('7|' || f), f) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT md5(text) AS f FROM documents)) WHERE r <= greatest(1, round_even(n * 0.1, 0))")
def _(spark, d):
    return sampling.reserve_share(_docs(spark, d).select(F.md5("text").alias("f")), "f", 0.1, 7)


@P.query("srt06_stratified", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3|' || doc_id), doc_id) AS r FROM documents) WHERE r = 1")
def _(spark, d):
    return sampling.one_per_group(_docs(spark, d).select("doc_id", "source"), "source", "doc_id", 3)


@P.query("srt08_balanced", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('5|' || doc_id), doc_id) AS r FROM documents) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))")
def _(spark, d):
    return sampling.balance_to_scarcest(_docs(spark, d).select("doc_id", "lang"), "lang", "doc_id", 5)


@P.query("srt09_downsampled", "SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang = 'de' ORDER BY md5('9|' || doc_id), doc_id) AS r FROM documents) WHERE lang = 'de' OR r <= (SELECT round_even(count(*) * (0.6::DOUBLE / 0.4::DOUBLE), 0) FROM documents WHERE lang = 'de')")
def _(spark, d):
    return sampling.downsample_to_ratio(_docs(spark, d).select("doc_id", "lang"), F.col("lang") == "de", 0.4, "doc_id", 9).select("doc_id")


@P.query("srt10_oversampled", """WITH s AS (SELECT count(*) FILTER (WHERE lang = 'es') AS have, count(*) FILTER (WHERE lang <> 'es') AS other FROM documents), n AS (SELECT have, greatest(round_even(other * (0.4::DOUBLE / 0.6::DOUBLE), 0)::BIGINT - have, 0) AS need FROM s)
  SELECT doc_id, 1 + CASE WHEN lang = 'es' THEN need // have + CASE WHEN r <= need % have THEN 1 ELSE 0 END ELSE 0 END AS times FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang = 'es' ORDER BY md5('9|' || doc_id), doc_id) AS r FROM documents), n""")
def _(spark, d):
    return sampling.oversample_to_share(_docs(spark, d).select("doc_id", "lang"), F.col("lang") == "es", 0.4, "doc_id", 9).groupBy("doc_id").agg(F.count("*").alias("times"))


_SPLIT = "SELECT doc_id % 97 AS grp, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, lang AS domain FROM documents"


@P.query("srt03_split_defects", f"SELECT DISTINCT defect, item FROM (WITH r AS ({_SPLIT}) SELECT 'missing' AS defect, grp::VARCHAR AS item FROM r WHERE split IS NULL UNION ALL SELECT 'spans', grp::VARCHAR FROM r GROUP BY grp HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'leaked', grp::VARCHAR FROM r WHERE domain = 'es' AND split <> 'test')")
def _(spark, d):
    rows = spark.sql(_SPLIT.replace("documents", "{documents}"), documents=_docs(spark, d))
    return sampling.split_defects(rows, "grp", ["es"])


@P.query("srt13_top_n", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def _(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@P.query("srt17_first_under_cap", "SELECT f FROM (SELECT md5(text) AS f, n_chars FROM documents) WHERE n_chars <= 1500 ORDER BY f LIMIT 20")
def _(spark, d):
    return _docs(spark, d).filter("n_chars <= 1500").select(F.md5("text").alias("f")).orderBy("f").limit(20)


@P.query("set01_union_all", "SELECT doc_id, 0 AS file_rank FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'fr'")
def _(spark, d):
    part = lambda lang, k: _docs(spark, d).filter(F.col("lang") == lang).select("doc_id", F.lit(k).alias("file_rank"))
    return part("en", 0).unionByName(part("fr", 1))


@P.query("set03_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, d):
    return _docs(spark, d).select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@P.query("set05_bag_intersection", "SELECT doc_id, least(a, b) AS n FROM (SELECT doc_id, len(string_split(text, 'e')) - 1 AS a, len(string_split(text, 'a')) - 1 AS b FROM documents)")
def _(spark, d):
    n = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c)))
    return _docs(spark, d).select("doc_id", F.least(n("e"), n("a")).cast("long").alias("n"))


@P.query("join20_first_file_wins", "SELECT k, min_by(doc_id, doc_id % 3 * 1000000 + doc_id) AS doc_id FROM (SELECT doc_id, doc_id % 211 AS k FROM documents) GROUP BY k")
def _(spark, d):
    rows = _docs(spark, d).select("doc_id", (F.col("doc_id") % 211).alias("k"), (F.col("doc_id") % 3).alias("file_rank"))
    return sampling.keep_first(rows, ["k"], ["file_rank", "doc_id"]).select("k", "doc_id")


@P.query("join22_routing", "SELECT doc_id, coalesce(m, 'general') AS model FROM documents LEFT JOIN (VALUES ('en', 'm1'), ('fr', 'm2')) v(l, m) ON lang = l")
def _(spark, d):
    routes = spark.createDataFrame([("en", "m1"), ("fr", "m2")], "lang string, m string")
    return _docs(spark, d).join(F.broadcast(routes), "lang", "left").select("doc_id", F.coalesce("m", F.lit("general")).alias("model"))


@P.query("join23_reserved_semi", "SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) ORDER BY doc_id LIMIT 50")
def _(spark, d):
    prints = _docs(spark, d).select("doc_id", F.md5("text").alias("f"))
    return prints.join(prints.filter("doc_id % 3 = 0").select("f"), "f", "left_semi").select("doc_id").orderBy("doc_id").limit(50)


@P.query("join11_dimension", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def _(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    near = n.join(r.filter("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey)
    return c.join(near, c.c_nationkey == near.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))


@P.query("join14_grid", "SELECT r_name, l AS level FROM region CROSS JOIN (VALUES (1), (2), (4)) v(l)")
def _(spark, d):
    levels = spark.createDataFrame([(1,), (2,), (4,)], "level int")
    return table(spark, d, "region").select("r_name").crossJoin(levels)


_LAST_WINS = "SELECT l_orderkey AS insert_id, max_by(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS entry FROM lineitem GROUP BY l_orderkey"


@P.query("src10_ledger_last_wins", _LAST_WINS)
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("insert_id")).agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("entry"))


@P.query("join10_plan_ledger", "SELECT o_custkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY o_custkey HAVING count(*) = count(l_orderkey)")
def _(spark, d):
    ledger = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("found")).distinct()
    plans = table(spark, d, "orders").join(ledger, "o_orderkey", "left")
    return plans.groupBy("o_custkey").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("all_found")).filter("all_found").select("o_custkey")


def _events(spark, d):
    return table(spark, d, "events")


@P.query("agg08_latency", "SELECT event_type, avg(value) AS mean, median(value) AS median FROM events GROUP BY event_type")
def _(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.avg("value").alias("mean"), F.median("value").alias("median"))


_PCT = "SELECT event_type, list_sort(list(value))[greatest(1, floor(count(*) * 0.5::DOUBLE))::INT] AS p50, list_sort(list(value))[greatest(1, floor(count(*) * 0.95::DOUBLE))::INT] AS p95, list_sort(list(value))[greatest(1, floor(count(*) * 0.99::DOUBLE))::INT] AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type"


@P.query("agg09_percentiles", _PCT)
def _(spark, d):
    return latency.floor_percentiles(_events(spark, d), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@P.query("agg09_percentiles_small_groups", _PCT)
def _(spark, d):
    return _events(spark, d).filter("value IS NOT NULL").groupBy("event_type").agg(*[latency.floor_percentile("value", s).alias(n) for n, s in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@P.query("agg26_spread", "SELECT event_type, list_sort(list(value))[round_even(0.1::DOUBLE * (count(*) - 1), 0)::INT + 1] AS p10, list_sort(list(value))[round_even(0.9::DOUBLE * (count(*) - 1), 0)::INT + 1] AS p90, list_sort(list(value))[floor(0.9::DOUBLE * count(*))::INT + 1] AS i90 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def _(spark, d):
    return _events(spark, d).filter("value IS NOT NULL").groupBy("event_type").agg(latency.rounded_percentile("value", 0.1).alias("p10"), latency.rounded_percentile("value", 0.9).alias("p90"), latency.index_percentile("value", 0.9).alias("i90"))


@P.query("agg10_levels", "SELECT user_id % 8 AS level, count(*) AS n, avg((value > 20)::INT)::DOUBLE AS success, list_sort(list(value))[greatest(1, floor(count(*) * 0.95::DOUBLE))::INT] AS p95, sum(value) / 60 AS throughput FROM events GROUP BY user_id % 8")
def _(spark, d):
    return _events(spark, d).groupBy((F.col("user_id") % 8).alias("level")).agg(F.count("*").alias("n"), F.avg((F.col("value") > 20).cast("int")).alias("success"), latency.floor_percentile("value", 0.95).alias("p95"), (F.sum("value") / 60).alias("throughput"))


@P.query("agg11_quant_cells", "SELECT event_type, user_id % 3 AS method, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM events GROUP BY event_type, user_id % 3")
def _(spark, d):
    return _events(spark, d).groupBy("event_type", (F.col("user_id") % 3).alias("method")).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


@P.query("agg12_pivot", "SELECT event_type, coalesce(avg(value) FILTER (WHERE user_id % 4 = 0), 0) AS m0, coalesce(avg(value) FILTER (WHERE user_id % 4 = 1), 0) AS m1, coalesce(avg(value) FILTER (WHERE user_id % 4 = 9), 0) AS m9 FROM events GROUP BY event_type")
def _(spark, d):
    wide = _events(spark, d).withColumn("m", F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string"))).groupBy("event_type").pivot("m", ["m0", "m1", "m9"]).agg(F.avg("value"))
    return wide.fillna(0.0)


@P.query("agg13_needle_sets", "SELECT user_id % 4 AS len, event_type AS depth, avg((value > 20)::INT)::DOUBLE AS accuracy FROM events GROUP BY GROUPING SETS ((user_id % 4), (event_type), ())")
def _(spark, d):
    rows = _events(spark, d).select((F.col("user_id") % 4).alias("len"), F.col("event_type").alias("depth"), (F.col("value") > 20).cast("int").alias("hit"))
    return spark.sql("SELECT len, depth, avg(hit) AS accuracy FROM {rows} GROUP BY GROUPING SETS ((len), (depth), ())", rows=rows)


@P.query("agg14_longbench_rollup", "SELECT event_type AS category, user_id % 3 AS task, avg(value) AS mean FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def _(spark, d):
    rows = _events(spark, d).select(F.col("event_type").alias("category"), (F.col("user_id") % 3).alias("task"), "value")
    return rows.rollup("category", "task").agg(F.avg("value").alias("mean"))


@P.query("agg04_depth_rollup", "SELECT least(user_id % 7, 4) AS depth, count(*) AS n, avg((value > 10)::INT)::DOUBLE AS accuracy FROM events GROUP BY ROLLUP (least(user_id % 7, 4))")
def _(spark, d):
    rows = _events(spark, d).select(F.least(F.col("user_id") % 7, F.lit(4)).alias("depth"), (F.col("value") > 10).cast("int").alias("hit"))
    return rows.rollup("depth").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))


@P.query("agg34_perplexity", "SELECT event_type, exp(avg(value / 100)) AS ppl FROM events GROUP BY event_type")
def _(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.coalesce(F.exp(F.avg(F.col("value") / 100)), F.lit(float("inf"))).alias("ppl"))


_LEVELS = "SELECT event_type AS g, user_id % 12 AS level, avg(value) AS value FROM events GROUP BY event_type, user_id % 12"


def _levels(spark, d):
    return _events(spark, d).groupBy(F.col("event_type").alias("g"), (F.col("user_id") % 12).alias("level")).agg(F.avg("value").alias("value"))


@P.query("win07_stop_rule", f"""WITH l AS (SELECT *, value > 50 AS violated FROM ({_LEVELS})), m AS (SELECT *, violated AND lag(violated) OVER (PARTITION BY g ORDER BY level) AS twice FROM l)
  SELECT g, level, value, violated FROM m WHERE level <= coalesce((SELECT min(level) FROM m k WHERE k.g = m.g AND k.twice), 1000000)""")
def _(spark, d):
    return latency.stop_after_violations(_levels(spark, d).withColumn("violated", F.col("value") > 50), "g")


@P.query("win08_highest_within", f"WITH l AS ({_LEVELS}) SELECT g, coalesce(max(level) FILTER (WHERE value <= 1.02::DOUBLE * (SELECT min_by(value, level) FROM l k WHERE k.g = l.g)), 1) AS best FROM l GROUP BY g")
def _(spark, d):
    return latency.highest_within(_levels(spark, d), "g", 1.02)


@P.query("win10_trend_flag", "SELECT user_id, step, coalesce(r > lag(r, 4) OVER w AND h < lag(h) OVER w, false) AS flag FROM (SELECT user_id, event_id AS step, value AS r, value % 7 AS h FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY step)")
def _(spark, d):
    rows = _events(spark, d).select("user_id", F.col("event_id").alias("step"), F.col("value").alias("reward"), (F.col("value") % 7).alias("held_out"))
    return latency.rising_while_held_out_falls(rows, "user_id", 5).select("user_id", "step", "flag")


@P.query("win17_leg_halt", """WITH c AS (SELECT user_id % 5 AS leg, event_id AS pos, value > 70 AS failed FROM events), r AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE failed) OVER w AS b FROM c WINDOW w AS (PARTITION BY leg ORDER BY pos))
  SELECT leg, pos, failed FROM r WHERE pos <= coalesce((SELECT min(pos) FROM r k WHERE k.leg = r.leg AND n >= 10 AND b::DOUBLE / n > 0.2), 1000000000)""")
def _(spark, d):
    rows = _events(spark, d).select((F.col("user_id") % 5).alias("leg"), F.col("event_id").alias("pos"), (F.col("value") > 70).alias("failed"))
    return latency.halt_leg(rows, "leg", 10, 0.2)


@P.query("win19_running_depth", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def _(spark, d):
    first = _events(spark, d).agg(F.min("event_type").alias("event_type"))
    rows = _events(spark, d).join(F.broadcast(first), "event_type")
    return rows.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("depth"))


_POINTS = "SELECT l.doc_id, quality AS q, toxic AS t, (n_chars // 500)::INTEGER AS n FROM labels l JOIN documents d USING (doc_id)"


@P.query("join12_frontier", f"WITH p AS ({_POINTS}) SELECT doc_id, q, t, n FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.q >= a.q AND b.t <= a.t AND b.n <= a.n AND (b.q > a.q OR b.t < a.t OR b.n < a.n))")
def _(spark, d):
    points = table(spark, d, "labels").join(_docs(spark, d), "doc_id").select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t"), F.expr("cast(n_chars div 500 AS int)").alias("n"))
    return latency.frontier(points, "doc_id", ["q"], ["t", "n"])


@P.query("srt16_max_concurrency", f"WITH l AS ({_LEVELS}) SELECT g, max(level) AS best FROM l WHERE value <= 51 GROUP BY g")
def _(spark, d):
    return _levels(spark, d).filter("value <= 51").groupBy("g").agg(F.max("level").alias("best"))


@P.query("hsh03_level_seed", "SELECT event_id, (user_id * 1000003 + event_id) % 4294967296 AS seed FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", (F.col("user_id") * 1000003 + F.col("event_id")).bitwiseAND(F.lit(0xFFFFFFFF)).alias("seed"))


@P.query("hsh02_prompt_digest", "SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS digest FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.to_json(F.struct("lang", "source")), 256).alias("digest"))


@P.query("mth08_kv_capacity", "SELECT p_partkey, 2 * p_size * 128 * 2 AS bytes_per_token, greatest(floor(80e9 / (2.0 * p_size * 128 * 2 * 4096)), 1)::BIGINT AS sessions FROM part")
def _(spark, d):
    per_token = F.lit(2) * F.col("p_size") * 128 * 2
    return table(spark, d, "part").select("p_partkey", per_token.alias("bytes_per_token"), F.greatest(F.floor(F.lit(80e9) / (per_token.cast("double") * 4096)), F.lit(1)).cast("long").alias("sessions"))


@P.query("mth09_degraded", "SELECT user_id, max_by(value, event_id) > 1.1::DOUBLE * min_by(value, event_id) AS degraded FROM events GROUP BY user_id")
def _(spark, d):
    return _events(spark, d).groupBy("user_id").agg((F.max_by("value", "event_id") > F.lit(1.1) * F.min_by("value", "event_id")).alias("degraded"))


@P.query("mth10_ranking", """WITH m AS (SELECT event_type, avg(value) AS a, stddev_samp(value) AS s FROM events GROUP BY event_type) SELECT event_type, rank() OVER (ORDER BY score DESC)::INTEGER AS place FROM (
  SELECT event_type, 0.7::DOUBLE * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.3::DOUBLE * (max(s) OVER () - s) / (max(s) OVER () - min(s) OVER ()) AS score FROM m)""")
def _(spark, d):
    m = _events(spark, d).groupBy("event_type").agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("s"))
    w = Window.partitionBy()
    up = (F.col("a") - F.min("a").over(w)) / (F.max("a").over(w) - F.min("a").over(w))
    down = (F.max("s").over(w) - F.col("s")) / (F.max("s").over(w) - F.min("s").over(w))
    return m.withColumn("score", F.lit(0.7) * up + F.lit(0.3) * down).select("event_type", F.rank().over(Window.orderBy(F.desc("score"))).alias("place"))


@P.query("mth04_target_bar", "SELECT a::DOUBLE AS a, p, p * a::DOUBLE + (1 - p) * 0.7::DOUBLE AS bar FROM (VALUES (0.85), (0.9), (0.95), (1.0)) v(a), (SELECT avg((event_type = (SELECT min(event_type) FROM events))::INT)::DOUBLE AS p FROM events)")
def _(spark, d):
    first = _events(spark, d).agg(F.min("event_type").alias("m"))
    share = _events(spark, d).crossJoin(F.broadcast(first)).agg(F.avg((F.col("event_type") == F.col("m")).cast("int")).alias("p"))
    sweep = spark.createDataFrame([(0.85,), (0.9,), (0.95,), (1.0,)], "a double")
    return sweep.crossJoin(share).select("a", "p", (F.col("p") * F.col("a") + (1 - F.col("p")) * F.lit(0.7)).alias("bar"))


@P.query("vec03_token_quant", "SELECT vec_id, list_min(embedding)::DOUBLE AS low, greatest((list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) / 15, 1e-8) AS scale FROM embeddings")
def _(spark, d):
    low, high = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    return table(spark, d, "embeddings").select("vec_id", low.alias("low"), F.greatest((high - low) / 15, F.lit(1e-8)).alias("scale"))


@P.query("vec03_channel_quant", "SELECT pos, min(x)::DOUBLE AS low, greatest((max(x)::DOUBLE - min(x)::DOUBLE) / 15, 1e-8) AS scale FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos")
def _(spark, d):
    flat = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    low, high = F.min("x").cast("double"), F.max("x").cast("double")
    return flat.groupBy(F.col("pos").cast("long").alias("pos")).agg(low.alias("low"), F.greatest((high - low) / 15, F.lit(1e-8)).alias("scale"))


@P.query("vec05_outlier_channels", "WITH m AS (SELECT pos, max(abs(x)) * CASE WHEN pos % 9 = 0 THEN 8 ELSE 1 END AS top FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos) SELECT pos, top > 6 * (SELECT median(top) FROM m) AND (SELECT median(top) FROM m) >= 1e-8 AS outlier FROM m")
def _(spark, d):
    scaled = F.transform("embedding", lambda x, i: x.cast("double") * F.when(i % 9 == 0, 8.0).otherwise(1.0))
    return vectors.outlier_channels(table(spark, d, "embeddings").select(scaled.alias("embedding")), "embedding").select("pos", "outlier")


QUERIES, ORACLE = P.queries, P.oracle
