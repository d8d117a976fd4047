"""Queries on scores: transitions, tools, rewards, roll-ups, paired comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import metrics
from dialoom.operators import messages, reports
from dialoom.plans.base import Plans, dialog, over_dialog
from dialoom.sources import table

P = Plans()

_PRED = """SELECT conv_id, turn, src, dst, CASE WHEN turn % 7 = 3 THEN dst ELSE src END AS psrc, CASE WHEN turn % 5 = 2 THEN 'S0' WHEN turn % 7 = 3 THEN src ELSE dst END AS pdst,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN 't' || CAST(conv_id % 5 AS STRING) ELSE 't9' END AS tool, CASE WHEN (conv_id + turn) % 4 < 2 THEN 't' || CAST(conv_id % 5 AS STRING) ELSE 't9' END AS ptool
  FROM {dialog} WHERE role = 'assistant'"""


def _pairs(spark, d):
    return spark.sql(_PRED, dialog=dialog(spark, d))


def _arrays(spark, d):
    """One row a conversation: true and predicted pairs and tools, in order."""
    rows = _pairs(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "src", "dst", "psrc", "pdst", "tool", "ptool"))).alias("m"))
    pair = lambda s, t: F.transform("m", lambda m: F.struct(m[s].alias("src"), m[t].alias("dst")))
    return rows.select(
        "conv_id", pair("src", "dst").alias("gold"), pair("psrc", "pdst").alias("pred"), F.transform("m", lambda m: m["tool"]).alias("tools"), F.transform("m", lambda m: m["ptool"]).alias("ptools"),
    )


def _sql(body: str) -> str:
    return over_dialog("SELECT * FROM (WITH p AS (" + _PRED.replace("{dialog}", "dialog") + ") " + body + ")")


_ACC = "SELECT conv_id, avg(CASE WHEN src = psrc AND dst = pdst THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM p GROUP BY conv_id"


@P.query("scr01_transition_accuracy", _sql(_ACC))
def _(spark, d):
    return _arrays(spark, d).select("conv_id", metrics.transition_accuracy(F.col("pred"), F.col("gold")).alias("acc"))


_INV = "SELECT conv_id, count(*) FILTER (WHERE NOT (src = psrc AND dst = pdst) AND NOT EXISTS (SELECT 1 FROM p q WHERE q.conv_id = p.conv_id AND q.src = p.psrc AND q.dst = p.pdst))::INTEGER AS invalid, count(*) AS n FROM p GROUP BY conv_id"


@P.query("scr01_invalid_transitions", _sql(f"SELECT conv_id, invalid FROM ({_INV})"))
def _(spark, d):
    return _arrays(spark, d).select("conv_id", metrics.invalid_transitions(F.col("pred"), F.col("gold")).alias("invalid"))


@P.query("agg01_state_rollup", _sql(f"SELECT (SELECT avg(acc) FROM ({_ACC})) AS transition_accuracy, (SELECT sum(invalid)::DOUBLE / greatest(sum(n), 1) FROM ({_INV})) AS invalid_rate, (SELECT avg((last = 'S3')::INT)::DOUBLE FROM (SELECT max_by(pdst, turn) AS last FROM p GROUP BY conv_id)) AS completion"))
def _(spark, d):
    rows = _arrays(spark, d)
    p, g = F.col("pred"), F.col("gold")
    each = rows.select(
        metrics.transition_accuracy(p, g).alias("a"), metrics.invalid_transitions(p, g).alias("i"), F.greatest(F.size(p), F.size(g)).alias("n"), metrics.task_complete(p, F.array(F.lit("S3"))).cast("int").alias("c"),
    )
    return each.agg(F.avg("a").alias("transition_accuracy"), (F.sum("i") / F.greatest(F.sum("n"), F.lit(1))).alias("invalid_rate"), F.avg("c").alias("completion"))


@P.query("agg01_state_machine_report")
def _(spark, d):
    fewer = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.slice("pred", 1, F.greatest(F.size("pred") - k, F.lit(1))))
    healed = messages.recoveries(dialog(spark, d))
    rows = _arrays(spark, d).withColumn("trials", fewer).join(healed, "conv_id", "left").fillna(0, ["errors", "recovered"])
    return reports.state_report(rows, F.array(F.lit("S0"), F.lit("S3")))


@P.query("scr02_task_completion", _sql("SELECT conv_id, max_by(pdst, turn) IN ('S1', 'S3') AS done FROM p GROUP BY conv_id"))
def _(spark, d):
    return _arrays(spark, d).select("conv_id", metrics.task_complete(F.col("pred"), F.array(F.lit("S1"), F.lit("S3"))).alias("done"))


@P.query("scr03_pass_power_k", _sql("SELECT conv_id % 10 AS item, bool_and(done) AS consistent FROM (SELECT conv_id, max_by(pdst, turn) IN ('S1', 'S2', 'S3') AS done FROM p GROUP BY conv_id) GROUP BY conv_id % 10"))
def _(spark, d):
    done = metrics.task_complete(F.col("pred"), F.array(*map(F.lit, ("S1", "S2", "S3"))))
    return _arrays(spark, d).groupBy((F.col("conv_id") % 10).alias("item")).agg(F.bool_and(done).alias("consistent"))


@P.query("scr04_name_accuracy", _sql("SELECT conv_id, avg((tool = ptool)::INT)::DOUBLE AS acc FROM p GROUP BY conv_id"))
def _(spark, d):
    return _arrays(spark, d).select("conv_id", metrics.name_accuracy(F.col("ptools"), F.col("tools")).alias("acc"))


@P.query("scr06_hallucinated", _sql("SELECT conv_id, count(*) AS n FROM p WHERE ptool NOT IN ('t0', 't1', 't2', 't3') GROUP BY conv_id"))
def _(spark, d):
    known = F.array(*map(F.lit, ("t0", "t1", "t2", "t3")))
    made_up = F.filter("ptools", lambda t: ~F.array_contains(known, t))
    return _arrays(spark, d).select("conv_id", F.size(made_up).cast("long").alias("n")).filter("n > 0")


@P.query("scr08_partial_match", _sql("SELECT conv_id, avg(CASE WHEN src = psrc AND dst = pdst THEN 1.0::DOUBLE WHEN src = psrc THEN 0.5 ELSE 0 END) AS score FROM p GROUP BY conv_id"))
def _(spark, d):
    return _arrays(spark, d).select("conv_id", metrics.partial_state_match(F.col("pred"), F.col("gold")).alias("score"))


@P.query("scr08_graded_match", _sql("SELECT conv_id, avg(CASE WHEN src = psrc AND dst = pdst THEN 1.0::DOUBLE WHEN src = psrc OR dst = pdst THEN 0.5 WHEN src = pdst AND dst = psrc THEN 0.3 ELSE 0 END) AS score FROM p GROUP BY conv_id"))
def _(spark, d):
    return _arrays(spark, d).select("conv_id", metrics.graded_state_match(F.col("pred"), F.col("gold")).alias("score"))


@P.query("sim04_sequence_recall")
def _(spark, d):
    return _arrays(spark, d).select("conv_id", metrics.sequence_recall(F.col("pred"), F.col("gold")).alias("score"))


@P.query("grf01_edge_f1", _sql("""SELECT conv_id, CASE WHEN g + q = 0 THEN 1.0 ELSE 2.0 * c / (g + q) END::DOUBLE AS f1 FROM (SELECT conv_id, count(DISTINCT src || dst) AS g, count(DISTINCT psrc || pdst) AS q,
  (SELECT count(*) FROM (SELECT src, dst FROM p a WHERE a.conv_id = p.conv_id INTERSECT SELECT psrc, pdst FROM p b WHERE b.conv_id = p.conv_id)) AS c FROM p GROUP BY conv_id)"""))
def _(spark, d):
    return _arrays(spark, d).select("conv_id", metrics.set_f1(F.col("pred"), F.col("gold")).alias("f1"))


@P.query("join01_pred_truth", _sql("SELECT a.conv_id, count(*) AS n FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE b.conv_id % 3 <> 0 AND a.psrc = b.src GROUP BY a.conv_id"))
def _(spark, d):
    rows = _pairs(spark, d)
    truth = rows.filter("conv_id % 3 != 0").select("conv_id", "turn", F.col("src").alias("true_src"))
    return rows.join(truth, ["conv_id", "turn"]).filter("psrc = true_src").groupBy("conv_id").agg(F.count("*").alias("n"))


@P.query("join03_zip", _sql("SELECT conv_id, pos, tool, ptool FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, tool, ptool, count(*) OVER (PARTITION BY conv_id) AS n FROM p) WHERE pos < least(n, 2)"))
def _(spark, d):
    short = F.slice("ptools", 1, 2)
    n = F.least(F.size(short), F.size("tools"))
    zipped = F.arrays_zip(F.slice("tools", 1, n).alias("tool"), F.slice(short, 1, n).alias("ptool"))
    return _arrays(spark, d).select("conv_id", F.posexplode(zipped).alias("pos", "z")).select("conv_id", F.col("pos").cast("long").alias("pos"), "z.tool", "z.ptool")


@P.query("join04_left_positional", _sql("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, tool, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN ptool ELSE '' END AS ptool FROM p"))
def _(spark, d):
    rows = _arrays(spark, d).select("conv_id", F.posexplode("tools").alias("pos", "tool"), F.slice("ptools", 1, 1).alias("q"))
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), "tool", F.coalesce(F.get("q", F.col("pos")), F.lit("")).alias("ptool"))


@P.query("join19_overlap", _sql("SELECT conv_id FROM (SELECT DISTINCT conv_id, tool FROM p) a JOIN (SELECT DISTINCT conv_id, ptool AS tool FROM p) b USING (conv_id, tool) WHERE tool <> 't9' GROUP BY conv_id"))
def _(spark, d):
    real = lambda c: F.filter(c, lambda t: t != "t9")
    return _arrays(spark, d).filter(F.arrays_overlap(real("tools"), real("ptools"))).select("conv_id")


@P.query("set04_multiset_except", _sql("SELECT conv_id, ptool, count(*) AS n FROM p WHERE ptool NOT IN (SELECT tool FROM p q WHERE q.conv_id = p.conv_id) GROUP BY conv_id, ptool"))
def _(spark, d):
    extra = F.filter("ptools", lambda t: ~F.array_contains(F.col("tools"), t))
    return _arrays(spark, d).select("conv_id", F.explode(extra).alias("ptool")).groupBy("conv_id", "ptool").agg(F.count("*").alias("n"))


@P.query("agg06_confusion", _sql("SELECT tool, ptool, count(*) AS n FROM p GROUP BY tool, ptool"))
def _(spark, d):
    return _pairs(spark, d).groupBy("tool", "ptool").agg(F.count("*").alias("n"))


_CLASS = """SELECT c AS class, CASE WHEN np = 0 THEN 0 ELSE hit / np::DOUBLE END AS precision, CASE WHEN nt = 0 THEN 0 ELSE hit / nt::DOUBLE END AS recall, CASE WHEN np + nt = 0 THEN 0 ELSE 2 * hit / (np + nt)::DOUBLE END AS f1 FROM (
  SELECT c, (SELECT count(*) FROM p WHERE tool = c) AS nt, (SELECT count(*) FROM p WHERE ptool = c) AS np, (SELECT count(*) FROM p WHERE tool = c AND ptool = c) AS hit FROM (SELECT DISTINCT tool AS c FROM p UNION SELECT DISTINCT ptool FROM p))"""


@P.query("agg06_class_f1", _sql(_CLASS))
def _(spark, d):
    rows = _pairs(spark, d)
    both = rows.select(F.explode(F.array(F.struct(F.col("tool").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col("ptool").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q")))).alias("z"), (F.col("tool") == F.col("ptool")).cast("int").alias("hit"))
    sums = both.groupBy(F.col("z.c").alias("class")).agg(F.sum("z.t").alias("nt"), F.sum("z.q").alias("np"), F.sum(F.col("hit") * F.col("z.t")).alias("hit"))
    share = lambda n: F.coalesce(F.try_divide(F.col("hit"), n), F.lit(0.0))
    return sums.select("class", share(F.col("np")).alias("precision"), share(F.col("nt")).alias("recall"), share((F.col("np") + F.col("nt")) / 2).alias("f1"))


@P.query("agg07_accuracy_top3", _sql("SELECT avg((tool = ptool)::INT)::DOUBLE AS accuracy, avg((tool IN (ptool, 't9', 't1'))::INT)::DOUBLE AS top3 FROM p"))
def _(spark, d):
    top = F.array(F.col("ptool"), F.lit("t9"), F.lit("t1"))
    return _pairs(spark, d).agg(F.avg((F.col("tool") == F.col("ptool")).cast("int")).alias("accuracy"), F.avg(F.array_contains(top, F.col("tool")).cast("int")).alias("top3"))


_AUDIT = """SELECT l_orderkey * 10 + l_linenumber AS row_index, CASE WHEN l_suppkey % 2 = 0 THEN 'x' ELSE 'y' END AS stratum, l_discount * 10 AS state_acc, l_tax * 10 AS tool_f1, CAST(l_returnflag = 'R' AS INT) AS task, l_linenumber % 3 AS n_gt_trans, l_linenumber % 2 AS n_gt_tools FROM {lineitem}"""


def _audit(spark, d):
    return spark.sql(_AUDIT, lineitem=table(spark, d, "lineitem"))


def _over_audit(body: str) -> str:
    return "WITH audit AS (" + _AUDIT.replace("{lineitem}", "lineitem") + ") " + body


@P.query("mth01_weighted_scores", _over_audit("SELECT row_index, 0.4::DOUBLE * state_acc + 0.4::DOUBLE * tool_f1 + 0.2::DOUBLE * task AS turn_score, 0.4::DOUBLE * greatest(state_acc, tool_f1) + 0.4::DOUBLE * tool_f1 + 0.2::DOUBLE * task AS best_score FROM audit"))
def _(spark, d):
    s, t, k = F.col("state_acc"), F.col("tool_f1"), F.col("task")
    return _audit(spark, d).select("row_index", metrics.weighted_score(s, t, k).alias("turn_score"), metrics.weighted_score(s, t, k, t).alias("best_score"))


@P.query("mth02_product_success", _over_audit("SELECT row_index, task * CASE WHEN tool_f1 > 0 THEN least(tool_f1 / 0.8::DOUBLE, 1) ELSE 0 END * CASE WHEN n_gt_tools > 0 THEN least(state_acc / 0.7::DOUBLE, 1) ELSE 1 END AS success FROM audit"))
def _(spark, d):
    return _audit(spark, d).select("row_index", metrics.product_success(F.col("task"), F.col("tool_f1"), F.col("state_acc"), F.col("n_gt_tools")).alias("success"))


@P.query("mth03_renormalised", _over_audit("SELECT row_index, (0.4::DOUBLE * tool_f1 + CASE WHEN n_gt_trans > 0 THEN 0.4::DOUBLE * state_acc ELSE 0 END + CASE WHEN n_gt_tools > 0 THEN 0.2::DOUBLE * task ELSE 0 END) / (0.4::DOUBLE + CASE WHEN n_gt_trans > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN n_gt_tools > 0 THEN 0.2::DOUBLE ELSE 0 END) AS score FROM audit"))
def _(spark, d):
    terms = [(0.4, F.lit(True), F.col("tool_f1")), (0.4, F.col("n_gt_trans") > 0, F.col("state_acc")), (0.2, F.col("n_gt_tools") > 0, F.col("task"))]
    return _audit(spark, d).select("row_index", metrics.renormalised(terms).alias("score"))


@P.query("mth06_pass_at_k", "SELECT l_orderkey, k, CASE WHEN n - c < k THEN 1.0 ELSE 1 - CASE k WHEN 1 THEN (n - c) / n ELSE (n - c) / n * ((n - c - 1) / (n - 1)) END END::DOUBLE AS p FROM (SELECT l_orderkey, count(*)::DOUBLE AS n, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS c FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1), (VALUES (1), (2)) v(k)")
def _(spark, d):
    trials = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c")).filter("n > 1")
    one = lambda k: trials.select("l_orderkey", F.lit(k).alias("k"), metrics.pass_at_k(F.col("n"), F.col("c"), k).alias("p"))
    return one(1).union(one(2))


@P.query("agg20_audit_summary", _over_audit("SELECT count(*) AS n, avg(state_acc) AS state, avg(tool_f1) AS tool, avg((state_acc = 0)::INT)::DOUBLE AS zero FROM audit"))
def _(spark, d):
    return _audit(spark, d).agg(F.count("*").alias("n"), F.avg("state_acc").alias("state"), F.avg("tool_f1").alias("tool"), F.avg((F.col("state_acc") == 0).cast("int")).alias("zero"))


@P.query("agg21_strata", _over_audit("SELECT stratum, avg(state_acc) FILTER (WHERE n_gt_trans > 0) AS advance, avg(tool_f1) FILTER (WHERE n_gt_tools > 0) AS tool, count(*) AS n FROM audit GROUP BY stratum"))
def _(spark, d):
    where = lambda c, n: F.avg(F.when(F.col(n) > 0, F.col(c)))
    return _audit(spark, d).groupBy("stratum").agg(where("state_acc", "n_gt_trans").alias("advance"), where("tool_f1", "n_gt_tools").alias("tool"), F.count("*").alias("n"))


@P.query("agg22_habit_table", _over_audit("SELECT n_gt_trans > 0 AS gold_moves, n_gt_tools > 0 AS with_tool, count(*) AS n, avg(task)::DOUBLE AS rate FROM audit GROUP BY ALL"))
def _(spark, d):
    return _audit(spark, d).groupBy((F.col("n_gt_trans") > 0).alias("gold_moves"), (F.col("n_gt_tools") > 0).alias("with_tool")).agg(F.count("*").alias("n"), F.avg("task").alias("rate"))


@P.query("agg23_spike", _over_audit("SELECT n_gt_trans, count(*) AS n, median(tool_f1) AS median, count(*) FILTER (WHERE tool_f1 = 0.5) AS spike FROM audit GROUP BY n_gt_trans"))
def _(spark, d):
    return _audit(spark, d).groupBy("n_gt_trans").agg(F.count("*").alias("n"), F.median("tool_f1").alias("median"), F.count_if(F.col("tool_f1") == 0.5).alias("spike"))


@P.query("agg24_held_out_check", _over_audit("SELECT avg(tool_f1) AS mean, median(tool_f1) AS median, min(tool_f1) AS least, max(tool_f1) AS most, avg((tool_f1 < 0.3)::INT)::DOUBLE AS below, CASE WHEN avg(tool_f1) >= 0.3 THEN 'PASS' ELSE 'FAIL' END AS gate FROM audit"))
def _(spark, d):
    out = _audit(spark, d).agg(F.avg("tool_f1").alias("mean"), F.median("tool_f1").alias("median"), F.min("tool_f1").alias("least"), F.max("tool_f1").alias("most"), F.avg((F.col("tool_f1") < F.lit(0.3)).cast("int")).alias("below"))
    return out.withColumn("gate", F.when(F.col("mean") >= 0.3, "PASS").otherwise("FAIL"))


@P.query("agg25_headroom", _over_audit("SELECT stratum, avg(best - lowest) AS headroom, avg(rungs)::DOUBLE AS rungs, avg((spread = 0)::INT)::DOUBLE AS collapsed FROM (SELECT stratum, row_index // 10 AS g, max(tool_f1) AS best, min(tool_f1) AS lowest, count(DISTINCT round_even(tool_f1, 3)) AS rungs, stddev_pop(tool_f1) AS spread FROM audit GROUP BY ALL) GROUP BY stratum"))
def _(spark, d):
    prompts = _audit(spark, d).groupBy("stratum", F.expr("row_index div 10").alias("g")).agg(
        F.max("tool_f1").alias("best"), F.min("tool_f1").alias("lowest"), F.countDistinct(F.bround("tool_f1", 3)).alias("rungs"), F.stddev_pop("tool_f1").alias("spread"))
    return prompts.groupBy("stratum").agg(F.avg(F.col("best") - F.col("lowest")).alias("headroom"), F.avg("rungs").alias("rungs"), F.avg((F.col("spread") == 0).cast("int")).alias("collapsed"))


_RUNS = "SELECT a.row_index, a.tool_f1 AS x, b.state_acc AS y FROM audit a JOIN audit b USING (row_index)"


@P.query("join08_paired_runs", _over_audit(f"SELECT avg(x - y) AS delta, count(*) FILTER (WHERE x > y) AS wins, count(*) FILTER (WHERE x < y) AS losses, count(*) FILTER (WHERE x = y) AS ties FROM ({_RUNS})"))
def _(spark, d):
    audit = _audit(spark, d)
    both = audit.select("row_index", F.col("tool_f1").alias("x")).join(audit.select("row_index", F.col("state_acc").alias("y")), "row_index")
    return both.agg(F.avg(F.col("x") - F.col("y")).alias("delta"), F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"))


@P.query("join09_baseline", _over_audit("SELECT a.stratum, count(b.row_index) AS paired, avg(CASE WHEN b.row_index IS NOT NULL THEN (a.tool_f1 > b.tool_f1)::INT END)::DOUBLE AS improved FROM audit a LEFT JOIN (SELECT row_index, tool_f1 / 2 + 0.1 AS tool_f1 FROM audit WHERE row_index % 3 <> 0) b USING (row_index) GROUP BY a.stratum"))
def _(spark, d):
    audit = _audit(spark, d)
    base = audit.filter("row_index % 3 != 0").select("row_index", (F.col("tool_f1") / 2 + F.lit(0.1)).alias("base"))
    return audit.join(base, "row_index", "left").groupBy("stratum").agg(F.count("base").alias("paired"), F.avg(F.when(F.col("base").isNotNull(), (F.col("tool_f1") > F.col("base")).cast("int"))).alias("improved"))


@P.query("join21_tolerance", _over_audit("SELECT count(*) AS n, count(*) FILTER (WHERE abs(a.tool_f1 - (b.tool_f1 + CASE WHEN a.row_index % 5 = 0 THEN 0.001 ELSE 1e-9 END)) > 1e-6) AS off FROM audit a JOIN audit b USING (row_index)"))
def _(spark, d):
    audit = _audit(spark, d)
    stored = audit.select("row_index", (F.col("tool_f1") + F.when(F.col("row_index") % 5 == 0, 0.001).otherwise(1e-9)).alias("kept"))
    return audit.join(stored, "row_index").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("tool_f1") - F.col("kept")) > 1e-6).alias("off"))


@P.query("scr15_failure_class", _over_audit("SELECT CASE WHEN n_gt_tools > 0 AND tool_f1 = 0 THEN 'missed_tool' WHEN n_gt_tools = 0 AND tool_f1 > 0.5 THEN 'extra_tool' WHEN state_acc < 0.5 THEN 'wrong_state' ELSE 'acceptable' END AS kind, count(*) AS n FROM audit GROUP BY ALL"))
def _(spark, d):
    t, s, n = F.col("tool_f1"), F.col("state_acc"), F.col("n_gt_tools")
    kind = F.when((n > 0) & (t == 0), "missed_tool").when((n == 0) & (t > 0.5), "extra_tool").when(s < 0.5, "wrong_state").otherwise("acceptable")
    return _audit(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@P.query("gat01_gates", _over_audit("SELECT stratum, CASE WHEN m < 0.2 THEN 'STOP' WHEN m >= 0.35 THEN 'GO' ELSE 'REVIEW' END AS gate FROM (SELECT stratum, avg(tool_f1) AS m FROM audit GROUP BY stratum)"))
def _(spark, d):
    m = F.avg("tool_f1")
    return _audit(spark, d).groupBy("stratum").agg(F.when(m < 0.2, "STOP").when(m >= 0.35, "GO").otherwise("REVIEW").alias("gate"))


@P.query("sim01_bag_f1", r"""WITH w AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS t FROM documents) WHERE t <> '' GROUP BY ALL),
  v AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(substr(text, 101)), '\s+')) AS t FROM documents) WHERE t <> '' GROUP BY ALL),
  c AS (SELECT doc_id, sum(least(w.n, v.n)) AS c FROM w JOIN v USING (doc_id, t) GROUP BY doc_id)
  SELECT doc_id, coalesce(2 * c / ((SELECT sum(n) FROM w WHERE w.doc_id = d.doc_id) + (SELECT sum(n) FROM v WHERE v.doc_id = d.doc_id)), 0)::DOUBLE AS f1 FROM documents d LEFT JOIN c USING (doc_id)""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", metrics.bag_f1(metrics.tokens(F.col("text")), metrics.tokens(F.substring("text", 101, 2**31 - 1))).alias("f1"))


QUERIES, ORACLE = P.queries, P.oracle
