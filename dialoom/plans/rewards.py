"""Queries on rewards, trajectories, probes, validators, projections of graphs and text repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import jsonvalue, markers, metrics, texts
from dialoom.operators import messages as ops
from dialoom.operators import sampling, trajectories, vectors
from dialoom.operators.splitting import hash_split
from dialoom.plans.base import Plans, dialog, over_dialog
from dialoom.sources import table

P = Plans()


def _li(spark, d):
    return table(spark, d, "lineitem")


# ---- trajectories: an order's lines are turns; gold is N0>N1>N2>N3
def _turns(spark, d):
    move = F.when(F.col("l_partkey") % 3 == 0, F.struct(F.lit("N0").alias("src"), F.lit("N0").alias("dst")))
    place = F.concat(F.lit("N"), (F.col("l_linenumber") - 1).cast("string"))
    nxt = F.concat(F.lit("N"), F.col("l_linenumber").cast("string"))
    pair = F.when(F.col("l_suppkey") % 9 == 0, F.struct(F.lit("N7").alias("src"), F.lit("N8").alias("dst"))).otherwise(F.struct(place.alias("src"), nxt.alias("dst")))
    rows = _li(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array(F.coalesce(move, pair)).alias("t"))
    gold = F.array(*[F.struct(F.lit(f"N{i}").alias("src"), F.lit(f"N{i + 1}").alias("dst")) for i in range(3)])
    turns = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "t"))).alias("m"))
    return turns.select("l_orderkey", F.transform("m", lambda m: m["t"]).alias("turns"), gold.alias("gold"))


_WALK = f"""WITH RECURSIVE t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS total,
    CASE WHEN l_partkey % 3 = 0 THEN 'stay' WHEN l_suppkey % 9 = 0 THEN 'bad' ELSE 'N' || (l_linenumber - 1) END AS mv FROM lineitem),
  w AS (SELECT DISTINCT k, 0::BIGINT AS n, 0 AS cursor, 0 AS stalls, 0 AS run, '' AS reason FROM t UNION ALL
    SELECT k, n, cursor, stalls, run, CASE WHEN NOT stay AND NOT ok THEN 'diverged' WHEN cursor >= 3 THEN 'gold_complete' WHEN run >= 2 THEN 'stall' WHEN n >= total THEN 'script_exhausted' WHEN n >= 5 THEN 'turn_cap' ELSE '' END AS reason FROM (
      SELECT w.k, t.n, t.total, mv = 'stay' AS stay, mv = 'N' || cursor AND cursor < 3 AS ok, cursor + CASE WHEN mv = 'N' || cursor AND cursor < 3 THEN 1 ELSE 0 END AS cursor,
        stalls + CASE WHEN mv = 'stay' THEN 1 ELSE 0 END AS stalls, CASE WHEN mv = 'stay' THEN run + 1 ELSE 0 END AS run FROM w JOIN t ON w.k = t.k AND t.n = w.n + 1 WHERE reason = ''))
"""


@P.query("win13_alignment", _WALK + "SELECT k AS l_orderkey, max_by(cursor, n) AS cursor, max_by(stalls, n) AS stalls FROM w GROUP BY k")
def _(spark, d):
    s = trajectories.align(F.col("turns"), F.col("gold"), 2, 5)
    return _turns(spark, d).select("l_orderkey", s.alias("s")).select("l_orderkey", "s.cursor", "s.stalls")


@P.query("win14_stop_reason", _WALK + "SELECT reason, count(*) AS n FROM w WHERE reason <> '' GROUP BY reason")
def _(spark, d):
    return _turns(spark, d).select(trajectories.align(F.col("turns"), F.col("gold"), 2, 5)["reason"].alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@P.query("scr10_trajectory_reward", _WALK + "SELECT k AS l_orderkey, (0.4::DOUBLE * max_by(cursor, n) / 3 + 0.2::DOUBLE * (1 - max_by(stalls, n) / max(n)::DOUBLE)) / (0.4::DOUBLE + 0.2::DOUBLE) AS reward FROM w WHERE n > 0 GROUP BY k")
def _(spark, d):
    s = F.col("s")
    terms = [(0.4, F.lit(True), trajectories.coverage(s, F.col("gold"))), (0.2, F.lit(True), 1 - s["stalls"] / s["seen"])]
    return _turns(spark, d).withColumn("s", trajectories.align(F.col("turns"), F.col("gold"), 2, 5)).select("l_orderkey", metrics.renormalised(terms).alias("reward"))


@P.query("scr13_chain_score", "SELECT l_orderkey, coalesce(avg(hit::INT) FILTER (WHERE hit IS NOT NULL), 1)::DOUBLE AS score FROM (SELECT l_orderkey, lag(l_partkey % 4) OVER w = l_suppkey % 4 AS hit FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) GROUP BY l_orderkey")
def _(spark, d):
    one = lambda c: F.array((F.col(c) % 4).cast("string"))
    rows = _li(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", one("l_suppkey").alias("need"), one("l_partkey").alias("give")))).alias("m"))
    return rows.select("l_orderkey", trajectories.chain_score(F.transform("m", lambda m: m["need"]), F.transform("m", lambda m: m["give"])).alias("score"))


@P.query("scr09_business_reward", "SELECT l_orderkey * 10 + l_linenumber AS i, CASE WHEN l_tax > 0.04 THEN (0.4::DOUBLE * l_discount + 0.3::DOUBLE * l_tax) / (0.4::DOUBLE + 0.3::DOUBLE) ELSE 0.4::DOUBLE * l_discount / 0.4::DOUBLE END AS reward FROM lineitem")
def _(spark, d):
    terms = [(0.4, F.lit(True), F.col("l_discount")), (0.3, F.col("l_tax") > 0.04, F.col("l_tax"))]
    return _li(spark, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), metrics.renormalised(terms).alias("reward"))


@P.query("scr11_slot_accuracy", "SELECT l_orderkey, avg((l_quantity = CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE l_quantity END)::INT)::DOUBLE AS slots FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    got = F.when(F.col("l_partkey") % 4 == 0, 1.0).otherwise(F.col("l_quantity"))
    return _li(spark, d).groupBy("l_orderkey").agg(F.avg((F.col("l_quantity") == got).cast("int")).alias("slots"))


@P.query("scr12_graph_reward", "SELECT l_orderkey * 10 + l_linenumber AS i, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 0.1::DOUBLE + 0.35::DOUBLE * l_discount + 0.35::DOUBLE * l_tax + 0.1::DOUBLE * (1 - l_discount) + 0.1::DOUBLE * (l_linestatus = 'F')::INT END AS reward FROM lineitem")
def _(spark, d):
    terms = F.lit(0.1) + F.lit(0.35) * F.col("l_discount") + F.lit(0.35) * F.col("l_tax") + F.lit(0.1) * (1 - F.col("l_discount")) + F.lit(0.1) * (F.col("l_linestatus") == "F").cast("int")
    return _li(spark, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.when(F.col("l_returnflag") == "A", 0.0).otherwise(terms).alias("reward"))


@P.query("scr14_audit_parts", "SELECT l_orderkey * 10 + l_linenumber AS i, 0.4::DOUBLE * l_discount AS state_part, 0.4::DOUBLE * l_tax AS tool_part FROM lineitem")
def _(spark, d):
    return _li(spark, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), (F.lit(0.4) * F.col("l_discount")).alias("state_part"), (F.lit(0.4) * F.col("l_tax")).alias("tool_part"))


@P.query("scr07_full_success", "SELECT o_orderkey, bool_and(l_returnflag <> 'R') AND bool_or(l_linestatus = 'F') AS success FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines = rows.groupBy("o_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linestatus")).alias("m"))
    return lines.select("o_orderkey", (F.forall("m", lambda m: m["l_returnflag"] != "R") & F.exists("m", lambda m: m["l_linestatus"] == "F")).alias("success"))


@P.query("scr16_mined_negatives", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p = '' THEN 'empty' WHEN p = text THEN 'identical' WHEN length(p) > 400 THEN 'acceptable' ELSE 'mined' END AS kind FROM (SELECT text, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN text ELSE left(text, 200 + (doc_id % 300)::INT) END AS p FROM documents)) GROUP BY kind")
def _(spark, d):
    i = F.col("doc_id") % 5
    p = F.when(i == 0, "").when(i == 1, F.col("text")).otherwise(F.left("text", (200 + F.col("doc_id") % 300).cast("int")))
    kind = F.when(F.col("p") == "", "empty").when(F.col("p") == F.col("text"), "identical").when(F.length("p") > 400, "acceptable").otherwise("mined")
    return table(spark, d, "documents").select("text", p.alias("p")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_PAIRS = "SELECT conv_id, turn, kind FROM (SELECT conv_id, turn, unnest(CASE WHEN (conv_id + turn) % 3 = 0 THEN ['flip', 'drop'] ELSE ['flip'] END) AS kind FROM dialog WHERE role = 'assistant' AND src <> dst AND conv_id % 4 <> 1)"


@P.query("scr17_preference_pairs", over_dialog(f"SELECT conv_id, turn, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('1|' || conv_id || '-' || turn), conv_id || '-' || turn) AS r, (SELECT min(n) FROM (SELECT count(*) AS n FROM ({_PAIRS}) GROUP BY kind)) AS cap FROM ({_PAIRS})) WHERE r <= cap"))
def _(spark, d):
    content = F.col("content")
    rows = dialog(spark, d).filter("role = 'assistant' AND conv_id % 4 != 1").withColumn("t", F.get(markers.transitions(content), 0)).filter("t.src != t.dst")
    kinds = F.array_compact(F.array(F.lit("flip"), F.when(F.size(markers.call_blocks(content)) > 0, "drop")))
    pairs = rows.select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.explode(kinds).alias("kind"))
    return sampling.balance_to_scarcest(pairs, "kind", "key", 1).select("conv_id", "turn", "kind")


# ---- similarity
@P.query("sim02_rouge_l")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.rouge_l(F.col("text"), F.substring("text", 21, 2**31 - 1)).alias("score"))


@P.query("sim03_edit_similarity")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.edit_similarity(F.col("text"), F.substring("text", 11, 2**31 - 1)).alias("score"))


@P.query("sim05_category_exact", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 100 ELSE 0 END::DOUBLE AS score FROM documents")
def _(spark, d):
    pred = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("lang"), F.lit("\n"))).otherwise("zz")
    return table(spark, d, "documents").select("doc_id", texts.category_score(F.lit("other"), pred, F.col("lang")).alias("score"))


@P.query("sim05_category_scores")
def _(spark, d):
    kinds = ["single_doc_qa", "multi_doc_qa", "few_shot", "synthetic", "summarization", "code", "other"]
    category = F.get(F.array(*map(F.lit, kinds)), (F.col("doc_id") % len(kinds)).cast("int"))
    pred = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("text"), F.lit("\n"))).otherwise(F.substring("text", 11, 2**31 - 1))
    return table(spark, d, "documents").select("doc_id", category.alias("category"), texts.category_score(category, pred, F.col("text")).alias("score"))


# ---- text repair
@P.query("str08_corrupted_args", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'b' || (p_size % 9) ELSE 'x' END AS a FROM part")
def _(spark, d):
    two = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.concat(F.lit("b"), (F.col("p_size") % 9).cast("string")))
    args = F.when(F.col("p_partkey") % 2 == 0, two).otherwise(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("x")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.element_at(texts.corrupted(args), F.lit("a")), F.lit("")).alias("a"))


@P.query("str10_anchor_match", r"SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') AS found FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.mentions(F.col("text"), F.lit("the")).alias("found"))


@P.query("str11_sections", r"SELECT doc_id, len(list_filter(regexp_split_to_array(replace(text, '.' || chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda s: regexp_replace(s, '\s', '', 'g') <> '')) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(texts.sections(F.replace("text", F.lit(".\n"), F.lit("\n\n")))).cast("long").alias("n"))


@P.query("str12_purity", "SELECT doc_id, NOT (contains(' ' || lower(text) || ' ', ' and ') OR contains(' ' || lower(text) || ' ', ' und ')) AS pure FROM documents")
def _(spark, d):
    words = F.split(F.lower("text"), " ")
    return table(spark, d, "documents").select("doc_id", (~F.arrays_overlap(words, F.array(F.lit("and"), F.lit("und")))).alias("pure"))


@P.query("str13_folded_key", r"SELECT doc_id, trim(regexp_replace(lower(replace(lang || ' X ' || source, 'X', 'ab')), '\s+', ' ', 'g')) AS key FROM documents")
def _(spark, d):
    odd = F.concat(F.lit("​"), F.col("lang"), F.lit("  ＡB  "), F.col("source"))
    return table(spark, d, "documents").select("doc_id", texts.folded_key(odd).alias("key"))


@P.query("str15_first_content", "SELECT min(doc_id) AS doc_id FROM documents WHERE length(text) >= 40 GROUP BY lower(text)")
def _(spark, d):
    rows = table(spark, d, "documents").filter(F.length("text") >= 40).select("doc_id", F.sha2(F.lower("text"), 256).alias("k"))
    return sampling.keep_first(rows, ["k"], ["doc_id"]).select("doc_id")


@P.query("str16_haystack", "SELECT r_regionkey, true AS found, 500 + length(r_name) + 1 AS n FROM region")
def _(spark, d):
    hay = texts.haystack(F.col("r_name"), "The grass is green. The sky is blue. ", 500, 0.5)
    return table(spark, d, "region").select("r_regionkey", F.contains(hay, F.col("r_name")).alias("found"), F.length(hay).alias("n"))


@P.query("str18_prompt_of_length", "SELECT p_partkey, p_size * 4 AS n FROM part")
def _(spark, d):
    prompt = F.substring(F.repeat(F.lit("lorem ipsum "), F.col("p_size")), F.lit(1), F.col("p_size") * 4)
    return table(spark, d, "part").select("p_partkey", F.length(prompt).alias("n"))


# ---- projections
@P.query("prj01_projected", over_dialog("SELECT conv_id, count(*) AS n, max(length(content)) AS longest FROM dialog GROUP BY conv_id"))
def _(spark, d):
    conv = ops.as_conversations(dialog(spark, d)).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("m"))
    return conv.select("conv_id", F.size("m").cast("long").alias("n"), F.array_max(F.transform("m", lambda m: F.length(m["content"]))).cast("long").alias("longest"))


@P.query("prj06_backfilled", over_dialog("SELECT conv_id, turn, src, dst FROM dialog WHERE role = 'assistant'"))
def _(spark, d):
    kept = F.when(F.col("turn") % 2 == 0, F.struct(F.lit("old").alias("src"), F.lit("old").alias("dst")))
    seen = F.get(markers.transitions(F.col("content")), 0)
    filled = F.struct(F.coalesce(seen["src"], kept["src"]).alias("src"), F.coalesce(seen["dst"], kept["dst"]).alias("dst"))
    return dialog(spark, d).filter("role = 'assistant'").select("conv_id", "turn", filled["src"].alias("src"), filled["dst"].alias("dst"))


@P.query("prj09_ground_truth", over_dialog("SELECT conv_id, count(*) AS n, max_by(dst, turn) AS terminal, max_by(dst, turn) = 'S3' AS reached FROM dialog WHERE role = 'assistant' GROUP BY conv_id"))
def _(spark, d):
    conv = ops.as_conversations(dialog(spark, d).filter("role = 'assistant'"))
    walk = conv.select("conv_id", F.flatten(F.transform("messages", lambda m: markers.transitions(m["content"]))).alias("w"))
    last = F.element_at("w", -1)["dst"]
    return walk.select("conv_id", F.size("w").cast("long").alias("n"), last.alias("terminal"), (last == "S3").alias("reached"))


_IDS = "SELECT conv_id, string_agg(s || '=S' || r, ',' ORDER BY r) AS ids FROM (SELECT conv_id, s, row_number() OVER (PARTITION BY conv_id ORDER BY min(k)) AS r FROM (SELECT conv_id, src AS s, turn * 2 AS k FROM dialog WHERE role = 'assistant' UNION ALL SELECT conv_id, dst, turn * 2 + 1 FROM dialog WHERE role = 'assistant') GROUP BY conv_id, s) GROUP BY conv_id"


@P.query("prj07_ids_by_mention", over_dialog(_IDS))
def _(spark, d):
    conv = ops.as_conversations(dialog(spark, d).filter("role = 'assistant'"))
    walk = F.flatten(F.transform("messages", lambda m: markers.transitions(m["content"])))
    names = conv.select("conv_id", F.array_distinct(F.flatten(F.transform(walk, lambda p: F.array(p["src"], p["dst"])))).alias("n"))
    return names.select("conv_id", F.array_join(F.transform("n", lambda s, i: F.concat(s, F.lit("=S"), (i + 1).cast("string"))), ",").alias("ids"))


@P.query("prj08_names_from_ids", over_dialog("SELECT conv_id, turn, src, dst FROM dialog WHERE role = 'assistant'"))
def _(spark, d):
    rows = dialog(spark, d).filter("role = 'assistant'").select("conv_id", "turn", F.get(markers.transitions(F.col("content")), 0).alias("t"))
    names = F.array(*[F.lit(f"S{i}") for i in range(4)])
    ids = rows.select("conv_id", "turn", F.array_position(names, F.col("t.src")).alias("a"), F.array_position(names, F.col("t.dst")).alias("b"))
    back = F.map_from_arrays(F.transform(names, lambda _, i: (i + 1).cast("long")), names)
    return ids.select("conv_id", "turn", F.element_at(back, F.col("a")).alias("src"), F.element_at(back, F.col("b")).alias("dst"))


@P.query("prj12_decoded_truth", "SELECT l_orderkey, l_linenumber, 'N' || l_linenumber AS src, l_returnflag AS dst FROM lineitem")
def _(spark, d):
    pair = F.struct(F.concat(F.lit("N"), F.col("l_linenumber").cast("string")).alias("from"), F.col("l_returnflag").alias("to"))
    text = F.to_json(F.struct(F.array(pair).alias("state_sequence")))
    parsed = F.from_json(text, "state_sequence array<struct<`from`:string,`to`:string>>")["state_sequence"]
    return _li(spark, d).select("l_orderkey", "l_linenumber", F.explode(parsed).alias("p")).select("l_orderkey", "l_linenumber", F.col("p.from").alias("src"), F.col("p.to").alias("dst"))


@P.query("prj14_prefixed", "SELECT doc_id, CASE ('0x' || substr(md5('2|' || doc_id), 1, 8))::UBIGINT % 3 WHEN 0 THEN 'Please: ' WHEN 1 THEN 'Task: ' ELSE '' END || lang AS prompt FROM documents")
def _(spark, d):
    at = F.conv(F.substring(F.md5(F.concat(F.lit("2|"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 3
    return table(spark, d, "documents").select("doc_id", F.concat(F.get(F.array(F.lit("Please: "), F.lit("Task: "), F.lit("")), at.cast("int")), F.col("lang")).alias("prompt"))


@P.query("prj15_response_mask", over_dialog("SELECT conv_id, sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS trained FROM (SELECT conv_id, role, len(string_split(content, ' ')) AS n FROM dialog) GROUP BY conv_id"))
def _(spark, d):
    mask = F.transform(F.split("content", " "), lambda w: F.when(F.col("role") == "assistant", F.length(w)).otherwise(-100))
    rows = dialog(spark, d).select("conv_id", "turn", mask.alias("m")).groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"])).alias("labels"))
    return rows.select("conv_id", F.size("labels").cast("long").alias("tokens"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("trained"))


@P.query("prj05_workflow_script", over_dialog("SELECT conv_id, string_agg(src || ': ' || nexts, chr(10) ORDER BY src) AS script FROM (SELECT conv_id, src, string_agg(DISTINCT dst, ' or ' ORDER BY dst) AS nexts FROM dialog WHERE role = 'assistant' GROUP BY conv_id, src) GROUP BY conv_id"))
def _(spark, d):
    edges = dialog(spark, d).filter("role = 'assistant'").select("conv_id", F.inline(markers.transitions(F.col("content"))))
    states = edges.groupBy("conv_id", "src").agg(F.array_join(F.array_sort(F.collect_set("dst")), " or ").alias("nexts"))
    lines = F.array_sort(F.collect_list(F.struct("src", "nexts")))
    return states.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda s: F.concat(s["src"], F.lit(": "), s["nexts"])), "\n").alias("script"))


@P.query("prj18_flattened_models", "SELECT DISTINCT CASE WHEN p_type LIKE 'A%' THEN p_brand ELSE p_type END AS model FROM part WHERE p_type <> '' ORDER BY model")
def _(spark, d):
    keys = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("models"))
    flat = keys.select("p_brand", F.explode("models").alias("m"))
    return flat.select(F.when(F.col("m").startswith("A"), F.col("p_brand")).otherwise(F.col("m")).alias("model")).distinct().orderBy("model")


# ---- joins
@P.query("join02_by_turn", over_dialog("SELECT a.conv_id, a.turn, a.role = b.role AS same FROM dialog a JOIN (SELECT * FROM dialog WHERE turn % 2 = 0) b ON a.conv_id = b.conv_id AND a.turn = b.turn"))
def _(spark, d):
    rows = dialog(spark, d)
    other = rows.filter("turn % 2 = 0").select("conv_id", "turn", F.col("role").alias("r"))
    return rows.join(other, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("role") == F.col("r")).alias("same"))


@P.query("join07_two_exclusions", over_dialog("SELECT DISTINCT md5(content) AS f FROM dialog WHERE role = 'user' AND (conv_id % 4 = 1 OR conv_id % 4 = 2)"))
def _(spark, d):
    prints = dialog(spark, d).filter("role = 'user'").select("conv_id", F.md5("content").alias("f"))
    first, second = prints.filter("conv_id % 4 = 1").select("f"), prints.filter("conv_id % 4 = 2").select("f")
    return first.unionByName(second).distinct()


@P.query("join17_produced_ids", over_dialog("""SELECT p.conv_id, p.turn AS produced, c.turn AS used FROM (SELECT conv_id, turn FROM dialog WHERE role = 'tool' AND conv_id % 2 = 1) p JOIN (SELECT conv_id, turn FROM dialog WHERE role = 'assistant') c ON p.conv_id = c.conv_id AND p.turn < c.turn"""))
def _(spark, d):
    rows = dialog(spark, d)
    produced = rows.filter("role = 'tool'").select("conv_id", F.col("turn").alias("produced"), F.explode(markers.id_tokens(F.col("content"))).alias("id")).filter(F.col("id").startswith("AB-"))
    calls = rows.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("used"), F.concat(F.lit("AB-"), F.col("conv_id").cast("string")).alias("id"))
    return produced.join(calls, ["conv_id", "id"]).filter("produced < used").select("conv_id", "produced", "used")


@P.query("join18_adjacent_segments", "SELECT a.l_orderkey, a.l_linenumber AS here, b.l_linenumber AS there FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber IN (a.l_linenumber, a.l_linenumber + 1) AND a.l_partkey % 5 = b.l_partkey % 5")
def _(spark, d):
    rows = _li(spark, d).select("l_orderkey", F.col("l_linenumber").alias("here"), (F.col("l_partkey") % 5).alias("k"))
    spread = rows.select("l_orderkey", "here", "k", F.explode(F.array(F.col("here"), F.col("here") + 1)).alias("there"))
    return spread.join(rows.withColumnRenamed("here", "there"), ["l_orderkey", "there", "k"]).select("l_orderkey", "here", "there")


# ---- roll-ups of probes
@P.query("agg03_pooled", "SELECT avg(f) AS f1 FROM (SELECT l_orderkey, avg((l_partkey % 3 = 0)::INT)::DOUBLE AS f FROM lineitem GROUP BY l_orderkey)")
def _(spark, d):
    return _li(spark, d).groupBy("l_orderkey").agg(F.avg((F.col("l_partkey") % 3 == 0).cast("int")).alias("f")).agg(F.avg("f").alias("f1"))


@P.query("agg05_graph_means", "SELECT sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE l_discount END) / count(*) AS ged, sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_tax END) / count(*) AS node_f1 FROM lineitem")
def _(spark, d):
    bad = F.col("l_returnflag") == "A"
    return _li(spark, d).agg((F.sum(F.when(bad, 1.0).otherwise(F.col("l_discount"))) / F.count("*")).alias("ged"), (F.sum(F.when(bad, 0.0).otherwise(F.col("l_tax"))) / F.count("*")).alias("node_f1"))


@P.query("agg27_free_running", "SELECT avg((l_tax > 0.03)::INT)::DOUBLE AS rate, count(*) FILTER (WHERE l_tax > 0.03 AND l_discount <= 0.03) AS only_a, count(*) FILTER (WHERE l_tax <= 0.03 AND l_discount > 0.03) AS only_b FROM lineitem")
def _(spark, d):
    a, b = F.col("l_tax") > 0.03, F.col("l_discount") > 0.03
    return _li(spark, d).agg(F.avg(a.cast("int")).alias("rate"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))


@P.query("agg28_pass_at_k_curve", "SELECT 1 AS k, avg(c / n::DOUBLE) AS p FROM (SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY l_orderkey)")
def _(spark, d):
    trials = _li(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    return trials.agg(F.avg(metrics.pass_at_k(F.col("n"), F.col("c"), 1)).alias("p")).select(F.lit(1).alias("k"), "p")


@P.query("agg29_prompt_stats", "SELECT l_orderkey, avg(l_tax) AS mean, stddev_pop(l_tax) AS std, count(DISTINCT trim(l_returnflag)) AS distinct_texts FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return _li(spark, d).groupBy("l_orderkey").agg(F.avg("l_tax").alias("mean"), F.stddev_pop("l_tax").alias("std"), F.countDistinct(F.trim("l_returnflag")).alias("distinct_texts"))


@P.query("agg30_profile_shares", "SELECT avg((l_linenumber > 1)::INT)::DOUBLE AS with_tool, avg((l_returnflag = 'N')::INT)::DOUBLE AS moving FROM lineitem")
def _(spark, d):
    return _li(spark, d).agg(F.avg((F.col("l_linenumber") > 1).cast("int")).alias("with_tool"), F.avg((F.col("l_returnflag") == "N").cast("int")).alias("moving"))


@P.query("agg31_wrong_rates", "SELECT l_linestatus AS kind, avg((l_tax > 0.05)::INT)::DOUBLE AS wrong, avg((l_tax > 0.05)::INT) FILTER (WHERE l_linenumber > 1)::DOUBLE AS wrong_with_tool FROM lineitem GROUP BY l_linestatus")
def _(spark, d):
    wrong = (F.col("l_tax") > 0.05).cast("int")
    return _li(spark, d).groupBy(F.col("l_linestatus").alias("kind")).agg(F.avg(wrong).alias("wrong"), F.avg(F.when(F.col("l_linenumber") > 1, wrong)).alias("wrong_with_tool"))


@P.query("agg32_generation_stats", "SELECT count(*) AS made, count(*) FILTER (WHERE l_returnflag = 'A') / greatest(count(*), 1)::DOUBLE AS rejected FROM lineitem")
def _(spark, d):
    return _li(spark, d).agg(F.count("*").alias("made"), (F.count_if(F.col("l_returnflag") == "A") / F.greatest(F.count("*"), F.lit(1))).alias("rejected"))


# ---- samples and splits
@P.query("srt02_group_split", "SELECT source, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (SELECT source, row_number() OVER (ORDER BY md5('8|' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))")
def _(spark, d):
    return hash_split(table(spark, d, "documents").select("source").distinct(), "source", 8, 0.8, 0.1)


@P.query("srt04_held_out_groups", "SELECT lang, CASE WHEN lang = 'es' THEN 'test' WHEN ('0x' || substr(md5('6|' || lang), 1, 8))::UBIGINT % 10 < 8 THEN 'train' ELSE 'validation' END AS split FROM (SELECT DISTINCT lang FROM documents)")
def _(spark, d):
    u = F.conv(F.substring(F.md5(F.concat(F.lit("6|"), F.col("lang"))), 1, 8), 16, 10).cast("long") % 10
    return table(spark, d, "documents").select("lang").distinct().select("lang", F.when(F.col("lang") == "es", "test").when(u < 8, "train").otherwise("validation").alias("split"))


@P.query("srt07_unique_prompts", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY left(text, 200) ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.left("text", F.lit(200)).alias("p")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").orderBy("doc_id").limit(100)


@P.query("srt11_negative_count", "SELECT floor(count(*) * 0.2::DOUBLE / (1 - 0.2::DOUBLE))::BIGINT AS negatives FROM documents WHERE lang = 'en'")
def _(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").agg(F.floor(F.count("*") * F.lit(0.2) / (1 - F.lit(0.2))).alias("negatives"))


@P.query("srt12_one_anchor", over_dialog("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('12|' || turn), turn) AS r FROM dialog WHERE role = 'assistant') WHERE r = 1 ORDER BY md5('12|' || conv_id), conv_id LIMIT 20"))
def _(spark, d):
    anchors = sampling.one_per_group(dialog(spark, d).filter("role = 'assistant'").select("conv_id", "turn"), "conv_id", "turn", 12)
    return anchors.orderBy(F.md5(F.concat(F.lit("12|"), F.col("conv_id").cast("string"))), "conv_id").limit(20)


@P.query("srt14_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(25)


# ---- validators
@P.query("val02_rationality", over_dialog("SELECT conv_id, 'no_user' AS defect FROM dialog GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') = 0 UNION ALL SELECT conv_id, 'no_tool_result' FROM dialog GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0) > 0 AND count(*) FILTER (WHERE role = 'tool') = 0"))
def _(spark, d):
    calls = (F.col("role") == "assistant") & (F.size(markers.call_blocks(F.col("content"))) > 0)
    facts = dialog(spark, d).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(calls).alias("calls"), F.count_if(F.col("role") == "tool").alias("results"))
    defects = F.array_compact(F.array(F.when(F.col("users") == 0, "no_user"), F.when((F.col("calls") > 0) & (F.col("results") == 0), "no_tool_result")))
    return facts.select("conv_id", F.explode(defects).alias("defect"))


@P.query("val03_call_samples", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'not JSON' WHEN event_id % 4 = 1 THEN 'no name' ELSE '' END AS error FROM events")
def _(spark, d):
    m = F.col("event_id") % 4
    raw = F.when(m == 0, "{bad").when(m == 1, F.col("props")).otherwise('{"name": "t", "arguments": {}}')
    name = jsonvalue.tool_call(raw)["name"]
    return table(spark, d, "events").select("event_id", F.when(name.isNull(), "not JSON").when(name == "", "no name").otherwise("").alias("error"))


@P.query("val04_profile_defects", over_dialog("SELECT conv_id, turn, 'call_while_moving' AS defect FROM dialog WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0 AND src <> dst UNION ALL SELECT conv_id, turn, 'error_result' FROM dialog WHERE role = 'tool' AND conv_id % 2 = 0"))
def _(spark, d):
    c = F.col("content")
    t = F.get(markers.transitions(c), 0)
    moving = F.when((F.col("role") == "assistant") & (F.size(markers.call_blocks(c)) > 0) & (t["src"] != t["dst"]), "call_while_moving")
    error = F.when((F.col("role") == "tool") & markers.is_error_result(c), "error_result")
    return dialog(spark, d).select("conv_id", "turn", F.explode(F.array_compact(F.array(moving, error))).alias("defect"))


@P.query("val06_anchor_coverage", "SELECT doc_id, (CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'de') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS coverage FROM documents")
def _(spark, d):
    anchors = F.array(F.lit("the"), F.lit("de"))
    return table(spark, d, "documents").select("doc_id", (F.size(F.filter(anchors, lambda a: F.contains("text", a))) / 2).alias("coverage"))


@P.query("val07_eligible", "SELECT n_name, l FROM nation, (VALUES (1), (2), (3)) v(l) WHERE l <= 1 + n_regionkey")
def _(spark, d):
    levels = spark.createDataFrame([(1,), (2,), (3,)], "l int")
    return table(spark, d, "nation").join(F.broadcast(levels), F.col("l") <= 1 + F.col("n_regionkey")).select("n_name", "l")


@P.query("val08_pair_contract", "SELECT count(*) AS n FROM documents")
def _(spark, d):
    pair = table(spark, d, "documents").select("doc_id", F.col("text").alias("chosen"), F.concat("text", F.lit("!")).alias("rejected"))
    checked = F.when(F.col("chosen") == F.col("rejected"), F.raise_error(F.lit("chosen equals rejected"))).otherwise(F.lit(1))
    return pair.agg(F.sum(checked).alias("n"))


@P.query("flt14_attribution", "SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY l_orderkey) WHERE len(list_filter(a, lambda x: NOT list_contains(['A', 'N'], x))) > 0")
def _(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("after"))
    return sets.filter(F.size(F.array_except("after", F.array(F.lit("A"), F.lit("N")))) > 0).select("l_orderkey")


@P.query("flt13_qualified_leg", over_dialog("SELECT conv_id FROM dialog GROUP BY conv_id HAVING count(*) FILTER (WHERE role <> 'system') > 0 AND count(*) FILTER (WHERE role = 'tool' AND conv_id % 2 = 0) = 0"))
def _(spark, d):
    rows = dialog(spark, d)
    clean = ops.keep_untruncated(ops.strip_messages(ops.as_conversations(rows)))
    defects = rows.filter((F.col("role") == "tool") & markers.is_error_result(F.col("content"))).select("conv_id")
    return clean.join(defects, "conv_id", "left_anti").select("conv_id")


@P.query("grf07_domain_invariants", "SELECT r_name, count(*) AS states, count(*) FILTER (WHERE n_name < r_name) AS early FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count("*").alias("states"), F.count_if(F.col("n_name") < F.col("r_name")).alias("early"))


# ---- generators
def _hash(key, seed):
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long")


@P.query("gen03_intent_samples", "SELECT i, 'intent' || h % 5 AS intent, 'domain' || h % 5 // 2 AS domain FROM (SELECT i, ('0x' || substr(md5('21|' || i), 1, 8))::UBIGINT AS h FROM range(500) t(i))")
def _(spark, d):
    k = _hash(F.col("id"), 21) % 5
    return spark.range(500).select(F.col("id").alias("i"), F.concat(F.lit("intent"), k.cast("string")).alias("intent"), F.concat(F.lit("domain"), F.floor(k / 2).cast("string")).alias("domain"))


@P.query("gen04_routing_rows", "SELECT i, CASE h % 3 WHEN 0 THEN 'billing' WHEN 1 THEN 'support' ELSE 'sales' END AS target FROM (SELECT i, ('0x' || substr(md5('22|' || i), 1, 8))::UBIGINT AS h FROM range(300) t(i))")
def _(spark, d):
    return spark.range(300).select(F.col("id").alias("i"), F.get(F.array(F.lit("billing"), F.lit("support"), F.lit("sales")), (_hash(F.col("id"), 22) % 3).cast("int")).alias("target"))


@P.query("gen06_calls_and_negatives", "SELECT i, i >= 160 AS negative FROM range(200) t(i)")
def _(spark, d):
    positives = 160
    return spark.range(positives + int(positives * 0.2 / 0.8)).select(F.col("id").alias("i"), (F.col("id") >= positives).alias("negative"))


@P.query("gen05_render_plans", "SELECT g, r AS register, ('0x' || substr(md5('23|' || (g || r)), 1, 8))::UBIGINT % 4 AS distractors FROM range(50) t(g), (VALUES ('formal'), ('casual')) v(r)")
def _(spark, d):
    registers = spark.createDataFrame([("formal",), ("casual",)], "register string")
    rows = spark.range(50).select(F.col("id").alias("g")).crossJoin(registers)
    return rows.select("g", "register", (_hash(F.concat(F.col("g").cast("string"), F.col("register")), 23) % 4).alias("distractors"))


@P.query("gen07_until_target", "SELECT i FROM (SELECT i, ('0x' || substr(md5('24|' || i), 1, 8))::UBIGINT % 10 AS h FROM range(400) t(i)) WHERE h < 7 ORDER BY i LIMIT 100")
def _(spark, d):
    return spark.range(400).select(F.col("id").alias("i"), (_hash(F.col("id"), 24) % 10).alias("h")).filter("h < 7").select("i").orderBy("i").limit(100)


@P.query("vec01_decoded_error")
def _(spark, d):
    levels = vectors.lloyd_max(64, 4)
    u = vectors.unit(F.col("embedding"))
    back = vectors.decode(vectors.encode(u, levels), levels)
    error = F.aggregate(F.zip_with(u, back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", error.alias("error"))


QUERIES, ORACLE = P.queries, P.oracle
