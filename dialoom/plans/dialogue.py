"""Queries on dialogues: markers, calls, windows over turns, fingerprints, joins on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions import markers, metrics
from dialoom.operators import messages as ops
from dialoom.plans.base import Plans, dialog, over_dialog
from dialoom.sources import table

P = Plans()


@P.query("flt03_untruncated", over_dialog("SELECT conv_id, count(*) AS n FROM dialog GROUP BY conv_id HAVING count(*) FILTER (WHERE role <> 'system') > 0"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return ops.keep_untruncated(ops.as_conversations(dialog(spark, d))).select("conv_id", F.size("messages").cast("long").alias("n"))


@P.query("flt04_strip_messages", over_dialog("""SELECT conv_id, count(*) FILTER (WHERE role IN ('system', 'user', 'assistant', 'tool') AND NOT (role = 'tool' AND starts_with(content, '<tool_call>'))) AS n
  FROM (SELECT conv_id, CASE WHEN turn % 5 = 3 THEN 'narrator' ELSE role END AS role, CASE WHEN role = 'tool' AND conv_id % 3 = 0 THEN '<tool_call>{}' ELSE content END AS content FROM dialog) GROUP BY conv_id"""))
def _(spark, d):
    rows = dialog(spark, d).select(
        "conv_id", "turn", F.when(F.col("turn") % 5 == 3, "narrator").otherwise(F.col("role")).alias("role"),
        F.when((F.col("role") == "tool") & (F.col("conv_id") % 3 == 0), "<tool_call>{}").otherwise(F.col("content")).alias("content"),
    )
    return ops.strip_messages(ops.as_conversations(rows)).select("conv_id", F.size("messages").cast("long").alias("n"))


@P.query("flt05_terminal_flag", over_dialog("SELECT conv_id, coalesce(max_by(dst, turn) = 'S3', false) AS terminal_reached FROM dialog WHERE role = 'assistant' GROUP BY conv_id"))
def _(spark, d):
    rows = dialog(spark, d).filter("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("content").alias("content")))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda m: markers.transitions(m["content"])))
    return rows.select("conv_id", metrics.task_complete(pairs, F.array(F.lit("S3"))).alias("terminal_reached"))


_THAI_ROWS = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'ผมเป๋' || substr(text, 1, 3) || 'ตัว' WHEN doc_id % 11 = 0 THEN 'ฅุณ ' || text ELSE text END AS x, CASE WHEN doc_id % 2 = 0 THEN 'code_switch' ELSE lang END AS language FROM {documents}"


@P.query("flt06_script_defects", "SELECT doc_id, (CASE WHEN language <> 'code_switch' AND regexp_matches(x, '[฀-๿][A-Za-z]+[฀-๿]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '[ฃฅ]') THEN 1 ELSE 0 END)::INTEGER AS n_defects FROM (" + _THAI_ROWS.replace("{documents}", "documents") + ") WHERE doc_id IS NOT NULL")
def _(spark, d):
    rows = spark.sql(_THAI_ROWS, documents=table(spark, d, "documents"))
    return rows.select("doc_id", F.size(markers.script_defects(F.col("x"), F.col("language"))).alias("n_defects"))


@P.query("flt07_blocklist", over_dialog("SELECT conv_id, count(DISTINCT needle) AS n_needles FROM dialog JOIN (VALUES ('the '), ('error'), ('zzz')) v(needle) ON contains(content, needle) GROUP BY conv_id"))
def _(spark, d):
    needles = F.array(F.lit("the "), F.lit("error"), F.lit("zzz"))
    conv = ops.as_conversations(dialog(spark, d))
    hits = F.filter(needles, lambda n: F.exists("messages", lambda m: F.contains(m["content"], n)))
    return conv.select("conv_id", F.size(hits).cast("long").alias("n_needles")).filter("n_needles > 0")


@P.query("flt15_format_compliance", over_dialog("""SELECT conv_id, turn, greatest(1.0::DOUBLE - CASE WHEN o <> c THEN 0.5 ELSE 0 END - CASE WHEN contains(x, 'Traceback') OR contains(x, '```python') THEN 0.3 ELSE 0 END, 0)::DOUBLE AS score FROM (
  SELECT conv_id, turn, x, len(string_split(x, '<tool_call>')) AS o, len(string_split(x, '</tool_call>')) AS c FROM (SELECT conv_id, turn, content || CASE WHEN turn % 3 = 0 THEN '<tool_call>' WHEN turn % 4 = 1 THEN ' Traceback' ELSE '' END AS x FROM dialog))"""))
def _(spark, d):
    x = F.concat(F.col("content"), F.when(F.col("turn") % 3 == 0, "<tool_call>").when(F.col("turn") % 4 == 1, " Traceback").otherwise(""))
    return dialog(spark, d).select("conv_id", "turn", markers.format_compliance(x).alias("score"))


@P.query("prj02_sample_summary", over_dialog("SELECT conv_id, count(*) AS n_messages, left(min_by(content, turn) FILTER (WHERE role = 'user'), 120) AS preview FROM dialog GROUP BY conv_id"))
def _(spark, d):
    return dialog(spark, d).groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.left(F.min_by("content", F.when(F.col("role") == "user", F.col("turn"))), F.lit(120)).alias("preview"))


@P.query("prj10_sliced_prompts", over_dialog("""SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last, n, chars::BIGINT AS chars FROM (
  SELECT conv_id, turn, role, lag(role) OVER w AS p, count(*) OVER b AS n, coalesce(sum(length(content)) OVER b, 0) AS chars FROM dialog
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn), b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant' AND p IN ('user', 'system')"""))
def _(spark, d):
    chars = F.aggregate("prompt", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return ops.sliced_prompts(dialog(spark, d)).select("conv_id", "turn", "is_last", F.size("prompt").cast("long").alias("n"), chars.alias("chars"))


@P.query("prj11_segments", over_dialog("SELECT conv_id, segment::BIGINT AS segment, count(*) FILTER (WHERE role <> 'assistant') AS n_messages FROM (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM dialog) GROUP BY conv_id, segment"))
def _(spark, d):
    return ops.segments(dialog(spark, d)).groupBy("conv_id", "segment").agg(F.count_if(F.col("role") != "assistant").alias("n_messages"))


@P.query("prj16_context_window", over_dialog("SELECT conv_id, place, turn, role, content FROM dialog JOIN (SELECT conv_id, min(turn) AS place FROM dialog WHERE role = 'tool' GROUP BY conv_id) USING (conv_id) WHERE turn BETWEEN place - 2 AND place + 2 AND turn > 0"))
def _(spark, d):
    rows = dialog(spark, d)
    places = rows.filter("role = 'tool'").groupBy("conv_id").agg(F.min("turn").alias("place"))
    return ops.context_window(rows, places, 2)


@P.query("prj17_prose", over_dialog(r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(content, '(?s)<tool_call>.*?</tool_call>', '', 'g'), '\[STATE:[^\]]*\]', '', 'g'), '^\s+|\s+$', '', 'g') AS prose FROM dialog WHERE role = 'assistant'"))
def _(spark, d):
    return dialog(spark, d).filter("role = 'assistant'").select("conv_id", "turn", markers.prose(F.col("content")).alias("prose"))


@P.query("win01_continuity", over_dialog("""SELECT conv_id, turn, defect FROM (
  SELECT conv_id, turn, unnest([CASE WHEN came IS NULL AND src <> 'S0' THEN 'bad_start' END, CASE WHEN came <> src THEN 'broken_link' END, CASE WHEN nxt IS NULL AND dst NOT IN ('S2', 'S3') THEN 'bad_end' END]) AS defect
  FROM (SELECT conv_id, turn, src, dst, lag(dst) OVER w AS came, lead(turn) OVER w AS nxt FROM dialog WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) WHERE defect IS NOT NULL"""))
def _(spark, d):
    return ops.continuity_defects(dialog(spark, d), "S0", ["S2", "S3"])


@P.query("win02_consecutive_assistants", over_dialog("""SELECT conv_id, turn FROM (SELECT conv_id, turn, role, content, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'assistant' ELSE role END AS role, content FROM dialog) WHERE role <> 'system')
  WHERE role = 'assistant' AND p = 'assistant' AND NOT starts_with(regexp_replace(content, '^\\s*\\[STATE:[^\\]]*\\]\\s*', ''), '<tool_call>')""".replace("\\\\", "\\")))
def _(spark, d):
    rows = dialog(spark, d).withColumn("role", F.when(F.col("turn") % 3 == 1, "assistant").otherwise(F.col("role")))
    return ops.consecutive_assistants(rows)


@P.query("win05_prefix_fingerprint", over_dialog("SELECT conv_id, turn, md5(array_to_string(list(content) OVER (PARTITION BY conv_id ORDER BY turn), chr(0))) AS fingerprint FROM dialog WHERE role = 'user'"))
def _(spark, d):
    return ops.prefix_fingerprints(dialog(spark, d))


@P.query("hsh01_user_fingerprint", over_dialog("SELECT conv_id, md5(string_agg(content, chr(0) ORDER BY turn)) AS fingerprint FROM dialog WHERE role = 'user' GROUP BY conv_id"))
def _(spark, d):
    return ops.user_fingerprints(dialog(spark, d))


@P.query("win06_assistant_ordinal", over_dialog("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS ordinal FROM dialog WHERE role = 'assistant'"))
def _(spark, d):
    return ops.segments(dialog(spark, d)).filter("role = 'assistant'").select("conv_id", "turn", F.col("segment").alias("ordinal"))


@P.query("win09_last_flag", over_dialog("SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM dialog"))
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return dialog(spark, d).select("conv_id", "turn", (F.row_number().over(w) == 1).alias("is_last"))


@P.query("win11_collapsed_states", over_dialog("""SELECT conv_id, string_agg(s, '>' ORDER BY k) AS walk FROM (SELECT conv_id, s, k, lag(s) OVER (PARTITION BY conv_id ORDER BY k) AS p FROM (
  SELECT conv_id, dst AS s, turn AS k FROM dialog WHERE role = 'assistant' UNION ALL SELECT conv_id, min_by(src, turn), -1 FROM dialog WHERE role = 'assistant' GROUP BY conv_id)) WHERE p IS NULL OR p <> s GROUP BY conv_id"""))
def _(spark, d):
    rows = dialog(spark, d).filter("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda m: markers.transitions(m["content"])))
    return rows.select("conv_id", F.array_join(metrics.state_sequence(pairs), ">").alias("walk"))


@P.query("win18_announced_calls", over_dialog("""SELECT conv_id, turn, coalesce(r3, '') AS before FROM (SELECT conv_id, turn, role, contains(content, '<tool_call>') AS call, lag(role) OVER w AS r1, lag(role, 2) OVER w AS r2, lag(contains(content, '<tool_call>'), 2) OVER w AS c2, lag(role, 3) OVER w AS r3
  FROM dialog WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND call AND r1 IN ('user', 'system') AND r2 = 'assistant' AND NOT c2"""))
def _(spark, d):
    return ops.announced_calls(dialog(spark, d))


@P.query("str01_markers", over_dialog("SELECT conv_id, turn, src, dst FROM dialog WHERE role = 'assistant'"))
def _(spark, d):
    return dialog(spark, d).filter("role = 'assistant'").select("conv_id", "turn", F.inline(markers.transitions(F.col("content"))))


@P.query("str02_turn_label", over_dialog("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '→' ELSE '->' END AS arrow, CASE WHEN (conv_id + turn) % 3 = 0 THEN 't' || (conv_id % 5) ELSE '' END AS tools FROM dialog WHERE role = 'assistant'"))
def _(spark, d):
    arrow = F.regexp_extract(F.col("content"), r"\[STATE:\s*\w+\s*(→|->)", 1)
    return dialog(spark, d).filter("role = 'assistant'").select("conv_id", "turn", arrow.alias("arrow"), F.array_join(markers.call_names(F.col("content")), ",").alias("tools"))


@P.query("str03_tool_stay", over_dialog("SELECT conv_id, turn FROM dialog WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0 AND src <> dst"))
def _(spark, d):
    t = F.get(markers.transitions(F.col("content")), 0)
    return dialog(spark, d).filter((F.col("role") == "assistant") & (F.size(markers.call_blocks(F.col("content"))) > 0) & (t["src"] != t["dst"])).select("conv_id", "turn")


@P.query("str04_call_blocks", over_dialog("SELECT conv_id, turn, '{\"name\": \"t' || (conv_id % 5) || '\", \"arguments\": {\"id\": \"' || turn || '\"}}' AS block FROM dialog WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0"))
def _(spark, d):
    alt = F.when(F.col("turn") % 2 == 0, F.regexp_replace(F.regexp_replace(F.col("content"), "<tool_call>", "<|tool_call|>"), "</tool_call>", "")).otherwise(F.col("content"))
    return dialog(spark, d).filter("role = 'assistant'").select("conv_id", "turn", F.explode(markers.call_blocks(alt)).alias("block"))


@P.query("str05_id_tokens", over_dialog("SELECT conv_id, turn, 'AB-' || conv_id AS id FROM dialog WHERE role = 'tool' AND conv_id % 2 = 1"))
def _(spark, d):
    return dialog(spark, d).filter("role = 'tool' AND conv_id % 2 = 1").select("conv_id", "turn", F.explode(markers.id_tokens(F.col("content"))).alias("id"))


@P.query("str06_without_calls", over_dialog(r"SELECT conv_id, turn, nullif(regexp_replace(content, '\s*(?s)<tool_call>.*?</tool_call>', ''), '') AS rest FROM dialog WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0"))
def _(spark, d):
    return dialog(spark, d).filter((F.col("role") == "assistant") & (F.size(markers.call_blocks(F.col("content"))) > 0)).select("conv_id", "turn", markers.without_calls(F.col("content")).alias("rest"))


@P.query("str07_flipped_transition", over_dialog("""SELECT conv_id, turn, src, CASE WHEN src = dst THEN (SELECT min(e) FROM (VALUES ('S0', 'S1'), ('S0', 'S2'), ('S1', 'S3'), ('S2', 'S3')) v(s, e) WHERE s = src) ELSE src END AS flipped FROM dialog WHERE role = 'assistant'"""))
def _(spark, d):
    edges = spark.createDataFrame([("S0", ["S1", "S2"]), ("S1", ["S3"]), ("S2", ["S3"])], "src string, nexts array<string>")
    flipped = F.when(F.col("src") == F.col("dst"), F.array_min("nexts")).otherwise(F.col("src"))
    return dialog(spark, d).filter("role = 'assistant'").select("conv_id", "turn", F.inline(markers.transitions(F.col("content")))).join(F.broadcast(edges), "src", "left").select("conv_id", "turn", "src", flipped.alias("flipped"))


@P.query("str09_humanised", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(x, 'proceed_from_', ''), 'branch_', ''), '_', ' '), '\b[Ss]\d+\b', '', 'g'), '\bto\b', '', 'g'), '\s+', ' ', 'g')) AS words FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'proceed_from_S' || p_size || '_to_' WHEN p_size % 3 = 1 THEN 'branch_s' || p_size || 'x_' ELSE '' END || replace(lower(p_type), ' ', '__') AS x FROM part)")
def _(spark, d):
    size = F.col("p_size").cast("string")
    prefix = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("proceed_from_S"), size, F.lit("_to_"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("branch_s"), size, F.lit("x_"))).otherwise("")
    return table(spark, d, "part").select("p_partkey", markers.humanised(F.concat(prefix, F.replace(F.lower("p_type"), F.lit(" "), F.lit("__")))).alias("words"))


@P.query("str19_shape", over_dialog("SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'bare_call' ELSE 'no_tool' END AS shape FROM dialog WHERE role = 'assistant'"))
def _(spark, d):
    return dialog(spark, d).filter("role = 'assistant'").select("conv_id", "turn", markers.shape(F.col("content"), 20).alias("shape"))


@P.query("join15_next_tool_result", over_dialog("""SELECT conv_id, turn, (SELECT min(t.turn) FROM dialog t WHERE t.conv_id = a.conv_id AND t.role = 'tool' AND t.turn > a.turn AND NOT EXISTS (
  SELECT 1 FROM dialog x WHERE x.conv_id = a.conv_id AND x.role = 'assistant' AND x.turn > a.turn AND x.turn < t.turn)) AS result_turn FROM dialog a WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0"""))
def _(spark, d):
    return ops.next_tool_result(dialog(spark, d))


@P.query("join16_recovery", over_dialog("""SELECT conv_id, count(*) FILTER (WHERE role = 'tool' AND bad) AS errors, count(*) FILTER (WHERE role = 'assistant' AND healed) AS recovered FROM (
  SELECT a.*, conv_id % 2 = 0 AS bad, conv_id % 2 = 0 AND (SELECT max_by(b.role, b.turn) FROM dialog b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.role IN ('tool', 'assistant')) = 'tool' AS healed FROM dialog a) GROUP BY conv_id"""))
def _(spark, d):
    return ops.recoveries(dialog(spark, d))


_RES = "SELECT DISTINCT fingerprint FROM (SELECT conv_id, md5(string_agg(content, chr(0) ORDER BY turn)) AS fingerprint FROM dialog WHERE role = 'user' GROUP BY conv_id) WHERE conv_id % 4 = 1"


@P.query("join05_whole_anti", over_dialog(f"SELECT conv_id, fingerprint FROM (SELECT conv_id, md5(string_agg(content, chr(0) ORDER BY turn)) AS fingerprint FROM dialog WHERE role = 'user' GROUP BY conv_id) WHERE fingerprint NOT IN ({_RES})"))
def _(spark, d):
    prints = ops.user_fingerprints(dialog(spark, d))
    reserved = prints.filter("conv_id % 4 = 1").select("fingerprint").distinct()
    return prints.join(reserved, "fingerprint", "left_anti").select("conv_id", "fingerprint")


@P.query("join06_prefix_anti", over_dialog("""SELECT conv_id, turn FROM (SELECT conv_id, turn, md5(array_to_string(list(content) OVER (PARTITION BY conv_id ORDER BY turn), chr(0))) AS f FROM dialog WHERE role = 'user') p
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT conv_id AS c, md5(array_to_string(list(content) OVER (PARTITION BY conv_id ORDER BY turn), chr(0))) AS f FROM dialog WHERE role = 'user') q WHERE c % 4 = 1 AND q.f = p.f)"""))
def _(spark, d):
    prints = ops.prefix_fingerprints(dialog(spark, d))
    reserved = prints.filter("conv_id % 4 = 1").select("fingerprint").distinct()
    return prints.join(reserved, "fingerprint", "left_anti").select("conv_id", "turn")


@P.query("set02_union_reserved", over_dialog("SELECT count(*) AS n FROM (SELECT md5(content) AS f FROM dialog WHERE role = 'user' AND conv_id % 4 = 1 UNION SELECT md5(content) FROM dialog WHERE role = 'user' AND conv_id % 4 < 2)"))
def _(spark, d):
    rows = dialog(spark, d).filter("role = 'user'").select("conv_id", F.md5("content").alias("f"))
    return rows.filter("conv_id % 4 = 1").select("f").union(rows.filter("conv_id % 4 < 2").select("f")).distinct().agg(F.count("*").alias("n"))


@P.query("agg19_role_share", over_dialog("SELECT role, sum(length(content))::BIGINT AS chars, sum(length(content)) / (SELECT sum(length(content)) FROM dialog)::DOUBLE AS share FROM dialog GROUP BY role"))
def _(spark, d):
    by_role = dialog(spark, d).groupBy("role").agg(F.sum(F.length("content")).alias("chars"))
    return by_role.select("role", "chars", (F.col("chars") / F.sum("chars").over(Window.partitionBy()).cast("double")).alias("share"))


@P.query("jsn02_normalised_call", over_dialog("SELECT conv_id, turn, 't' || (conv_id % 5) AS name, turn::VARCHAR AS id FROM dialog WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0"))
def _(spark, d):
    block = F.get(markers.call_blocks(F.col("content")), 0)
    shaped = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"function": '), block, F.lit("}"))).otherwise(F.regexp_replace(block, '"arguments"', '"parameters"'))
    name = F.coalesce(F.get_json_object("b", "$.name"), F.get_json_object("b", "$.function.name"))
    args = F.coalesce(*[F.get_json_object("b", f"$.{p}") for p in ("arguments", "parameters", "function.arguments", "function.parameters")])
    rows = dialog(spark, d).filter((F.col("role") == "assistant") & block.isNotNull()).select("conv_id", "turn", shaped.alias("b"))
    return rows.select("conv_id", "turn", name.alias("name"), F.get_json_object(args, "$.id").alias("id"))


_CONVERTED = "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE role END AS gemma, CASE WHEN role = 'tool' THEN 'observation' ELSE role END AS glm, CASE WHEN role = 'tool' THEN '<tool_response>' || chr(10) || content || chr(10) || '</tool_response>' ELSE content END AS qwen FROM dialog"


@P.query("prj03_chat_formats", over_dialog(_CONVERTED))
def _(spark, d):
    wrapped = F.concat(F.lit("<tool_response>\n"), F.col("content"), F.lit("\n</tool_response>"))
    return dialog(spark, d).select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("gemma"),
        F.when(F.col("role") == "tool", "observation").otherwise(F.col("role")).alias("glm"), F.when(F.col("role") == "tool", wrapped).otherwise(F.col("content")).alias("qwen"),
    )


QUERIES, ORACLE = P.queries, P.oracle
