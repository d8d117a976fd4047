"""Operators on long message tables (conv, turn, role, content) and on conversations as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import markers

ROLES = ("system", "user", "assistant", "tool")  # fixed values: roles a corpus may hold


def ordered(key: str = "conv_id", order: str = "turn"):
    return Window.partitionBy(key).orderBy(order)


def as_conversations(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a conversation with its messages in order."""
    fields = F.struct("turn", "role", "content")
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("messages"))


def keep_untruncated(conversations: DataFrame) -> DataFrame:
    """Conversations that hold more than system messages."""
    return conversations.filter(F.exists("messages", lambda m: m["role"] != "system"))


def strip_messages(conversations: DataFrame) -> DataFrame:
    """Drop messages of unknown role and tool messages that are calls in disguise."""
    def fine(m: Column) -> Column:
        disguised = (m["role"] == "tool") & m["content"].startswith("<tool_call>")
        return F.coalesce(m["role"].isin(*ROLES), F.lit(False)) & ~F.coalesce(disguised, F.lit(False))

    return conversations.withColumn("messages", F.filter("messages", fine))


def sliced_prompts(messages: DataFrame) -> DataFrame:
    """One row for each assistant turn that follows a user or system message: prompt and last-of-conversation flag."""
    w = ordered()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prompt = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content")).over(before)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    rows = messages.withColumn("prompt", prompt).withColumn("previous", F.lag("role").over(w))
    picked = rows.filter((F.col("role") == "assistant") & F.col("previous").isin("user", "system"))
    last = F.max("turn").over(Window.partitionBy("conv_id")) == F.col("turn")
    return picked.withColumn("is_last", last).select("conv_id", "turn", "prompt", "is_last")


def segments(messages: DataFrame) -> DataFrame:
    """Number of assistant turns so far: messages after the k-th assistant turn form segment k."""
    return messages.withColumn("segment", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))


def continuity_defects(messages: DataFrame, initial: str, terminals: list[str]) -> DataFrame:
    """Defects of the annotated walk: wrong start, broken link, wrong end, and turns without a marker."""
    marked = messages.filter(F.col("role") == "assistant").withColumn("t", F.get(markers.transitions(F.col("content")), 0))
    w = Window.partitionBy("conv_id").orderBy("turn")
    bare = marked.filter(F.col("t").isNull()).select("conv_id", "turn", F.lit("no_marker").alias("defect"))
    walk = marked.filter(F.col("t").isNotNull()).select("conv_id", "turn", "t.src", "t.dst", F.lag("t.dst").over(w).alias("came"), F.lead("turn").over(w).alias("next"))
    start = F.when(F.col("came").isNull() & (F.col("src") != initial), "bad_start")
    link = F.when(F.col("came") != F.col("src"), "broken_link")
    end = F.when(F.col("next").isNull() & ~F.col("dst").isin(*terminals), "bad_end")
    found = walk.select("conv_id", "turn", F.explode(F.array_compact(F.array(start, link, end))).alias("defect"))
    return found.unionByName(bare)


def consecutive_assistants(messages: DataFrame) -> DataFrame:
    """Assistant turns right after another one (system messages aside) that are not pure calls."""
    w = ordered()
    rows = messages.filter(F.col("role") != "system").withColumn("previous", F.lag("role").over(w))
    bare = F.regexp_replace("content", r"^\s*" + markers.ANY_MARKER + r"\s*", "")
    return rows.filter((F.col("role") == "assistant") & (F.col("previous") == "assistant") & ~bare.startswith("<tool_call>")).select("conv_id", "turn")


def prefix_fingerprints(messages: DataFrame) -> DataFrame:
    """Digest of all user texts up to each user turn."""
    so_far = F.array_join(F.collect_list("content").over(ordered().rowsBetween(Window.unboundedPreceding, 0)), "\x00")
    return messages.filter(F.col("role") == "user").select("conv_id", "turn", F.md5(so_far).alias("fingerprint"))


def user_fingerprints(messages: DataFrame) -> DataFrame:
    """Digest of all user texts of each conversation."""
    texts = F.array_sort(F.collect_list(F.struct("turn", "content")))
    joined = F.array_join(F.transform(texts, lambda m: m["content"]), "\x00")
    return messages.filter(F.col("role") == "user").groupBy("conv_id").agg(F.md5(joined).alias("fingerprint"))


def recoveries(messages: DataFrame) -> DataFrame:
    """Tool errors and the assistant turns that recover from them: the last tool or assistant message before one decides."""
    event = F.when(F.col("role").isin("tool", "assistant"), F.struct("role", markers.is_error_result(F.col("content")).alias("bad")))
    before = F.last(event, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    rows = messages.withColumn("before", before)
    failed = (F.col("role") == "tool") & markers.is_error_result(F.col("content"))
    healed = (F.col("role") == "assistant") & (F.col("before.role") == "tool") & F.col("before.bad") & markers.has_marker(F.col("content"))
    return rows.groupBy("conv_id").agg(F.count_if(failed).alias("errors"), F.count_if(healed).alias("recovered"))


def next_tool_result(messages: DataFrame) -> DataFrame:
    """For each assistant turn with calls, the first tool message before the next assistant turn."""
    run = segments(messages)
    after = Window.partitionBy("conv_id", "segment").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    found = F.first(F.when(F.col("role") == "tool", F.col("turn")), ignorenulls=True).over(after)
    return run.withColumn("result_turn", found).filter((F.col("role") == "assistant") & (F.size(markers.call_blocks(F.col("content"))) > 0)).select("conv_id", "turn", "result_turn")


def announced_calls(messages: DataFrame) -> DataFrame:
    """A call turn after a user or system message that follows a narrating assistant turn."""
    w = ordered()
    has_call = F.size(markers.call_blocks(F.col("content"))) > 0
    rows = messages.select(
        "conv_id", "turn", "role", has_call.alias("call"), F.lag("role", 1).over(w).alias("r1"), F.lag("role", 2).over(w).alias("r2"),
        F.lag(has_call, 2).over(w).alias("c2"), F.lag("role", 3).over(w).alias("r3"),
    )
    return rows.filter((F.col("role") == "assistant") & F.col("call") & F.col("r1").isin("user", "system") & (F.col("r2") == "assistant") & ~F.col("c2")).select("conv_id", "turn", F.coalesce("r3", F.lit("")).alias("before"))


def context_window(messages: DataFrame, places: DataFrame, radius: int = 6) -> DataFrame:
    """Messages within ``radius`` of a row of ``places`` (conv_id, place), never the first message."""
    near = (F.col("turn") >= F.col("place") - radius) & (F.col("turn") <= F.col("place") + radius) & (F.col("turn") > 0)
    return messages.join(places, "conv_id").filter(near).select("conv_id", "place", "turn", "role", "content")
