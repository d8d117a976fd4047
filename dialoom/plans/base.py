"""How a plan module registers its queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialoom.sources import table


class Plans:
    """Queries by name, and DuckDB SQL for those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def keep(build):
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = build
            if sql:
                self.oracle[name] = sql
            return build

        return keep


#: Dialogue with state markers and tool calls, derived from ``conversations`` by arithmetic on ids; both engines run this text.
DIALOG = """
SELECT conv_id, turn, role, text, src, dst,
  CASE WHEN role = 'assistant' THEN '[STATE: ' || src || CASE WHEN turn % 2 = 0 THEN ' → ' ELSE ' -> ' END || dst || '] ' ||
      CASE WHEN (conv_id + turn) % 3 = 0 THEN '<tool_call>{"name": "t' || CAST(conv_id % 5 AS STRING) || '", "arguments": {"id": "' || CAST(turn AS STRING) || '"}}</tool_call>' ELSE text END
    WHEN role = 'tool' THEN CASE WHEN conv_id % 2 = 0 THEN '{"error": "E' || CAST(turn AS STRING) || '"}' ELSE '{"ok": "AB-' || CAST(conv_id AS STRING) || '"}' END
    ELSE text END AS content
FROM (
  SELECT conv_id, turn, text, CASE WHEN role = 'user' AND (conv_id + turn) % 3 = 0 THEN 'tool' ELSE role END AS role,
    CASE WHEN role = 'assistant' THEN 'S' || CAST((conv_id + turn) % 4 AS STRING) END AS src,
    CASE WHEN role = 'assistant' THEN 'S' || CAST((conv_id + turn + turn % 3) % 4 AS STRING) END AS dst
  FROM {conversations}) AS c
"""


def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = DIALOG.replace("{", "{{").replace("}", "}}").replace("{{conversations}}", "{conversations}")
    return spark.sql(text, conversations=table(spark, sf_dir, "conversations"))


def over_dialog(body: str) -> str:
    """SQL text over ``dialog`` for the oracle."""
    return "WITH dialog AS (" + DIALOG.replace("{conversations}", "conversations") + ") " + body
