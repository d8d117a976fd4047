"""State markers, tool-call blocks and the labels derived from them, as column expressions.

Three marker grammars exist side by side and each operator keeps its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker grammars and block forms of the corpus format.
MARKER = r"\[STATE:\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:→|->)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\]"  # states of scoring
LOOSE_MARKER = r"\[STATE:\s*([^\]\-→]+?)\s*(?:→|->)\s*([^\]]+?)\s*\]"  # states of preference pairs
ANY_MARKER = r"\[STATE:[^\]]*\]"
CALL_BLOCK = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
CALL_BLOCK_ALT = r"(?s)<\|tool_call\|>\s*(\{.*?\})\s*(?:<\|/tool_call\|>|$)"
ID_TOKEN = r"(?U)[A-Z]{2,}[-_]?\w*\d[\w-]*"
ERROR_SUBSTRINGS = ('"error"', '"Error"')


def transitions(content: Column, pattern: str = MARKER) -> Column:
    """All (src, dst) pairs of a message, in order."""
    src = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    dst = F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
    return F.coalesce(F.zip_with(src, dst, lambda a, b: F.struct(a.alias("src"), b.alias("dst"))), F.array())


def has_marker(content: Column, pattern: str = MARKER) -> Column:
    return F.coalesce(content.rlike(pattern), F.lit(False))


def call_blocks(content: Column) -> Column:
    """JSON texts of tool calls; the alternative form counts only where the first finds nothing."""
    first = F.regexp_extract_all(content, F.lit(CALL_BLOCK), F.lit(1))
    second = F.regexp_extract_all(content, F.lit(CALL_BLOCK_ALT), F.lit(1))
    return F.coalesce(F.when(F.size(first) > 0, first).otherwise(second), F.array().cast("array<string>"))


def call_names(content: Column) -> Column:
    return F.transform(call_blocks(content), lambda b: F.get_json_object(b, "$.name"))


def id_tokens(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(ID_TOKEN), F.lit(0))


def prose(content: Column) -> Column:
    """Text without tool calls and markers, stripped."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?is)<tool_call>.*?</tool_call>", ""), ANY_MARKER, "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def without_calls(content: Column) -> Column:
    """Text after its tool calls are dropped, runs of three and more newlines cut to two; null if it had none or nothing stays."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?s)<tool_call>.*?</tool_call>", ""), r"\n{3,}", "\n\n")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    return F.when(F.size(call_blocks(content)) > 0, F.nullif(bare, F.lit("")))


def is_error_result(content: Column) -> Column:
    """Substring test of a tool result."""
    found = F.lit(False)
    for part in ERROR_SUBSTRINGS:
        found |= F.contains(content, F.lit(part))
    return F.coalesce(found, F.lit(False))


def format_compliance(text: Column) -> Column:
    """1, less 0.5 for unbalanced call tags and 0.3 for a traceback or Python fence, at least 0."""
    unbalanced = F.regexp_count(text, F.lit("<tool_call>")) != F.regexp_count(text, F.lit("</tool_call>"))
    leaked = F.contains(text, F.lit("Traceback")) | F.contains(text, F.lit("```python"))
    return F.greatest(F.lit(1.0) - F.when(unbalanced, 0.5).otherwise(0.0) - F.when(leaked, 0.3).otherwise(0.0), F.lit(0.0))


def humanised(condition: Column) -> Column:
    """Snake case to words, without the prefixes of generated conditions, state ids and the word "to"; null is empty."""
    words = F.coalesce(condition, F.lit(""))
    for prefix in ("proceed_from_", "branch_"):
        words = F.replace(words, F.lit(prefix), F.lit(""))
    for pattern, put in (("_", " "), (r"\b[Ss][0-9]+\b", ""), (r"\bto\b", ""), (r"\s+", " ")):
        words = F.regexp_replace(words, pattern, put)
    return F.trim(words)


def shape(content: Column, characters: int) -> Column:
    """``fused`` call if the prose beside it has that many characters, else ``bare_call``; ``no_tool`` without one."""
    has = F.size(call_blocks(content)) > 0
    return F.when(~has, "no_tool").when(F.length(prose(content)) < characters, "bare_call").otherwise("fused")


THAI = "฀-๿"
OBSOLETE_THAI = "[ฃฅ]"


def script_defects(content: Column, language: Column) -> Column:
    """Array of defects of a message: Latin glued into Thai (not in code-switched text), obsolete consonants."""
    glued = (language != "code_switch") & content.rlike(f"[{THAI}][A-Za-z]+[{THAI}]")
    return F.array_compact(F.array(F.when(glued, "latin_in_thai"), F.when(content.rlike(OBSOLETE_THAI), "obsolete_consonant")))
