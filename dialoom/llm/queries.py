"""Queries of the operators of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers

from dialoom.llm import ann, exactdedup, langid, linededup, mixing, neardup, packing, sharding, tokencount, urlfilter
from dialoom.llm.storage import table


def queries() -> dict:
    return {
        "op1_packing": lambda spark, d: packing.op1_packing(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
        "op2_tokencount": lambda spark, d: tokencount.token_counts(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
        "op3_mixing": lambda spark, d: mixing.op3_mixing(table(spark, d, "documents")),
        "op4_exactdedup": lambda spark, d: exactdedup.exact_duplicates(table(spark, d, "documents")),
        "op5_ann": lambda spark, d: ann.op5_ann(table(spark, d, "embeddings")),
        "op6_langid": lambda spark, d: langid.op6_langid(table(spark, d, "documents")),
        "op7_linededup": lambda spark, d: linededup.op7_linededup(table(spark, d, "documents")),
        "op8_sharding": lambda spark, d: sharding.op8_sharding(table(spark, d, "documents")),
        "op9_urlfilter": lambda spark, d: urlfilter.judge_urls(table(spark, d, "pages"), urlfilter.RULES),
        "op10_neardup": lambda spark, d: neardup.op10_neardup(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exactdedup": exactdedup.ORACLE, "op7_linededup": linededup.ORACLE, "op9_urlfilter": urlfilter.ORACLE}
