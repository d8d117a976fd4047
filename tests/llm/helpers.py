"""Rows of ``documents`` for small tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", source="src0", ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def with_clashes(frame):
    """The same rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(7) for c in ("rank", "shard", "size", "target", "_row", "_key", "_class", "length", "copies", "node", "label")})


ODD = [None, "", " ", "\n\n", "a", "a", "A  a\ta", "é日本 x", "x" * 50_000, "w " * 20_000, "<|endoftext|> <s> ▁ \0", None, "l1\nl2\nl3\nl4", "l1\nl2\nl3\nz"]
