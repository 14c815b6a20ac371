"""Rows for small tables."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, more=""):
    """Documents of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    # columns whose names the operators could use themselves
    return df.selectExpr("*", *more.split(";")) if more else df


CLASHING = "1 AS id;'x' AS node;2 AS size;3.5 AS score;'k' AS text_key;7 AS target;0 AS `hash`;'q' AS `a.b`"


def prose(rnd: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rnd.randint(0, vocabulary)}" for _ in range(n)]
