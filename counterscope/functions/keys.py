"""Query keys and row predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_digest(text: str = "digest_text") -> Column:
    """MD5 of the statement text; a server's own digest differs between versions.

    The NULL text of the overflow row gives ``''``. It is replaced after hashing, so an empty text keeps
    its own digest.
    """
    return F.coalesce(F.md5(F.col(text)), F.lit(""))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def query_key(digest: str = "digest", schema: str = "schema_name") -> Column:
    """``digest``, or ``digest.schema`` when a schema is known."""
    qualified = F.concat(F.col(digest), F.lit("."), F.col(schema))
    return F.when(F.col(schema) != "", qualified).otherwise(F.col(digest))


def with_text(key: Sequence[str]) -> list[Column]:
    """Key columns, plus the text form when the key is the digest and schema pair."""
    text = [query_key().alias("query_key")] if "digest" in key else []
    return [F.col(c) for c in key] + text


# A row of a statement that has not run: the one test behind the merge and the deltas.
IS_EMPTY = "(count_star = 0 and sum_timer_wait = 0)"


def is_empty() -> Column:
    return F.expr(IS_EMPTY)


def text_contains(name: str, needle: str, case_sensitive: bool = True) -> Column:
    """LIKE ``%needle%``: ``%`` and ``_`` in the needle are wildcards, a backslash is a plain character."""
    pattern = "%" + needle.replace("\\", "\\\\") + "%"
    return F.col(name).like(pattern) if case_sensitive else F.col(name).ilike(pattern)
