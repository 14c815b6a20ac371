"""Server names out of connection strings such as ``user:secret@tcp(host:3306)/schema``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dsn_user(dsn: str = "dsn") -> Column:
    """Text before the first colon, ``''`` without one."""
    return F.when(F.col(dsn).contains(":"), F.substring_index(F.col(dsn), ":", 1)).otherwise(F.lit(""))


def dsn_host(dsn: str = "dsn") -> Column:
    """Text in the first parentheses, else after the last ``@``; the default port is dropped.

    The rest of the string is never returned, it may hold the password.
    """
    text = F.col(dsn)
    bare = F.when(text.contains("@"), F.substring_index(text, "@", -1)).otherwise(F.lit(""))
    host = F.when(text.contains("("), F.regexp_extract(text, r"\(([^)]*)\)", 1)).otherwise(bare)
    return F.regexp_replace(host, r"^(.+):3306$", "$1")


def server_name(user: Column, host: Column) -> Column:
    return F.concat(F.lit("'"), user, F.lit("'@'"), host, F.lit("'"))


def short_name(name: Column) -> Column:
    """At most 40 characters: the middle of a longer name becomes ``...``."""
    cut = F.concat(F.left(name, F.lit(18)), F.lit("..."), F.right(name, F.lit(19)))
    return F.when(F.length(name) > 40, cut).otherwise(name)
