"""Name normalisation used wherever two spellings of a table, column or code are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(c: Column | str) -> Column:
    """Trimmed, without backticks, lower case; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.replace(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("`"), F.lit("")))


def table_name(c: Column | str) -> Column:
    """As plain_name, keeping the last two dot-separated parts."""
    return F.substring_index(plain_name(c), ".", -2)


def py_table_name(name: str) -> str:
    """The same rule for names met outside a DataFrame."""
    return ".".join(name.strip().replace("`", "").lower().split(".")[-2:])
