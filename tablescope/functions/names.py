"""Safe column references for arbitrary header text (spaces, brackets, dots)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    """Column by exact name; a dot in a header is never read as struct access."""
    return F.col(quote(name))
