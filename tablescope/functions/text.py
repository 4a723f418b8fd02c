"""Text rendering helpers that must print numbers exactly like the reports do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed2(c: Column) -> Column:
    """Two fixed decimals, rounding the exact binary value half-even.

    ``format_number(x, '0.00')`` does that; NULL prints ``nan`` (a missing statistic),
    NaN prints ``nan`` and infinities print ``inf`` / ``-inf``.
    """
    x = c.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .otherwise(F.call_function("format_number", x, F.lit("0.00")))
    )


def lines(*parts: Column) -> Column:
    """Join lines with newlines; NULL parts (optional lines) are skipped."""
    return F.concat_ws("\n", *parts)
