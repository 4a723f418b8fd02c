"""How a column is typed (S3, C2, C5, A20): every present cell gives one vote, and votes merge.

A vote is a few bits. A column's type follows from the bits that all of its cells set and the bits that any of them
sets: two integers per column, ``bit_and`` and ``bit_or``, which every partial aggregate merges. The wide tables, the
long form and the workbook reader all decide by these functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import INTEGER_PATTERN, NUMBER_PATTERN, comma_to_dot, integer_range

#: Texts that a reader takes for booleans when a whole column has no others.
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")

NUMBER = 1      # a number once commas are dots
COMMA = 2       # holds a comma: as read, it is no number
INTEGER = 4
UNSIGNED = 8    # a whole number beyond signed, within unsigned 64 bits
BEYOND = 16     # a whole number beyond both: its column stays text
BOOLEAN = 32
DATE = 64
INEXACT = 128   # a whole number that a double may not hold exactly


def vote(value: Column, kind: Column | None = None) -> Column:
    """The vote of a cell (null for a missing one). ``kind``: what a source knows of the cell: 'n' number, 's' text,
    'b' boolean, 'd' date; only the first two can be numbers."""
    dotted = comma_to_dot(value)
    as_long = F.trim(dotted).try_cast("bigint")
    whole = dotted.rlike(INTEGER_PATTERN)
    # The usual cases first: whole numbers within a double's exact range, then fractions.
    bits = (F.when(whole, F.when(F.abs(as_long) <= 1 << 53, NUMBER | INTEGER).when(as_long.isNotNull(), NUMBER | INTEGER | INEXACT)
                   .when(integer_range(dotted) == 1, NUMBER | INTEGER | INEXACT | UNSIGNED).otherwise(NUMBER | INTEGER | INEXACT | BEYOND))
            .when(dotted.rlike(NUMBER_PATTERN), F.when(value.contains(","), NUMBER | COMMA).otherwise(NUMBER))
            .otherwise(F.when(value.contains(","), COMMA).otherwise(0)))
    is_bool = value.isin(*BOOLEAN_TEXTS)
    if kind is None:
        bits = bits + F.when(is_bool, BOOLEAN).otherwise(0)
    else:
        bits = (F.when(kind.isin("n", "s"), bits).otherwise(0) + F.when((kind == "b") | is_bool, BOOLEAN).otherwise(0)
                + F.when(kind == "d", DATE).otherwise(0))
    return F.when(value.isNotNull(), bits).cast("int")


def tally(v: Column, every: str, some: str) -> list[Column]:
    """The two aggregates of a column's votes."""
    return [F.bit_and(v).alias(every), F.bit_or(v).alias(some)]


def has(bits: Column, flag: int) -> Column:
    return F.coalesce(bits.bitwiseAND(F.lit(flag)) != 0, F.lit(False))


def is_number(every: Column, some: Column, as_read: bool = False) -> Column:
    """All cells are numbers that their column's type can hold; ``as_read``: without turning commas into dots."""
    return has(every, NUMBER) & ~has(some, BEYOND | (COMMA if as_read else 0))


def number_type(every: Column, some: Column, full: Column) -> Column:
    """bigint, decimal(20,0) or double for a column of numbers; whole numbers need a column without gaps (``full``)."""
    return F.when(~(has(every, INTEGER) & full), "double").when(has(some, UNSIGNED), "decimal(20,0)").otherwise("bigint")


def read_type(every: Column, some: Column, full: Column) -> Column:
    """The type a reader gives the column: as ``number_type``, else boolean, timestamp or string."""
    return (F.when(is_number(every, some, as_read=True), number_type(every, some, full))
            .when(has(every, BOOLEAN), "boolean").when(has(every, DATE), "timestamp").otherwise("string"))


def cleaned_class(every: Column, some: Column) -> Column:
    """The column's class once commas are dots: empty, numeric, bool, date or text."""
    return (F.when(every.isNull(), "empty").when(is_number(every, some), "numeric")
            .when(has(every, BOOLEAN), "bool").when(has(every, DATE), "date").otherwise("text"))
