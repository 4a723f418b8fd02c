"""Number grammar for text → number coercion (comma decimals, whole-column rule)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number when a text column is coerced.
# Accepted: surrounding blanks, a sign, digits with an optional point, a leading point,
# an exponent, and the words inf / infinity in any case. Refused (whole column stays
# text): hex, underscores, Java type suffixes (1d, 1f), 'nan', repeated points, a lone blank.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"

# Cell texts a spreadsheet reader treats as missing.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def comma_to_dot(c: Column) -> Column:
    """Every ',' becomes '.', also in text that stays text."""
    return F.replace(c, F.lit(","), F.lit("."))


def is_number_text(c: Column) -> Column:
    return c.rlike(NUMBER_PATTERN)


def is_integer_text(c: Column) -> Column:
    return c.rlike(INTEGER_PATTERN)


def integer_range(c: Column) -> Column:
    """Of integer text: 0 within signed 64 bits, 1 only within unsigned 64 bits, 2 beyond both."""
    v = F.trim(c)
    wide = v.try_cast("decimal(38,0)")
    return (F.when(v.try_cast("bigint").isNotNull(), F.lit(0))
            .when(wide.isNotNull() & (wide >= 0) & (wide <= F.lit("18446744073709551615").cast("decimal(38,0)")), F.lit(1))
            .otherwise(F.lit(2)))


def text_to_double(c: Column) -> Column:
    """Guarded cast: only grammar-valid text reaches the cast."""
    return F.when(is_number_text(c), c.try_cast("double"))


def text_to_long(c: Column) -> Column:
    return F.when(is_integer_text(c), c.try_cast("bigint"))


def text_to_unsigned(c: Column) -> Column:
    """Whole numbers beyond signed but within unsigned 64 bits."""
    return F.when(is_integer_text(c), F.trim(c).try_cast("decimal(20,0)"))


def blank_is_missing(c: Column) -> Column:
    """'' counts as a missing cell, not as a failed conversion."""
    return F.when(c != "", c)


def nan_is_missing(c: Column) -> Column:
    """NaN and NULL are one notion of missing (floating columns only)."""
    return F.when(~F.isnan(c), c)


def markers_to_null(c: Column, markers=MISSING_MARKERS) -> Column:
    return F.when(~c.isin(*markers), c)
