"""Column selection by type and by name; dataset type detection from header names.

P1 numeric columns, P2 text columns, P3 identifier exclusion, A4/A5 column count/list,
C6/C7/A26 type detection (per dataset over a names table, or for one DataFrame).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header keywords that decide the dataset type, checked in this order.
STUDENT_KEYWORDS = ("student", "mahasiswa", "nama", "grade", "nilai", "ipk", "gpa")
FINANCE_KEYWORDS = ("finance", "keuangan", "biaya", "pembayaran", "tagihan", "revenue", "expense")
# Numeric columns left out of a student profile when the lower-cased name
# contains one of these (substring match, so 'Bidang' matches 'id').
IDENTIFIER_KEYWORDS = ("nim", "id", "kode")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def positions(df: DataFrame) -> dict[str, int]:
    """1-based position of every column, the order columns are listed and rendered in."""
    return {f.name: i + 1 for i, f in enumerate(df.schema.fields)}


def _contains_any(c: Column, keywords) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(k) for k in keywords])


def names_table(df: DataFrame, dataset_id: str) -> DataFrame:
    """(dataset_id, position, column_name, data_type) for one DataFrame's schema."""
    spark = df.sparkSession
    rows = [(dataset_id, i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "dataset_id string, position int, column_name string, data_type string")


def detect_type_expr(student_hit: Column, finance_hit: Column) -> Column:
    return (F.when(student_hit, F.lit("student"))
            .when(finance_hit, F.lit("finance"))
            .otherwise(F.lit("unknown")))


def detect_types(names: DataFrame, dataset_cols=("dataset_id",), name_col: str = "column_name",
                 student_keywords=STUDENT_KEYWORDS, finance_keywords=FINANCE_KEYWORDS) -> DataFrame:
    """One row per dataset: (dataset cols..., detected_type). A partial aggregate of two booleans."""
    c = F.col(name_col)
    return (names.groupBy(*dataset_cols)
            .agg(F.bool_or(_contains_any(c, student_keywords)).alias("_stud"),
                 F.bool_or(_contains_any(c, finance_keywords)).alias("_fin"))
            .select(*dataset_cols, detect_type_expr(F.col("_stud"), F.col("_fin")).alias("detected_type")))


def detect_type(df_or_names, student_keywords=STUDENT_KEYWORDS,
                finance_keywords=FINANCE_KEYWORDS) -> str:
    """Type of one DataFrame from its header (schema metadata, no job)."""
    names = df_or_names.columns if isinstance(df_or_names, DataFrame) else list(df_or_names)
    low = [n.lower() for n in names]
    if any(k in n for n in low for k in student_keywords):
        return "student"
    if any(k in n for n in low for k in finance_keywords):
        return "finance"
    return "unknown"


def is_identifier_name(c: Column, keywords=IDENTIFIER_KEYWORDS) -> Column:
    return _contains_any(c, keywords)


def profiled_numeric_columns(df: DataFrame, detected_type: str, keys=(),
                             identifier_keywords=IDENTIFIER_KEYWORDS) -> list[str]:
    """Numeric columns that get statistics: identifiers are dropped for student data."""
    cols = numeric_columns(df, exclude=keys)
    if detected_type == "student":
        cols = [c for c in cols if not any(k in c.lower() for k in identifier_keywords)]
    return cols


def exclude_identifiers(names: DataFrame, types: DataFrame, dataset_cols=("dataset_id",),
                        name_col: str = "column_name", numeric_col: str = "is_numeric",
                        identifier_keywords=IDENTIFIER_KEYWORDS) -> DataFrame:
    """Numeric columns kept for statistics, per dataset, over a names table.

    ``types`` is the per-dataset detection result (one row per dataset), joined on the dataset key.
    """
    kept = (names.where(F.col(numeric_col))
            .join(types, list(dataset_cols), "left")
            .where(~((F.col("detected_type") == "student")
                     & is_identifier_name(F.col(name_col), identifier_keywords))))
    return kept.drop("detected_type")
