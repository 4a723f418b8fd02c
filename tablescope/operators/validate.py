"""Report checks over a table of report texts.

Row-local checks (length, placeholder phrases, number count, claim extraction) are
plain column expressions. The entity check explodes the ``Departemen X`` mentions of each
text and anti-joins them with the known names of the report's dataset (J2); the claim
check equi-joins the dataset totals (J3). Issues come back to one array per row in
check order, mentions in text order. A report's mention list is bounded by its own text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt

# Check thresholds, phrases, patterns and messages.
MIN_CHARS = 200
PLACEHOLDER_PHRASES = ("tidak dapat", "data terbatas")
NUMBER_PATTERN = r"\d+(?:\.\d+)?"
DEPARTMENT_PATTERN = r"Departemen\s+([A-Za-z]+)"
CLAIM_PATTERN = r"mahasiswa\s*[=:]?\s*(\d+)"
MSG_TOO_SHORT = "Teks laporan terlalu pendek (<{n} karakter)"
MSG_PLACEHOLDER = "Laporan menyiratkan ketidakpastian atau kekurangan data"
MSG_UNKNOWN_DEPARTMENT = "Departemen '{}' disebut dalam teks, tapi tidak ada di data"
MSG_CLAIM = "Isi narasi menyebut total mahasiswa = {}, tetapi data menyebut {}"
CLAIM_TOLERANCE = 0.05


def number_count(text: Column) -> Column:
    """How many numbers (integers or decimals) the text holds."""
    return F.regexp_count(text, F.lit(NUMBER_PATTERN))


def too_short(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """C11: fewer than ``min_chars`` characters (code points)."""
    return F.length(text) < min_chars


def has_placeholder(text: Column, phrases=PLACEHOLDER_PHRASES) -> Column:
    """Lower-cased text contains any placeholder phrase."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def claimed_total(text: Column) -> Column:
    """C14: first ``mahasiswa = N`` claim as its digits (of any number, without leading zeros), NULL when absent."""
    digits = F.nullif(F.regexp_extract(text, CLAIM_PATTERN, 1), F.lit(""))
    return F.when(digits.isNotNull(), F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")))


def claim_off(claim: Column, total: Column, tolerance: float = CLAIM_TOLERANCE) -> Column:
    """|claim - total| > max(1, tolerance * total), in floating point like the reference."""
    t = total.cast("double")
    return F.abs(claim.cast("double") - t) > F.greatest(F.lit(1.0), F.lit(float(tolerance)) * t)


def local_issues(text: Column, min_chars: int = MIN_CHARS, phrases=PLACEHOLDER_PHRASES) -> Column:
    """Issues 1 and 2 as an array (missing ones filtered out)."""
    arr = F.array(F.when(too_short(text, min_chars), F.lit(MSG_TOO_SHORT.format(n=min_chars))),
                  F.when(has_placeholder(text, phrases), F.lit(MSG_PLACEHOLDER)))
    return F.filter(arr, lambda x: x.isNotNull())


def department_mentions(reports: DataFrame, id_col: str = "report_id", text_col: str = "report_text",
                        dataset_col: str = "dataset_id") -> DataFrame:
    """(report_id, dataset_id, occurrence, department): every mention, in text order."""
    return reports.select(
        id_col, dataset_col,
        F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(DEPARTMENT_PATTERN), 1))
        .alias("occurrence", "department"))


def unknown_departments(reports: DataFrame, departments: DataFrame, id_col: str = "report_id",
                        text_col: str = "report_text", dataset_col: str = "dataset_id") -> DataFrame:
    """Mentions whose name is not among the dataset's departments, once per occurrence.

    Datasets with no department list are not checked (the reference skips an empty list).
    """
    known = departments.select(dataset_col, "department").distinct()
    checked = known.select(dataset_col).distinct()
    mentions = department_mentions(reports, id_col, text_col, dataset_col)
    return (mentions.join(checked, dataset_col, "left_semi")
            .join(known, [dataset_col, "department"], "left_anti"))


def claim_checks(reports: DataFrame, totals: DataFrame, id_col: str = "report_id",
                 text_col: str = "report_text", dataset_col: str = "dataset_id") -> DataFrame:
    """(report_id, claimed, total_students, claim_ok) for reports whose dataset has a total."""
    t = dataset_totals(totals, dataset_col)
    return (reports.select(id_col, dataset_col, claimed_total(F.col(text_col)).alias("claimed"))
            .join(t, dataset_col, "inner")
            .select(id_col, "claimed", "total_students",
                    (F.col("claimed").isNull() | ~claim_off(F.col("claimed"), F.col("total_students")))
                    .alias("claim_ok")))


def dataset_totals(totals: DataFrame, dataset_col: str = "dataset_id") -> DataFrame:
    """(dataset, total_students): one row per dataset. Totals that repeat count once; two different totals of one dataset
    are an error in the data and fail the job, naming the dataset (reports are never multiplied by them)."""
    lo, hi = F.min(F.col("total_students").cast("bigint")), F.max(F.col("total_students").cast("bigint"))
    said = totals.groupBy(dataset_col).agg(lo.alias("_lo"), hi.alias("_hi"))
    clash = F.raise_error(F.concat(F.lit("two totals for dataset "), F.coalesce(F.col(dataset_col).cast("string"), F.lit("null"))))
    return said.select(dataset_col, F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo")).otherwise(clash.cast("bigint")).alias("total_students"))


def validate_reports(reports: DataFrame, departments: DataFrame | None = None,
                     totals: DataFrame | None = None, id_col: str = "report_id",
                     text_col: str = "report_text", dataset_col: str = "dataset_id",
                     min_chars: int = MIN_CHARS, phrases=PLACEHOLDER_PHRASES) -> DataFrame:
    """(report_id, is_valid, issues ARRAY<STRING>, num_extracted INT), one row per row of ``reports`` — A25.

    Each row is checked by itself, whatever its id: rows with a null id, and rows that share one, keep their own issues.
    A row's number, given once in a written table that holds no texts, goes with its mentions through the joins. A null
    text has no issues beyond what it lacks (no length, no phrase, no number); a report of a null dataset has no list
    to be checked against.
    """
    text = F.col(text_col)
    has_dataset = dataset_col in reports.columns
    base = reports.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
                          (F.col(dataset_col) if has_dataset else F.lit(None).cast("string")).alias(dataset_col),
                          F.coalesce(local_issues(text, min_chars, phrases), F.array().cast("array<string>")).alias("_local"),
                          number_count(text).alias("num_extracted"), claimed_total(text).alias("_claim"),
                          *([F.regexp_extract_all(text, F.lit(DEPARTMENT_PATTERN), 1).alias("_mentions")] if departments is not None else []))
    empty = F.array().cast("array<string>")
    out, entity_issues, claim_issue = base, empty, empty
    if departments is not None:
        out = _ckpt(base)
        known = departments.select(dataset_col, "department").distinct()
        mentions = out.select("_row", dataset_col, F.posexplode("_mentions").alias("_nth", "department"))
        bad = (mentions.join(known.select(dataset_col).distinct(), dataset_col, "left_semi")
               .join(known, [dataset_col, "department"], "left_anti"))
        per_row = bad.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_nth", "department"))).alias("_bad"))
        out = out.drop("_mentions").join(per_row, "_row", "left")
        entity_issues = F.coalesce(F.transform("_bad", lambda m: F.format_string(MSG_UNKNOWN_DEPARTMENT.replace("{}", "%s"), m["department"])), empty)
    if totals is not None:
        out = out.join(dataset_totals(totals, dataset_col).withColumnRenamed("total_students", "_total"), dataset_col, "left")
        off = F.col("_claim").isNotNull() & F.col("_total").isNotNull() & claim_off(F.col("_claim"), F.col("_total"))
        claim_issue = F.when(off, F.array(F.format_string(MSG_CLAIM.replace("{}", "%s"), F.col("_claim").cast("string"),
                                                          F.col("_total").cast("string")))).otherwise(empty)
    issues = F.concat(F.col("_local"), entity_issues, claim_issue)
    return out.select(F.col("_id").alias(id_col), (F.size(issues) == 0).alias("is_valid"), issues.alias("issues"),
                      F.col("num_extracted").cast("int").alias("num_extracted"))


def validation_struct(is_valid: Column, issues: Column, num_extracted: Column) -> Column:
    """STRUCT<is_valid, issues, num_extracted> as stored in report metadata."""
    return F.struct(is_valid.alias("is_valid"), issues.alias("issues"), num_extracted.alias("num_extracted"))
