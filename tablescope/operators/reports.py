"""Report documents: header + text, file naming and routing, metadata record, listing.

All row-local: one report row → one document row. The time stamp is a parameter, so the
same input renders the same documents (the reference reads the clock at save time).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Routing folders, header wording, generator line, label texts.
STUDENT_DIR = "student_reports"
FINANCE_DIR = "finance_reports"
ROOT_DIR = ""
GENERATOR_NAME = "Report Generator"
LABEL_PASS = "✓ Pass"
LABEL_ISSUES = "⚠ Issues detected"
FILE_TS_FORMAT = "yyyyMMdd_HHmmss"
HEADER_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def wall_clock(ts) -> Column:
    """A save time as a zone-less timestamp, so names and headers never shift with the
    session or machine time zone. Accepts a ``datetime``, a ``'YYYY-MM-DD HH:MM:SS'`` text or
    a timestamp column."""
    if isinstance(ts, _dt.datetime):
        return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    if isinstance(ts, str):
        return F.lit(ts).cast("timestamp_ntz")
    return ts


def report_kind(report_type: Column) -> Column:
    """P10: folder by report type, case-insensitive substring test."""
    low = F.lower(report_type)
    return (F.when(low.contains("student"), F.lit(STUDENT_DIR))
            .when(low.contains("finance"), F.lit(FINANCE_DIR))
            .otherwise(F.lit(ROOT_DIR)))


def file_name(report_type: Column, ts: Column, report_id: Column) -> Column:
    """``{type}_{yyyyMMdd_HHmmss}_{report_id}.md``; the id keeps reports of one type and second apart. Two ids never
    give one name: characters beyond letters, digits and ``. - _`` are percent-encoded (``report_id_of`` reads them back),
    and a null id is ``%``, which no encoded id is."""
    return F.concat(report_type, F.lit("_"), F.date_format(ts, FILE_TS_FORMAT), F.lit("_"),
                    F.coalesce(encoded_id(report_id), F.lit("%")), F.lit(".md"))


def encoded_id(report_id: Column) -> Column:
    """Percent-encoding that ``url_decode`` undoes, without the characters a file system gives a meaning (``*``)."""
    return F.replace(F.replace(F.url_encode(report_id.cast("string")), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def report_id_of(name: Column, report_type: Column) -> Column:
    """The report id in a ``file_name`` of the given type; null for a null id."""
    part = F.substring(name, F.length(report_type) + len("_yyyyMMdd_HHmmss_") + 1, F.length(name))
    part = F.substring(part, F.lit(1), F.length(part) - len(".md"))
    return F.when(part != "%", F.url_decode(part))


def metadata_file_name(name: Column) -> Column:
    """``.md`` → ``_metadata.json``."""
    return F.regexp_replace(name, r"\.md$", "_metadata.json")


def relative_path(kind: Column, name: Column) -> Column:
    return F.when(kind == "", name).otherwise(F.concat(kind, F.lit("/"), name))


def _na(c: Column) -> Column:
    """Missing count → n/a."""
    return F.coalesce(c.cast("string"), F.lit("n/a"))


def header_expr(ts: Column, source: Column | None = None, is_valid: Column | None = None,
                usage: Column | None = None, generator_name: str = GENERATOR_NAME) -> Column:
    """C22: '---', Generated, [Source], [Validation], [Token Usage], Generator, '---' + newline.

    Optional lines are present when their input column is given and non-null for the row
    (``concat_ws`` skips NULL lines).
    """
    parts = [F.lit("---"), F.concat(F.lit("Generated: "), F.date_format(ts, HEADER_TS_FORMAT))]
    if source is not None:
        parts.append(F.when(source.isNotNull(), F.concat(F.lit("Source: "), source)))
    if is_valid is not None:
        parts.append(F.when(is_valid.isNotNull(), F.concat(
            F.lit("Validation: "), F.when(is_valid, F.lit(LABEL_PASS)).otherwise(F.lit(LABEL_ISSUES)))))
    if usage is not None:
        parts.append(F.when(usage.isNotNull(), F.concat(
            F.lit("Token Usage: prompt="), _na(usage["prompt_tokens"]),
            F.lit(", output="), _na(usage["output_tokens"]),
            F.lit(", total="), _na(usage["total_tokens"]))))
    parts += [F.lit(f"Generator: {generator_name}"), F.lit("---\n")]
    return F.concat_ws("\n", *parts)


def usage_struct(prompt_tokens: Column, output_tokens: Column, total_tokens: Column) -> Column:
    """STRUCT<prompt_tokens, output_tokens, total_tokens>, each nullable."""
    return F.struct(prompt_tokens.cast("bigint").alias("prompt_tokens"),
                    output_tokens.cast("bigint").alias("output_tokens"),
                    total_tokens.cast("bigint").alias("total_tokens"))


def report_documents(reports: DataFrame, ts, generator_name: str = GENERATOR_NAME,
                     id_col: str = "report_id", type_col: str = "report_type", text_col: str = "report_text",
                     source_col: str | None = "source_file", valid_col: str | None = "is_valid",
                     usage_cols=("prompt_tokens", "output_tokens", "total_tokens"), keep=()) -> DataFrame:
    """(report_id, report_kind, file_name, path, metadata_file, content) per report, then the columns ``keep``.

    ``ts`` is a ``datetime`` or a timestamp column: the save time written into names and headers.
    """
    ts_col = wall_clock(ts)
    cols = set(reports.columns)
    src = F.col(source_col) if source_col and source_col in cols else None
    valid = F.col(valid_col) if valid_col and valid_col in cols else None
    usage = None
    if usage_cols and all(c in cols for c in usage_cols):
        usage = usage_struct(*[F.col(c) for c in usage_cols])
    kind = report_kind(F.col(type_col))
    name = file_name(F.col(type_col), ts_col, F.col(id_col))
    return reports.select(
        id_col,
        kind.alias("report_kind"),
        name.alias("file_name"),
        relative_path(kind, name).alias("path"),
        F.concat(F.lit("metadata/"), metadata_file_name(name)).alias("metadata_file"),
        F.concat(header_expr(ts_col, src, valid, usage, generator_name), F.col(text_col)).alias("content"),
        *keep,
    )


def metadata_json(source: Column, analysis: Column | None, validation: Column | None, usage: Column | None,
                  timestamp: Column, saved_at: Column) -> Column:
    """C27 + S9: the metadata record as JSON; null fields are kept (usage key always present)."""
    fields = [source.alias("source_file")]
    if analysis is not None:
        fields.append(analysis.alias("analysis"))
    if validation is not None:
        fields.append(validation.alias("validation"))
    fields.append((usage if usage is not None else F.lit(None).cast(
        "struct<prompt_tokens:bigint,output_tokens:bigint,total_tokens:bigint>")).alias("token_usage"))
    fields += [F.date_format(wall_clock(timestamp), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
               F.date_format(wall_clock(saved_at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("saved_at")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "pretty": "true"})


def list_reports(documents: DataFrame, report_type: str | None = None) -> DataFrame:
    """Report rows filtered by the type's folder, path descending.

    A student/finance type lists that folder; any other type, or none, lists everything.
    """
    df = documents
    if report_type:
        low = report_type.lower()
        if "student" in low:
            df = df.where(F.col("report_kind") == STUDENT_DIR)
        elif "finance" in low:
            df = df.where(F.col("report_kind") == FINANCE_DIR)
    return df.orderBy(F.col("path").desc())


def reports_produced(documents: DataFrame) -> DataFrame:
    """The produced paths as sorted rows, each with how many reports its folder got. (Rows, not
    one list per folder, which would grow with the folder.)"""
    n = documents.groupBy("report_kind").agg(F.count(F.lit(1)).alias("n_reports"))
    return documents.select("report_kind", "path").join(n, "report_kind").orderBy("report_kind", "path")
