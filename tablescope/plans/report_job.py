"""The reference's whole flow as one batch over many tables:

scan → clean → profile → summary → prompt (by detected type) → generated text or fallback
→ validate → report documents. Generated text arrives as a table (the remote model call is
not part of this library); without one every report is the fallback text.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import profile as P
from ..operators import render as R
from ..operators import reports as RP
from ..operators import validate as V
from ..session import checkpoint
from . import inputs as I

# Which prompt template and which report type each detected type uses.
PROMPT_TYPE = {"student": "student_performance", "finance": "financial_analysis"}
SAVE_TYPE = {"student": "student_report", "finance": "finance_report"}
DEFAULT_PROMPT_TYPE = "general"
DEFAULT_SAVE_TYPE = "general_report"
DEFAULT_TS = dt.datetime(2025, 1, 15, 10, 30, 0)


def _map(c, mapping: dict, default: str):
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


def dataset_summaries(tables: dict[str, DataFrame], max_parallel: int = 4) -> DataFrame:
    """(dataset_id, detected_type, row_count, summary_text, analysis) for every table, cleaned first.

    Each table has its own schema, so each is its own small job graph; for many datasets with
    different headers use ``operators.cells`` (one job for all of them).
    """
    def one(item):
        name, df = item
        cleaned, report = C.clean(df)
        ds, num, cat = P.analyze(cleaned, name)
        # The profile tables are written (``analyze`` materialises them) and nothing below reads
        # the cleaned rows again: drop their cached copy instead of holding it for the whole job.
        report.release()
        text = R.summary_text(ds, num, cat)
        record = P.analysis_record(ds, num, cat)
        return (ds.select("dataset_id", "detected_type", "row_count").join(text, "dataset_id")
                .join(record, "dataset_id"))

    # The tables' clean/profile passes are independent jobs: submit them concurrently so small
    # tables share the cluster instead of queueing one after another.
    with ThreadPoolExecutor(max_workers=max(1, min(len(tables), max_parallel))) as pool:
        out = list(pool.map(one, tables.items()))
    return reduce(lambda a, b: a.unionByName(b), out)


def reports_from_summaries(summaries: DataFrame, generated: DataFrame | None = None,
                           ts: dt.datetime = DEFAULT_TS, source_prefix: str = "", source_suffix: str = ".parquet",
                           report_types: DataFrame | None = None) -> DataFrame:
    """One report row per dataset. ``report_types`` (dataset_id, report_type: student, finance or other): the kind the
    caller asks for; a dataset without one gets the kind of its detected type."""
    spark = summaries.sparkSession
    # One row per dataset, used by several joins below: materialise it once.
    summaries = checkpoint(summaries)
    if generated is None:
        generated = spark.createDataFrame(
            [], "dataset_id string, text string, prompt_tokens bigint, output_tokens bigint, total_tokens bigint")
    asked = summaries.withColumn("_type", F.col("detected_type"))
    if report_types is not None:
        asked = asked.join(report_types.select("dataset_id", F.col("report_type").alias("_asked")), "dataset_id", "left") \
            .withColumn("_type", F.coalesce("_asked", "detected_type"))
    req = asked.select(
        "dataset_id", "summary_text",
        _map(F.col("_type"), PROMPT_TYPE, DEFAULT_PROMPT_TYPE).alias("prompt_type"),
        _map(F.col("_type"), SAVE_TYPE, DEFAULT_SAVE_TYPE).alias("report_type"))
    req = req.withColumn("prompt", R.prompt_expr(F.col("summary_text"), F.col("prompt_type")))
    rep = R.attach_generated(req, generated).join(summaries.select("dataset_id", "analysis"), "dataset_id")
    checked = V.validate_reports(rep.withColumnRenamed("dataset_id", "report_id"))
    rows = (rep.withColumnRenamed("dataset_id", "report_id").join(checked, "report_id")
            .withColumn("source_file", F.concat(F.lit(source_prefix), F.col("report_id"), F.lit(source_suffix))))
    docs = RP.report_documents(rows, ts)
    meta = rows.select("report_id", RP.metadata_json(
        F.col("source_file"), F.col("analysis"),
        V.validation_struct(F.col("is_valid"), F.col("issues"), F.col("num_extracted")),
        RP.usage_struct(F.col("prompt_tokens"), F.col("output_tokens"), F.col("total_tokens")),
        RP.wall_clock(ts), RP.wall_clock(ts)).alias("metadata_json"))
    return (rows.select("report_id", "report_type", "prompt", "report_text", "is_valid", "issues",
                        "num_extracted").join(docs, "report_id").join(meta, "report_id"))


def report_job(spark: SparkSession, sf_dir: str, table_names, generated: DataFrame | None = None,
               ts: dt.datetime = DEFAULT_TS) -> DataFrame:
    tables = {t: I.load(spark, sf_dir, t) for t in table_names}
    return reports_from_summaries(dataset_summaries(tables), generated, ts, source_prefix=sf_dir.rstrip("/") + "/")


def workbook_report_job(spark: SparkSession, folder: str, target: str, report_types: DataFrame | None = None,
                        generated: DataFrame | None = None, ts: dt.datetime = DEFAULT_TS, expected=None, save_id: str | None = None):
    """Workbooks → reports in one flow: read a folder, clean and profile every workbook in long form, render, check
    and save; returns (reports, rejects). With ``save_id`` the save may be repeated (``sinks.save_reports``); without one it
    appends to ``reports/`` and ``metadata/`` under ``target``. Rejects are appended to ``rejects/``."""
    from ..operators import cells as CL
    from ..sources import sinks, workbook as W
    cells, rejects = W.read_workbooks(spark, folder, expected=expected)
    ds, num, cat, _ = CL.profile_cells(cells)
    summaries = (ds.select("dataset_id", "detected_type", "row_count").join(R.summary_text(ds, num, cat), "dataset_id")
                 .join(P.analysis_record(ds, num, cat), "dataset_id"))
    reports = checkpoint(reports_from_summaries(summaries, generated, ts, source_suffix="", report_types=report_types))
    if save_id is not None:
        sinks.save_reports(reports, target, save_id)
    else:
        sinks.write_reports(reports, f"{target.rstrip('/')}/reports")
        sinks.write_metadata(reports, f"{target.rstrip('/')}/metadata")
    rejects.write.mode("append").parquet(f"{target.rstrip('/')}/rejects")
    return reports, rejects
