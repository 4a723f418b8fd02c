import datetime as dt
import json
import tempfile

from pyspark.sql import functions as F

from tablescope.operators import reports as RP
from tablescope.sources import sinks

TS = dt.datetime(2025, 3, 4, 5, 6, 7)


def _reports(spark):
    return spark.createDataFrame(
        [(1, "student_report", "isi A", "data/a.xlsx", True, 1, 2, 3),
         (2, "Finance_Report", "isi B", None, False, None, None, None),
         (3, "general", "isi C", "data/c.xlsx", None, 4, None, 4)],
        "report_id int, report_type string, report_text string, source_file string, is_valid boolean, "
        "prompt_tokens long, output_tokens long, total_tokens long")


def test_documents_routing_names_and_header(spark):
    docs = {r["report_id"]: r for r in RP.report_documents(_reports(spark), TS).collect()}
    assert docs[1]["report_kind"] == "student_reports" and docs[2]["report_kind"] == "finance_reports"
    assert docs[3]["report_kind"] == "" and docs[3]["path"] == "general_20250304_050607_3.md"
    assert docs[1]["path"] == "student_reports/student_report_20250304_050607_1.md"
    assert docs[1]["metadata_file"] == "metadata/student_report_20250304_050607_1_metadata.json"
    assert docs[1]["content"] == ("---\nGenerated: 2025-03-04 05:06:07\nSource: data/a.xlsx\nValidation: ✓ Pass\n"
                                  "Token Usage: prompt=1, output=2, total=3\n"
                                  "Generator: Report Generator\n---\nisi A")
    assert docs[2]["content"] == ("---\nGenerated: 2025-03-04 05:06:07\nValidation: ⚠ Issues detected\n"
                                  "Token Usage: prompt=n/a, output=n/a, total=n/a\n"
                                  "Generator: Report Generator\n---\nisi B")
    assert "Validation" not in docs[3]["content"] and "prompt=4, output=n/a, total=4" in docs[3]["content"]


def test_header_without_metadata(spark):
    df = spark.createDataFrame([(1, "x", "teks")], "report_id int, report_type string, report_text string")
    r = RP.report_documents(df, TS).first()
    assert r["content"] == "---\nGenerated: 2025-03-04 05:06:07\nGenerator: Report Generator\n---\nteks"


def test_listing_filters_by_kind_and_sorts_desc(spark):
    docs = RP.report_documents(_reports(spark), TS)
    assert [r["report_id"] for r in RP.list_reports(docs, "student").collect()] == [1]
    assert [r["report_id"] for r in RP.list_reports(docs, "finance_x").collect()] == [2]
    paths = [r["path"] for r in RP.list_reports(docs, "other").collect()]
    assert paths == sorted(paths, reverse=True) and len(paths) == 3
    made = [(r["report_kind"], r["path"], r["n_reports"]) for r in RP.reports_produced(docs).collect()]
    assert made == sorted(made) and [m[1] for m in sorted(made, key=lambda m: m[1], reverse=True)] == paths
    assert {(m[0], m[2]) for m in made} == {("student_reports", 1), ("finance_reports", 1), ("", 1)}


def test_saving_twice_keeps_both_and_lists_them(spark):
    out = tempfile.mkdtemp(prefix="reports-")
    docs = RP.report_documents(_reports(spark), TS)
    sinks.write_reports(docs.where("report_id <> 2"), out)
    sinks.write_reports(docs.where("report_id = 2"), out)
    listed = sinks.list_saved_reports(spark, out).collect()
    assert [r["report_id"] for r in listed] == [1, 3, 2] and len({r["path"] for r in listed}) == 3
    assert [r["report_id"] for r in sinks.list_saved_reports(spark, out, "student").collect()] == [1]
    text = spark.read.parquet(out).where("report_id = 1").first()["content"]
    assert text.startswith("---\nGenerated: 2025-03-04 05:06:07") and "isi A" in text


def test_one_file_per_report_accumulates(spark):
    out = tempfile.mkdtemp(prefix="reports-")
    docs = RP.report_documents(_reports(spark), TS)
    sinks.write_reports(docs.where("report_id <> 2"), out, one_file_per_report=True)
    sinks.write_reports(docs.where("report_id = 2"), out, one_file_per_report=True)
    listed = sinks.list_report_files(spark, out, "student").collect()
    assert len(listed) == 1 and "report_kind=student_reports/report_id=1/" in listed[0]["path"]
    assert len(sinks.list_report_files(spark, out).collect()) == 3


def test_metadata_json_keeps_nulls(spark):
    df = _reports(spark)
    meta = df.select("report_id", RP.metadata_json(
        F.col("source_file"), None, F.struct(F.col("is_valid").alias("is_valid")),
        RP.usage_struct(F.col("prompt_tokens"), F.col("output_tokens"), F.col("total_tokens")),
        F.lit(TS), F.lit(TS)).alias("metadata_json"))
    rec = json.loads(meta.where("report_id = 2").first()["metadata_json"])
    assert rec["source_file"] is None and rec["token_usage"] == {
        "prompt_tokens": None, "output_tokens": None, "total_tokens": None}
    assert rec["saved_at"] == "2025-03-04T05:06:07.000000"
    out = tempfile.mkdtemp(prefix="meta-")
    sinks.write_metadata(meta.where("report_id <> 2"), out)
    sinks.write_metadata(meta.where("report_id = 2"), out)
    saved = spark.read.parquet(out).collect()
    assert sorted(r["report_id"] for r in saved) == [1, 2, 3]
    assert all("\n  " in r["metadata_json"] for r in saved)  # indented
