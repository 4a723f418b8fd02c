"""Saves that may be repeated, names that tell ids apart, checks by row."""
import datetime as dt

import pytest

from tablescope.operators import reports as RP
from tablescope.operators import validate as V
from tablescope.sources import sinks

TS = dt.datetime(2025, 1, 15, 10, 30)
IDS = ["a b", "a_b", "a+b", "a%20b", "a/b", "A b", "", None, "%", "é", "*", "a*b", "x.md"]


def documents(spark, ids, note="n"):
    rows = spark.createDataFrame([(i, "student_report", f"text {i} {note}") for i in ids], "report_id string, report_type string, report_text string")
    docs = RP.report_documents(rows, TS, usage_cols=None)
    return docs.selectExpr("*", "concat('{\"id\": \"', coalesce(report_id, 'null'), '\"}') AS metadata_json")


def test_a_save_run_twice_is_there_once_and_two_saves_are_both_there(spark, tmp_path):
    root = str(tmp_path)
    sinks.save_reports(documents(spark, ["1", "2", "3"]), root, "first save")
    sinks.save_reports(documents(spark, ["4"]), root, "second/save")
    sinks.save_reports(documents(spark, ["1", "2", "5"], "again"), root, "first save")
    got = {r["report_id"]: r["content"] for r in sinks.saved_reports(spark, root).collect()}
    assert sorted(got) == ["1", "2", "4", "5"] and got["1"].endswith("text 1 again") and sinks.saved_reports(spark, root).count() == 4
    assert sorted(r["report_id"] for r in sinks.saved_metadata(spark, root).collect()) == ["1", "2", "4", "5"]
    assert len(sinks.committed_saves(spark, root)) == 2


def test_an_attempt_that_died_is_not_seen_and_goes_with_the_next(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "write_metadata", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.save_reports(documents(spark, ["1"]), root, "s")
    assert sinks.saved_reports(spark, root).count() == 0
    sinks.save_reports(documents(spark, ["1"]), root, "s")
    assert sinks.saved_reports(spark, root).count() == 1
    assert len(list((tmp_path / "saves").glob("*/*"))) == 1


def test_saves_of_similar_ids_stay_apart(spark, tmp_path):
    for k, name in enumerate(["s", "S", "s ", "s/", "=53", ""]):
        sinks.save_reports(documents(spark, [str(k)]).drop("metadata_json"), str(tmp_path), name)
    assert sinks.saved_reports(spark, str(tmp_path)).count() == 6
    assert sinks.saved_metadata(spark, str(tmp_path)).count() == 0


def test_distinct_ids_have_distinct_paths_that_read_back(spark):
    docs = documents(spark, IDS)
    from pyspark.sql import functions as F
    rows = docs.select("report_id", "path", RP.report_id_of(F.col("file_name"), F.lit("student_report")).alias("back")).collect()
    assert len({r["path"] for r in rows}) == len(IDS)
    assert all(r["back"] == r["report_id"] for r in rows)
    assert not any(c in r["path"].split("/", 1)[1] for r in rows for c in "/*+ ")


def test_rows_with_null_and_repeated_ids_keep_their_own_issues(spark):
    long = "kata " * 60
    rows = [(None, 1, f"Departemen Baru {long}"), (None, 1, long), (7, 1, f"Departemen Lain {long}"), (7, 1, f"mahasiswa = 90 {long}"), (7, 2, long), (8, None, f"Departemen X {long}")]
    reports = spark.createDataFrame(rows, "report_id int, dataset_id int, report_text string").repartition(3)
    departments = spark.createDataFrame([(1, "Lama"), (1, "Lama"), (None, "Y")], "dataset_id int, department string")
    totals = spark.createDataFrame([(1, 10), (1, 10), (3, None)], "dataset_id int, total_students int")
    got = sorted((str(r["report_id"]), r["is_valid"], tuple(r["issues"])) for r in V.validate_reports(reports, departments, totals).collect())
    unknown = "Departemen '{}' disebut dalam teks, tapi tidak ada di data"
    assert got == sorted([("None", False, (unknown.format("Baru"),)), ("None", True, ()), ("7", False, (unknown.format("Lain"),)),
                          ("7", False, ("Isi narasi menyebut total mahasiswa = 90, tetapi data menyebut 10",)), ("7", True, ()), ("8", True, ())])


def test_two_totals_of_one_dataset_are_an_error(spark):
    reports = spark.createDataFrame([(1, 1, "mahasiswa = 5")], "report_id int, dataset_id int, report_text string")
    totals = spark.createDataFrame([(1, 10), (1, 11)], "dataset_id int, total_students int")
    with pytest.raises(Exception, match="two totals for dataset 1"):
        V.validate_reports(reports, None, totals).collect()
