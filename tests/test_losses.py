"""Nothing is lost: long digits, blank rows, empty datasets, error cells, large claims, names, leftovers."""

import os
import subprocess
import sys
import tempfile

import pytest

from tablescope.operators import cells as CL
from tablescope.operators import clean as C
from tablescope.operators import profile as P
from tablescope.operators import render as R
from tablescope.operators import reports as RP
from tablescope.operators import synth as Y
from tablescope.operators import validate as V
from tablescope.plans import report_job as J
from tablescope.session import checkpoint, release
from tablescope.sources import sinks
from tablescope.sources import workbook as W
from xlsx_writer import write_xlsx

CELL = "dataset_id string, row_no bigint, position int, value string, kind string, is_header boolean"


def _folder(sheets):
    d = tempfile.mkdtemp(prefix="loss-")
    for name, rows in sheets.items():
        write_xlsx(os.path.join(d, name), rows)
    return d


def test_integers_beyond_64_bits_keep_the_column_text(spark):
    df = spark.createDataFrame([("12",), ("99999999999999999999",)], "x string")
    assert sorted(r["x"] for r in C.coerce_numbers(df).collect()) == ["12", "99999999999999999999"]
    unsigned = spark.createDataFrame([("12",), ("18446744073709551615",)], "x string")
    assert sorted(int(r["x"]) for r in C.coerce_numbers(unsigned).collect()) == [12, 18446744073709551615]
    very_long = spark.createDataFrame([("1",), ("-" + "9" * 60,)], "x string")
    assert dict(C.coerce_numbers(very_long).dtypes)["x"] == "string"


def test_rows_without_values_are_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, None)], "d string, k long, v string")
    r = CL.cleaning_summary(CL.stack_table(df, "d", "k", ["v"])).first()
    assert (r["rows_in"], r["rows_out"], r["duplicates_removed"]) == (3, 2, 1)


def test_blank_workbook_rows_header_only_and_all_empty_datasets(spark):
    d = _folder({"gap.xlsx": [["a", "b"], [1, "x"], [None, None], [3, "y"]], "header.xlsx": [["a", "b"]],
                 "empty.xlsx": [["a", "b"], [None, "N/A"], [None, "NULL"]]})
    cells, rejects = W.read_workbooks(spark, d)
    ds, num, cat, summary = CL.profile_cells(cells)
    got = {os.path.basename(r["dataset_id"]): r for r in summary.collect()}
    assert set(got) == {"gap.xlsx", "header.xlsx", "empty.xlsx"}
    assert (got["gap.xlsx"]["rows_in"], got["gap.xlsx"]["rows_out"]) == (3, 3)
    assert (got["header.xlsx"]["rows_in"], got["header.xlsx"]["empty_columns_dropped"]) == (0, 2)
    assert {os.path.basename(r["dataset_id"]): (r["row_count"], r["column_count"]) for r in ds.collect()} == {
        "gap.xlsx": (3, 2), "header.xlsx": (0, 0), "empty.xlsx": (got["empty.xlsx"]["rows_out"], 0)}
    assert R.summary_text(ds, num, cat).count() == 3 and rejects.count() == 0
    path = [r[0] for r in cells.select("dataset_id").distinct().collect() if r[0].endswith("gap.xlsx")][0]
    assert [r["a"] for r in W.data_columns(W.workbook_frame(cells, path)).collect()] == [1.0, None, 3.0]


def _mixed(spark):
    rows = [("d", 0, 1, "n", "s", True), ("d", 0, 2, "b", "s", True)]
    for i, (v, k) in enumerate([("12", "s"), ("12", "n"), ("012", "s")], 1):
        rows += [("d", i, 1, v, k, False), ("d", i, 2, "True" if i % 2 else "TRUE", "s" if i % 2 else "b", False)]
    return spark.createDataFrame(rows, CELL)


def test_copies_are_found_on_typed_values_as_in_a_wide_table(spark):
    cells = _mixed(spark).where("position = 1")
    wide, rep = C.clean(W.data_columns(W.workbook_frame(cells, "d")))
    assert rep.rows_out == 1 and CL.cleaning_summary(cells).first()["rows_out"] == 1
    assert wide.first()["n"] == 12


def test_true_false_text_is_a_boolean_column(spark):
    assert dict(W.workbook_frame(_mixed(spark), "d").dtypes)["b"] == "boolean"
    _, _, cat, _ = CL.profile_cells(_mixed(spark))
    assert cat.count() == 0


def test_error_cells_are_missing(spark):
    rows = [("d", 0, 1, "n", "s", True), ("d", 1, 1, "1", "n", False), ("d", 2, 1, None, "e", False), ("d", 3, 1, "#DIV/0!", "e", False)]
    cells = spark.createDataFrame(rows, CELL)
    assert dict(W.workbook_frame(cells, "d").dtypes)["n"] == "double"
    _, num, _, summary = CL.profile_cells(cells)
    assert num.first()["mean"] == 1.0 and summary.first()["rows_in"] == 3


def test_cleaned_cells_equal_the_wide_clean(spark):
    rows = [("d", 0, 1, "n", "s", True), ("d", 0, 2, "t", "s", True), ("d", 0, 3, "o", "s", True)]
    for i, (n, t) in enumerate([("1,5", "a"), (None, "a"), ("4", None), ("4", None), ("2", "b,c")], 1):
        rows += [("d", i, 1, n, "s", False), ("d", i, 2, t, "s", False), ("d", i, 3, None, "s", False)]
    cells = spark.createDataFrame(rows, CELL)
    got = {(r["row_no"], r["column_name"]): r["value"] for r in CL.cleaned_cells(cells).collect()}
    wide, _ = C.clean(W.data_columns(W.workbook_frame(cells, "d")))
    assert sorted((float(got[k, "n"]), got[k, "t"]) for k in {k for k, _ in got}) == sorted((r["n"], r["t"]) for r in wide.collect())
    assert "o" not in {c for _, c in got}


def test_a_claim_of_any_size_is_checked(spark):
    reports = spark.createDataFrame([(1, 1, "mahasiswa = 99999999999999999999"), (2, 1, "mahasiswa = 00100"), (3, 1, "mahasiswa = " + "9" * 400)],
                                    "report_id int, dataset_id int, report_text string")
    totals = spark.createDataFrame([(1, 100)], "dataset_id int, total_students long")
    assert {r["report_id"]: r["claim_ok"] for r in V.claim_checks(reports, totals).collect()} == {1: False, 2: True, 3: False}
    issues = {r["report_id"]: r["issues"] for r in V.validate_reports(reports, totals=totals).collect()}
    assert "Isi narasi menyebut total mahasiswa = 99999999999999999999, tetapi data menyebut 100" in issues[1]


@pytest.mark.parametrize("key", ["Nama.1", "value", "position", "n", "_k0"])
def test_keys_of_any_name(spark, key):
    df = spark.createDataFrame([("g", "x", 1.0), ("g", "x", 3.0), (None, "y", 5.0)], f"`{key}` string, t string, z double")
    cat = {r[0]: (r["most_common"], r["unique_values"]) for r in P.profile_categorical(df, ["t"], keys=[key]).collect()}
    assert cat == {"g": ("x", 1), None: ("y", 1)}
    assert {r[0]: r["median"] for r in P.profile_numeric(df, ["z"], keys=[key]).collect()} == {"g": 2.0, None: 5.0}


def test_headers_that_differ_in_case(spark):
    cells = spark.createDataFrame([("d", 0, 1, "Nama", "s", True), ("d", 0, 2, "nama", "s", True), ("d", 1, 1, "a", "s", False), ("d", 1, 2, "b", "s", False)], CELL)
    out, _ = C.clean(W.data_columns(W.workbook_frame(cells, "d")))
    assert tuple(out.first()) == ("a", "b") and out.columns == ["Nama", "nama"]


def test_infinities_and_extremes_in_the_median(spark):
    inf = float("inf")
    values = {"a": [-inf, -inf, 1.0], "b": [-1.7e308, 1.7e308], "c": [inf, inf, -inf, inf], "d": [5e-324, 1e-323, 0.0], "e": [-inf, inf, 2.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "g string, value double")
    from tablescope.operators.median import exact_median
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], finish_rows=0, buckets=4).collect()}
    assert got == {"a": -inf, "b": 0.0, "c": inf, "d": 5e-324, "e": 3.0}


def test_the_caller_chooses_the_report_kind(spark):
    ids = spark.range(1, 37).toDF("id")
    fin = Y.finance_lines(ids, "id", 42)
    summaries = J.dataset_summaries({"keuangan": fin})
    chosen = spark.createDataFrame([("keuangan", "finance")], "dataset_id string, report_type string")
    got = J.reports_from_summaries(summaries, report_types=chosen).first()
    assert got["report_kind"] == "finance_reports" and got["path"].startswith("finance_reports/finance_report_")
    assert J.reports_from_summaries(summaries).first()["report_kind"] == ""


def test_workbooks_to_reports_in_one_flow(spark):
    d = _folder({"a.xlsx": [["NIM", "Nilai"], [1, 80], [2, 90]], "b.xlsx": [["Bulan", "Biaya"], ["Jan", 5]], "c.xlsx": [["x"]]})
    with open(os.path.join(d, "broken.xlsx"), "wb") as fh:
        fh.write(b"no zip")
    out = tempfile.mkdtemp(prefix="flow-")
    reports, rejects = J.workbook_report_job(spark, d, out)
    kinds = {os.path.basename(r["report_id"]): r["report_kind"] for r in reports.collect()}
    assert kinds == {"a.xlsx": "student_reports", "b.xlsx": "finance_reports", "c.xlsx": ""}
    assert len(sinks.list_saved_reports(spark, f"{out}/reports").collect()) == 3
    assert spark.read.parquet(f"{out}/metadata").count() == 3
    assert [os.path.basename(r["dataset_id"]) for r in spark.read.parquet(f"{out}/rejects").collect()] == ["broken.xlsx"]


def test_clean_caches_nothing_and_releases_its_table(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k long, t string")
    out, rep = C.clean(df)
    assert out.count() == 2
    path = rep.written._written_at
    assert os.path.isdir(path.replace("file:", ""))
    rep.release()
    assert not os.path.exists(path.replace("file:", ""))
    assert not spark._jsc.getPersistentRDDs()
    t = checkpoint(df)
    release(t)
    assert not os.path.exists(t._written_at.replace("file:", ""))


def test_checkpoint_tables_go_with_the_application():
    root = tempfile.mkdtemp(prefix="ckpt-")
    code = ("import sys; sys.path.insert(0, %r)\nfrom pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', %r).getOrCreate()\n"
            "from tablescope.session import checkpoint\nprint('ROWS', checkpoint(s.range(3)).count())\ns.stop()\n"
            % (os.path.dirname(os.path.dirname(os.path.abspath(__file__))), root))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "ROWS 3" in done.stdout
    assert [f for _, _, files in os.walk(root) for f in files if f.endswith(".parquet")] == []


def test_fixed_values_as_written_down():
    """The constants that the oracles share with the code, written out once more."""
    assert RP.GENERATOR_NAME == "Report Generator" and (RP.STUDENT_DIR, RP.FINANCE_DIR) == ("student_reports", "finance_reports")
    assert (RP.LABEL_PASS, RP.LABEL_ISSUES) == ("✓ Pass", "⚠ Issues detected")
    assert V.MIN_CHARS == 200 and V.PLACEHOLDER_PHRASES == ("tidak dapat", "data terbatas") and V.CLAIM_TOLERANCE == 0.05
    assert V.MSG_TOO_SHORT.format(n=200) == "Teks laporan terlalu pendek (<200 karakter)"
    assert V.MSG_PLACEHOLDER == "Laporan menyiratkan ketidakpastian atau kekurangan data"
    assert V.MSG_UNKNOWN_DEPARTMENT.format("X") == "Departemen 'X' disebut dalam teks, tapi tidak ada di data"
    assert V.MSG_CLAIM.format(1, 2) == "Isi narasi menyebut total mahasiswa = 1, tetapi data menyebut 2"
