import datetime as dt
import os
import tempfile

from tablescope.operators import clean as C
from tablescope.operators import profile as P
from tablescope.sources import workbook as W
from xlsx_writer import write_xlsx


def _folder():
    d = tempfile.mkdtemp(prefix="wb-")
    write_xlsx(os.path.join(d, "students.xlsx"), [
        ["NIM", "Nama", "Nilai", None, "Nama", "Aktif", "Tanggal"],
        ["2100001", "Ani", 80, "x", "A", True, dt.datetime(2024, 1, 2)],
        ["2100002", "Budi", 72.5, None, "B", False, dt.datetime(2024, 1, 3)],
        ["2100003", "N/A", 90, "y", "C", True, dt.datetime(2024, 1, 4)],
    ])
    write_xlsx(os.path.join(d, "inline.xlsx"), [["a", "b"], [1, "t"]], inline=True)
    with open(os.path.join(d, "broken.xlsx"), "wb") as fh:
        fh.write(b"not a zip")
    with open(os.path.join(d, "old.xls"), "wb") as fh:
        fh.write(b"\xd0\xcf")
    return d


def test_scan_types_header_and_rejects(spark):
    d = _folder()
    cells, rejects = W.read_workbooks(spark, d, expected=[os.path.join(d, "missing.xlsx")])
    bad = {os.path.basename(r["dataset_id"]): r["reason"] for r in rejects.collect()}
    assert set(bad) == {"broken.xlsx", "old.xls", "missing.xlsx"}
    students = [r["dataset_id"] for r in cells.select("dataset_id").distinct().collect() if r[0].endswith("students.xlsx")][0]
    df = W.workbook_frame(cells, students)
    types = dict(df.dtypes)
    assert types["NIM"] == "bigint" and types["Nama"] == "string" and types["Nilai"] == "double"
    assert types["Unnamed: 3"] == "string" and types["Nama.1"] == "string"
    assert types["Aktif"] == "boolean" and types["Tanggal"] == "timestamp"
    data = W.data_columns(df).collect()
    assert [r["Nama"] for r in data] == ["Ani", "Budi", None]  # 'N/A' is a missing marker
    assert W.loaded_shape(df) == (3, 7)


def test_workbook_feeds_clean_and_profile(spark):
    d = _folder()
    cells, _ = W.read_workbooks(spark, d)
    path = [r[0] for r in cells.select("dataset_id").distinct().collect() if r[0].endswith("students.xlsx")][0]
    df = W.data_columns(W.workbook_frame(cells, path))
    out, rep = C.clean(df)
    assert rep.rows_out == 3 and out.where("Nama IS NULL").count() == 0
    ds, num, cat = P.analyze(out, "students")
    assert ds.first()["detected_type"] == "student"
    assert "NIM" not in [r["column_name"] for r in num.collect()]


def test_inline_strings(spark):
    d = _folder()
    cells, _ = W.read_workbooks(spark, d)
    path = [r[0] for r in cells.select("dataset_id").distinct().collect() if r[0].endswith("inline.xlsx")][0]
    r = W.data_columns(W.workbook_frame(cells, path)).first()
    assert (r["a"], r["b"]) == (1, "t")


def test_non_excel_files_are_rejected(spark):
    d = _folder()
    with open(os.path.join(d, "notes.csv"), "w") as fh:
        fh.write("a,b\n1,2\n")
    _, rejects = W.read_workbooks(spark, d)
    bad = {os.path.basename(r["dataset_id"]): r["reason"] for r in rejects.collect()}
    assert bad["notes.csv"] == "File must be an Excel file (.xlsx or .xls)"
