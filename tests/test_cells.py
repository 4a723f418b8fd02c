import os
import tempfile

from tablescope.operators import cells as CL
from tablescope.operators import clean as C
from tablescope.operators import profile as P
from tablescope.operators import render as R
from tablescope.sources import workbook as W
from xlsx_writer import write_xlsx

SHEETS = {
    "a.xlsx": [["NIM", "Nama", "Nilai", "Catatan", None, "Nama"],
               [2100001, "Ani", "80,5", None, "x", "p"],
               [2100002, "Budi", "70", None, None, "q"],
               [2100002, "Budi", "70", None, None, "q"],
               [2100003, None, None, None, "y", "q"],
               [2100004, "Ani", "91,25", None, "x", None]],
    "b.xlsx": [["Bulan", "Biaya", "Saldo"],
               ["Jan", 10, -5.5],
               ["Feb", None, 3.0],
               ["Jan", 10, -5.5],
               ["Mar", 30, None]],
}


def _folder():
    d = tempfile.mkdtemp(prefix="cells-")
    for name, rows in SHEETS.items():
        write_xlsx(os.path.join(d, name), rows)
    return d


def test_long_form_equals_wide_clean_then_profile(spark):
    d = _folder()
    cells, rejects = W.read_workbooks(spark, d)
    assert rejects.count() == 0
    ds, num, cat, summ = CL.profile_cells(cells)
    long_text = {os.path.basename(r[0]): r[1] for r in R.summary_text(ds, num, cat).collect()}
    clean_long = {os.path.basename(r["dataset_id"]): r for r in summ.collect()}
    for name in SHEETS:
        path = [r[0] for r in cells.select("dataset_id").distinct().collect() if r[0].endswith(name)][0]
        wide = W.data_columns(W.workbook_frame(cells, path))
        out, rep = C.clean(wide)
        dsw, numw, catw = P.analyze(out, path)
        assert R.summary_text(dsw, numw, catw).first()["summary_text"] == long_text[name], name
        s = clean_long[name]
        assert (s["rows_in"], s["rows_out"], s["duplicates_removed"], s["empty_columns_dropped"]) == \
            (rep.rows_in, rep.rows_out, rep.duplicates_removed, len(rep.empty_columns))
    assert "Unnamed: 4" in long_text["a.xlsx"] and "Nama.1" in long_text["a.xlsx"]
    assert "- Detected type: student" in long_text["a.xlsx"] and "NIM:" not in long_text["a.xlsx"]


def test_many_copies_with_blank_cells_collapse(spark):
    """A group of copies (here most of the rows) dedups to one row; a column seen only as
    missing cells still exists and is dropped as empty."""
    rows = [("d", 0, 1, "a", "s", True), ("d", 0, 2, "b", "s", True), ("d", 0, 3, "c", "s", True)]
    for r in range(1, 2001):
        v = "1" if r <= 1500 else str(r)
        rows += [("d", r, 1, v, "n", False), ("d", r, 2, None, "s", False), ("d", r, 3, "t", "s", False)]
    cells = spark.createDataFrame(rows, "dataset_id string, row_no bigint, position int, value string, "
                                        "kind string, is_header boolean")
    _, _, _, summary = CL.profile_cells(cells)
    r = summary.first()
    assert (r["rows_in"], r["rows_out"], r["duplicates_removed"], r["empty_columns_dropped"]) == (2000, 501, 1499, 1)


def test_long_form_numeric_paths_agree(spark):
    """The median's one-task path and its narrowing rounds give the same numbers, mean fills
    included."""
    import pytest
    cells, _ = W.read_workbooks(spark, _folder())
    key = ("dataset_id", "position")
    one = {tuple(r[k] for k in key): r for r in CL.profile_cells(cells, materialize=False)[1].collect()}
    sel = {tuple(r[k] for k in key): r for r in
           CL.profile_cells(cells, materialize=False, finish_rows=1, buckets=4)[1].collect()}
    assert one.keys() == sel.keys() and one
    for k, r in one.items():
        for c in ("row_count", "mean", "median", "min", "max", "std", "missing"):
            assert r[c] == pytest.approx(sel[k][c]), (k, c)
