"""The three places that type a column agree."""
import pytest

from tablescope.functions.numbers import MISSING_MARKERS
from tablescope.operators import cells as CL
from tablescope.operators import clean as C
from tablescope.sources import workbook as W

COLUMNS = {
    "whole": ["1", " 2 ", "+3", "-4"], "gap": ["1", None, "3", "4"], "comma": ["1,5", "2", "3", "4"], "words": ["1", "x", "3", "4"],
    "unsigned": ["1", "9223372036854775808", "3", "4"], "beyond": ["1", "99999999999999999999", "3", "4"], "bool": ["True", "false", "TRUE", "False"],
    "mixed": ["True", "1", "2", "3"], "exp": ["1e5", "inf", "-.5", "5."], "hex": ["0x1", "1", "2", "3"], "two_commas": ["1,2,3", "1", "2", "3"],
    "markers": [*MISSING_MARKERS[:3], "7"], "all_markers": list(MISSING_MARKERS[4:8]), "inexact": ["9007199254740993", "1", "2", "3"]}
WANT = {"whole": "numeric", "gap": "numeric", "comma": "numeric", "words": "text", "unsigned": "numeric", "beyond": "text", "bool": "bool", "mixed": "text",
        "exp": "numeric", "hex": "text", "two_commas": "text", "markers": "numeric", "all_markers": "empty", "inexact": "numeric"}


def cells(spark):
    rows = [("d", 0, p + 1, name, "s", True) for p, name in enumerate(COLUMNS)]
    rows += [("d", r + 1, p + 1, v[r], "s", False) for p, v in enumerate(COLUMNS.values()) for r in range(4)]
    return spark.createDataFrame(rows, "dataset_id string, row_no bigint, position int, value string, kind string, is_header boolean")


def test_long_form_classes(spark):
    c = CL._prepare(cells(spark))
    columns = CL._columns(c)
    counts, drop = CL._rows(c, columns)
    got = {r["column_name"]: r["cls"] for r in CL._classes(CL._distinct_cells(c, drop), columns, counts).collect()}
    assert got == WANT


def test_workbook_and_wide_clean_agree_with_the_long_form(spark):
    frame = W.data_columns(W.workbook_frame(cells(spark), "d"))
    read = dict(frame.dtypes)
    assert read["whole"] == "bigint" and read["gap"] == "double" and read["comma"] == "string" and read["unsigned"] == "decimal(20,0)"
    assert read["beyond"] == "string" and read["bool"] == "boolean" and read["markers"] == "double" and read["inexact"] == "bigint"
    cleaned, report = C.clean(frame)
    kinds = {n: ("numeric" if t in ("bigint", "double", "decimal(20,0)") else "bool" if t == "boolean" else "text") for n, t in cleaned.dtypes}
    kinds |= dict.fromkeys(report.empty_columns, "empty")
    assert kinds == WANT


@pytest.mark.parametrize("copies", [["9007199254740992", "9007199254740993"], ["12", "012"], ["5", " 5"]])
def test_rows_are_copies_by_typed_value(spark, copies):
    rows = [("d", 0, 1, "n", "s", True)] + [("d", k + 1, 1, v, "s", False) for k, v in enumerate(copies)]
    out = CL.cleaning_summary(spark.createDataFrame(rows, "dataset_id string, row_no bigint, position int, value string, kind string, is_header boolean")).first()
    assert out["rows_out"] == len({int(v) for v in copies})


def test_numeric_profile_writes_texts_of_cells_once(spark, monkeypatch):
    """Also with more rows to drop than a broadcast holds, what is written after the cells themselves are numbers."""
    rows = [("a", 0, 1, "x", "s"), ("a", 0, 2, "y", "s")]
    rows += [("a", r, p, str(r % 7) + (",5" if p == 2 else ""), "s") for r in range(1, 30) for p in (1, 2) if (r % 7, p) != (3, 1)]
    table = spark.createDataFrame(rows, "dataset_id string, row_no bigint, position int, value string, kind string")
    written, write = [], CL._ckpt
    want = sorted(map(tuple, CL.numeric_profile_cells(table).collect()))
    monkeypatch.setattr(CL, "_ckpt", lambda df: written.append(dict(df.dtypes).get("value")) or write(df))
    monkeypatch.setattr(CL, "_BROADCAST_BYTES", 0)
    got = sorted(map(tuple, CL.numeric_profile_cells(table).collect()))
    assert got == want
    assert [g[:8] for g in got] == [("a", 1, "x", 7, 3.0, 3.0, 0.0, 6.0), ("a", 2, "y", 7, 3.5, 3.5, 0.5, 6.5)]
    assert written.count("string") == 1
