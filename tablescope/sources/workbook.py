"""Spreadsheet workbooks (.xlsx) as Spark tables.

A folder of workbooks is listed with the ``binaryFile`` source; ``mapInPandas`` opens each
file (a zip of XML parts, read with the standard library) and emits its first sheet as
cells ``(dataset_id, row_no, position, value, kind)``. One workbook is one task — a zip
cannot be split — and thousands of workbooks are one job. Files that are not ``.xlsx``,
legacy ``.xls`` files, unreadable files and expected-but-absent paths go to a rejects table
instead of stopping the batch.

``workbook_frame`` turns the cells of one dataset (or of datasets sharing a header) into a
typed wide table the way a spreadsheet reader would: the first row is the header (blank
names → ``Unnamed: i``, repeats → ``name.1``), marker texts are missing, and a column whose
cells are all numbers becomes BIGINT (whole, no gaps) or DOUBLE, all booleans BOOLEAN, all
dates TIMESTAMP, anything else STRING.
"""

from __future__ import annotations

import datetime as _dt
import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import qcol
from ..session import checkpoint as _ckpt
from ..session import ship_package
from ..functions.numbers import MISSING_MARKERS
from ..operators import votes as VT

CELL_SCHEMA = ("dataset_id string, row_no bigint, position int, value string, kind string, is_header boolean, "
               "error string")
# Why a file is rejected.
MSG_NOT_EXCEL = "File must be an Excel file (.xlsx or .xls)"
MSG_NOT_FOUND = "File not found"
_CHUNK = 100_000  # cells per Arrow batch handed back to Spark
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times.
_DATE_FORMAT_IDS = set(range(14, 23)) | set(range(27, 37)) | {45, 46, 47} | set(range(50, 59))
_EXCEL_EPOCH = _dt.datetime(1899, 12, 30)


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n


def _text_of(el) -> str:
    """All <t> text under an element, phonetic runs excluded."""
    parts = []
    for node in el.iter():
        tag = node.tag.rsplit("}", 1)[-1]
        if tag == "rPh":
            continue
        if tag == "t" and node.text:
            parts.append(node.text)
    return "".join(parts)


def _is_date_code(code: str) -> bool:
    code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())
    return bool(re.search(r"[dy]|h+:|:s|mm:ss", code))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    try:
        root = ET.fromstring(z.read("xl/styles.xml"))
    except KeyError:
        return set()
    custom = {int(n.get("numFmtId")): n.get("formatCode", "")
              for n in root.findall("m:numFmts/m:numFmt", _NS)}
    out = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in _DATE_FORMAT_IDS or (fid in custom and _is_date_code(custom[fid])):
            out.add(i)
    return out


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(_REL)
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for r in rels:
        if r.get("Id") == rid:
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise ValueError("first sheet not found")


def _number_text(v: str) -> str:
    """Numbers as a reader prints them: whole values without a decimal part."""
    try:
        f = float(v)
    except ValueError:
        return v
    if f.is_integer() and abs(f) < 2 ** 53 and re.fullmatch(r"[+-]?\d+(\.0*)?", v.strip()):
        return str(int(f))
    return v


def parse_xlsx(content: bytes) -> Iterator[tuple[int, int, str | None, str]]:
    """(row_no, position, value, kind) of the first sheet; kind in n s b d e."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append(_text_of(si))
        dates = _date_styles(z)
        sheet = _first_sheet_path(z)
        with z.open(sheet) as fh:
            row_no = 0
            for _, el in ET.iterparse(fh, events=("end",)):
                tag = el.tag.rsplit("}", 1)[-1]
                if tag == "row":
                    el.clear()
                    continue
                if tag != "c":
                    continue
                ref = el.get("r", "")
                pos = _col_index(ref)
                row_no = int(re.sub(r"^[A-Za-z]+", "", ref)) if ref else row_no
                t = el.get("t", "n")
                v = el.find("m:v", _NS)
                raw = v.text if v is not None else None
                if t == "s" and raw is not None:
                    yield row_no, pos, shared[int(raw)], "s"
                elif t == "inlineStr":
                    is_el = el.find("m:is", _NS)
                    yield row_no, pos, _text_of(is_el) if is_el is not None else None, "s"
                elif t == "str":
                    yield row_no, pos, raw, "s"
                elif t == "b":
                    yield row_no, pos, None if raw is None else ("True" if raw.strip() == "1" else "False"), "b"
                elif t == "e":
                    yield row_no, pos, None, "e"  # an error cell is missing, as a reader has it
                elif t == "d":
                    yield row_no, pos, raw, "d"
                elif raw is not None:
                    if int(el.get("s", "0")) in dates:
                        ts = _EXCEL_EPOCH + _dt.timedelta(days=float(raw))
                        yield row_no, pos, ts.isoformat(sep=" "), "d"
                    else:
                        yield row_no, pos, _number_text(raw), "n"
                el.clear()


def _cells_of_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["dataset_id", "row_no", "position", "value", "kind", "is_header", "error"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                if not re.search(r"\.xlsx?$", path):
                    raise ValueError(MSG_NOT_EXCEL)
                if path.endswith(".xls"):
                    raise ValueError("legacy .xls workbooks are not supported")
                header_row, last, chunk = None, 0, []
                for r, p, v, k in parse_xlsx(bytes(content)):
                    header_row = r if header_row is None else header_row  # rows arrive in sheet order
                    if v is not None:  # blank rows above a row with a value are rows too
                        for blank in range(max(last, header_row) + 1, r):
                            chunk.append((path, blank, 1, None, "s", False, None))
                        last = max(last, r)
                    elif r > header_row:
                        continue
                    chunk.append((path, r, p, v, k, r == header_row, None))
                    if len(chunk) >= _CHUNK:
                        yield pd.DataFrame(chunk, columns=cols)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=cols)
            except Exception as e:  # a bad file becomes a reject row, the batch goes on
                yield pd.DataFrame([(path, None, None, None, None, None, f"Error reading Excel file: {e}")],
                                   columns=cols)


def scan_workbooks(spark: SparkSession, path: str, glob: str = "*.xls*", recursive: bool = True) -> DataFrame:
    """All workbooks under ``path`` as cells (with an ``error`` column for bad files)."""
    ship_package(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", str(recursive).lower()).load(path)
             .select("path", "content"))
    return files.mapInPandas(_cells_of_files, CELL_SCHEMA)


def read_workbooks(spark: SparkSession, path: str, expected=None, glob: str = "*.xls*",
                   materialize: bool = True):
    """(cells, rejects). ``expected``: paths that must exist; absent ones are rejected.

    Parsing is the costly step and header/type decisions read the cells several times, so the
    parsed cells are checkpointed once to the cluster's reliable checkpoint folder.
    """
    scanned = scan_workbooks(spark, path, glob)
    if materialize:
        scanned = _ckpt(scanned)
    cells = scanned.where(F.col("error").isNull()).drop("error")
    rejects = scanned.where(F.col("error").isNotNull()).select("dataset_id", F.col("error").alias("reason"))
    # Other files in the folder are rejected by name; listing paths alone reads no content.
    others = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
              .select(F.col("path").alias("dataset_id"))
              .where(~F.col("dataset_id").rlike(r"\.xls[x]?$"))
              .select("dataset_id", F.lit(MSG_NOT_EXCEL).alias("reason")))
    rejects = rejects.unionByName(others)
    if expected:
        want = spark.createDataFrame([(p,) for p in expected], "dataset_id string")
        found = scanned.select("dataset_id").distinct()
        missing = (want.join(found, "dataset_id", "left_anti")
                   .select("dataset_id", F.lit(MSG_NOT_FOUND).alias("reason")))
        rejects = rejects.unionByName(missing)
    return cells, rejects


def _unique_names(raw: list[str | None]) -> list[str]:
    out, seen = [], {}
    for i, name in enumerate(raw):
        base = name if name not in (None, "") else f"Unnamed: {i}"
        if base in seen:
            seen[base] += 1
            cand = f"{base}.{seen[base]}"
            while cand in seen:
                seen[base] += 1
                cand = f"{base}.{seen[base]}"
            seen[cand] = 0
            out.append(cand)
        else:
            seen[base] = 0
            out.append(base)
    return out


def workbook_frame(cells: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Typed wide table of one dataset's cells (or of datasets sharing one header).

    Header names and column types are one row per column — bounded by the header width —
    so they are decided on the driver; the rows themselves are pivoted on the cluster.
    """
    if dataset_id is not None:
        cells = cells.where(F.col("dataset_id") == dataset_id)
    cells = cells.withColumn("value", F.when((F.col("kind") != "e") & ~F.col("value").isin(*MISSING_MARKERS), F.col("value")))
    header = cells.where(F.col("is_header"))
    every = cells.where(~F.col("is_header"))
    body = every.where(F.col("value").isNotNull())
    width = (cells.agg(F.max("position")).first()[0]) or 0
    names_by_pos = {r["position"]: r["value"] for r in
                    header.groupBy("position").agg(F.first("value", ignorenulls=True).alias("value")).collect()}
    names = _unique_names([names_by_pos.get(p) for p in range(1, width + 1)])
    rows = (every.groupBy("dataset_id", "row_no").pivot("position", list(range(1, width + 1)))
            .agg(F.first("value", ignorenulls=True)))
    n_rows = rows.count()
    kinds = {r["position"]: r["type"] for r in body.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), *VT.tally(VT.vote(F.col("value"), F.col("kind")), "every", "some"))
        .select("position", VT.read_type(F.col("every"), F.col("some"), F.col("n") == n_rows).alias("type")).collect()}
    out = [F.col("dataset_id"), F.col("row_no")]
    for p, name in zip(range(1, width + 1), names):
        c, to = F.col(f"`{p}`"), kinds.get(p, "string")
        out.append((F.lower(c) == "true" if to == "boolean" else c if to == "string" else F.trim(c).try_cast(to)).alias(name))
    return rows.select(*out)


def loaded_shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns) of a loaded table, data columns only."""
    data_cols = [c for c in df.columns if c not in ("dataset_id", "row_no")]
    return df.count(), len(data_cols)


def data_columns(df: DataFrame) -> DataFrame:
    """The loaded table without the bookkeeping columns, in row order."""
    return df.orderBy("row_no").select(*[qcol(c) for c in df.columns if c not in ("dataset_id", "row_no")])
