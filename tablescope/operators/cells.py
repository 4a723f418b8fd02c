"""Clean and profile many datasets with different headers in one job (long form).

Input cells ``(dataset_id, row_no, position, value STRING, kind)`` — what the workbook
scan emits, or any table stacked the same way. The first row of a dataset is its header.
Every step is keyed by ``dataset_id`` (and ``position``), so a thousand workbooks are one job
graph and no decision goes through the driver:

* cells are written once with a type vote each (``votes``); votes merge by column, before and after copies go;
* columns: one aggregate by (dataset, position) tells how many cells are present and how a
  reader would type them, one of the header cells gives the names; blank names → ``Unnamed: i``, repeats → ``name.1`` (window per dataset
  and name, bounded by the header width);
* dedup (A1/A2): a row is hashed over its typed cells (two 64-bit hashes combined by xor, so a row
  needs no list buffer), and rows of one dataset with equal hashes are copies. Typing comes
  first, as in a wide table: "12", 12 and "012" in a number column are one value, commas
  stay text at this point. Only the numbers of the rows to drop are joined back;
* empty columns (P4) are those with no present value;
* types: a column is numeric when every present cell is a number or number text after
  comma → dot (read-time inference and C2 in one test), boolean / date when every cell is,
  text otherwise (commas → dots, C1); whole numbers beyond 64 bits keep a column text;
* fills (A17/A18) are not materialised: a mean fill leaves mean/min/max unchanged, adds the
  mean ``gaps`` times to the median's value counts and keeps the sum of squared deviations;
  a mode fill adds ``gaps`` to the mode's count. The profile is the profile of the cleaned
  table, as the reference profiles cleaned data. ``cleaned_cells`` gives the cleaned cells themselves.

Every dataset with a header is in the results, also one without rows or with empty columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import comma_to_dot, markers_to_null
from ..session import checkpoint as _ckpt
from . import schema as S
from . import votes as VT
from .median import exact_median
from .top import most_common

_BROADCAST_BYTES = 32 << 20


def _tag_header(cells: DataFrame) -> DataFrame:
    """Cells with ``is_header``: taken from the source when it tags header cells (the workbook
    scan and ``stack_table`` do — no join of every cell to its dataset, so a dataset holding a
    third of all cells is not one hot join partition), else the first row of each dataset."""
    if "is_header" in cells.columns:
        return cells
    first = cells.groupBy("dataset_id").agg(F.min("row_no").alias("_hdr"))
    return cells.join(first, "dataset_id").withColumn("is_header", F.col("row_no") == F.col("_hdr")).drop("_hdr")


def _prepare(cells: DataFrame) -> DataFrame:
    """Cells with header tags and type votes, written once; marker texts and error cells are missing."""
    tagged = _tag_header(cells).withColumn("value", F.when(F.col("kind") != "e", markers_to_null(F.col("value"))))
    return _ckpt(tagged.select("dataset_id", "row_no", "position", "value", "is_header",
                               F.when(~F.col("is_header"), VT.vote(F.col("value"), F.col("kind"))).alias("vote")))


def _columns(c: DataFrame) -> DataFrame:
    """(dataset_id, position, column_name, seen, every, some) from one aggregate of all cells and one of the headers."""
    # Names apart from votes: a greatest text in the same aggregate would sort every cell.
    key = ["dataset_id", "position"]
    votes = c.groupBy(*key).agg(F.count("vote").alias("seen"), *VT.tally(F.col("vote"), "every", "some"))
    facts = votes.join(c.where("is_header").groupBy(*key).agg(F.max("value").alias("raw_name")), key, "left")
    named = facts.withColumn("base", F.coalesce(F.nullif(F.col("raw_name"), F.lit("")),
                                                F.concat(F.lit("Unnamed: "), (F.col("position") - 1).cast("string"))))
    k = F.row_number().over(Window.partitionBy("dataset_id", "base").orderBy("position")) - 1
    return _ckpt(named.select(
        "dataset_id", "position", "seen", "every", "some",
        F.when(k == 0, F.col("base")).otherwise(F.concat(F.col("base"), F.lit("."), k.cast("string"))).alias("column_name")))


def _header_sized(df: DataFrame, written: DataFrame) -> DataFrame:
    """``df``, with at most the rows of ``written``, marked for broadcast if those are few; beyond the bound it is shuffled."""
    return F.broadcast(df) if written.count() * 96 <= _BROADCAST_BYTES else df


def _rows(c: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((dataset_id, rows_in, rows_out) for every dataset, (dataset_id, row_no) of the rows to drop)."""
    body = c.where(~F.col("is_header"))
    every, some = F.col("every"), F.col("some")
    number, whole = VT.is_number(every, some, as_read=True), VT.has(every, VT.INTEGER)
    how = columns.select("dataset_id", "position", "seen", "every", "some")
    if columns.where(number & whole & VT.has(some, VT.INEXACT)).isEmpty():
        full = F.lit(True)  # every whole number is the same value read as a whole or as a double
    else:
        how = how.join(body.groupBy("dataset_id").agg(F.count_distinct("row_no").alias("n_rows")), "dataset_id")
        full = F.col("seen") == F.col("n_rows")
    how = how.select("dataset_id", "position", F.when(~number, F.lit("text")).when(whole & full, F.lit("whole")).otherwise(F.lit("double")).alias("how"))
    v = F.col("value")
    typed = (F.when(F.col("how") == "whole", F.coalesce(F.trim(v).try_cast("decimal(20,0)").cast("string"), v))
             .when(F.col("how") == "double", F.coalesce(F.trim(v).try_cast("double").cast("string"), v)).otherwise(v))
    h = lambda seed: F.bit_xor(F.when(v.isNotNull(), F.xxhash64(F.lit(seed), "position", "typed")))
    rows = _ckpt(body.join(_header_sized(how, columns), ["dataset_id", "position"]).withColumn("typed", typed).groupBy("dataset_id", "row_no").agg(
        F.coalesce(h(1), F.lit(0)).alias("h1"), F.coalesce(h(2), F.lit(0)).alias("h2"), F.count(v).alias("n")))
    groups = _ckpt(rows.groupBy("dataset_id", "h1", "h2", "n").agg(F.min("row_no").alias("stays"), F.count(F.lit(1)).alias("copies")))
    copies = groups.where("copies > 1").select("dataset_id", "h1", "h2", "n", "stays")
    drop = _ckpt(rows.join(copies, ["dataset_id", "h1", "h2", "n"]).where("row_no <> stays").select("dataset_id", "row_no"))
    counts = groups.groupBy("dataset_id").agg(F.sum("copies").cast("bigint").alias("rows_in"), F.count(F.lit(1)).alias("rows_out"))
    every_one = columns.select("dataset_id").distinct().join(counts, "dataset_id", "left")
    return _ckpt(every_one.select("dataset_id", F.coalesce("rows_in", F.lit(0)).cast("bigint").alias("rows_in"),
                                  F.coalesce("rows_out", F.lit(0)).cast("bigint").alias("rows_out"))), drop


def _summary(columns: DataFrame, counts: DataFrame) -> DataFrame:
    empty = columns.groupBy("dataset_id").agg(F.count_if(F.col("seen") == 0).alias("empty_columns_dropped"))
    return counts.join(empty, "dataset_id").select(
        "dataset_id", "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("duplicates_removed"), "empty_columns_dropped")


def cleaning_summary(cells: DataFrame) -> DataFrame:
    """(dataset_id, rows_in, rows_out, duplicates_removed, empty_columns_dropped), without any statistics."""
    c = _prepare(cells)
    columns = _columns(c)
    counts, _ = _rows(c, columns)
    return _summary(columns, counts)


def _staying(body: DataFrame, drop: DataFrame) -> tuple[DataFrame, bool]:
    """``body`` without the rows to drop, and whether these are few enough to broadcast. Joined by row number first: a
    sort by dataset would compare whole keys where most cells are of few datasets."""
    few = drop.count() * 64 <= _BROADCAST_BYTES
    return body.join(F.broadcast(drop) if few else drop, ["row_no", "dataset_id"], "left_anti"), few


def _distinct_cells(c: DataFrame, drop: DataFrame) -> DataFrame:
    """The present cells of the rows that stay. Without rows to drop that are too many to broadcast, nothing is written."""
    body = c.where(~F.col("is_header") & F.col("value").isNotNull()).select("dataset_id", "row_no", "position", "value", "vote")
    stay, few = _staying(body, drop)
    stay = stay.select(*body.columns)
    return stay if few else _ckpt(stay)


def _distinct_numbers(c: DataFrame, drop: DataFrame) -> DataFrame:
    """(dataset_id, position, vote, value) of the present cells of the rows that stay, values as numbers, written: all that
    the classes and the numeric profile read."""
    body = c.where(~F.col("is_header") & F.col("value").isNotNull()).select(
        "dataset_id", "row_no", "position", "vote", F.when(VT.has(F.col("vote"), VT.NUMBER), _number(F.col("value"))).alias("value"))
    return _ckpt(_staying(body, drop)[0].select("dataset_id", "position", "vote", "value"))


def _classes(dcells: DataFrame, columns: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per (dataset, column): its class after cleaning, its gaps and its number ``col``. Header-sized, written once."""
    kinds = dcells.groupBy("dataset_id", "position").agg(F.count(F.lit(1)).alias("present"), *VT.tally(F.col("vote"), "every", "some"))
    cols = (columns.select("dataset_id", "position", "column_name").join(kinds, ["dataset_id", "position"], "left")
            .join(counts, "dataset_id")
            .withColumn("cls", VT.cleaned_class(F.col("every"), F.col("some")))
            .withColumn("gaps", F.col("rows_out") - F.coalesce(F.col("present"), F.lit(0)))
            .drop("every", "some"))
    cols = _ckpt(cols)  # read twice below
    types = S.detect_types(cols.where(F.col("cls") != "empty").select("dataset_id", "column_name"))
    return _ckpt(cols.join(types, "dataset_id", "left").withColumn("detected_type", F.coalesce("detected_type", F.lit("unknown")))
                 .withColumn("col", F.monotonically_increasing_id()))


def _number(value: Column) -> Column:
    return F.trim(comma_to_dot(value)).try_cast("double")


def _moments(values: DataFrame) -> DataFrame:
    """Moments of each column of numbers before any fill."""
    return values.groupBy("col").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.var_samp("value").alias("_var"), F.count("value").alias("_n"))


def _numeric_cells(numbers: DataFrame, classes: DataFrame) -> DataFrame:
    """(col, value) of the ``numbers`` (dataset_id, position, value) of the columns ``classes``, written, as the median reads
    them in several passes."""
    key = ["dataset_id", "position"]
    return _ckpt(numbers.select(*key, "value").join(classes.select(*key, "col"), key).select("col", "value"))


def _text_cells(dcells: DataFrame, classes: DataFrame) -> DataFrame:
    key = ["dataset_id", "position"]
    return dcells.join(classes.select(*key), key, "left_semi").select(*key, comma_to_dot(F.col("value")).alias("value"))


#: Shares into which a dataset's rows are dealt when they meet the dataset's gap columns.
_SHARES = 64


def cleaned_cells(cells: DataFrame) -> DataFrame:
    """The cleaned cells of many datasets: (dataset_id, row_no, position, column_name, cls, value), copies and empty
    columns gone, commas as dots, gaps filled with the column's mean or most frequent value. Boolean
    and date gaps stay missing (no row).

    A row's gaps come from the set of its present positions (at most a header's width): those of its dataset's gap
    columns that the set lacks. The gap columns with their fills are one row per dataset, laid out once for each of
    ``_SHARES`` shares of rows, so that a dataset with a third of all rows is dealt evenly.
    """
    c = _prepare(cells)
    columns = _columns(c)
    counts, drop = _rows(c, columns)
    dcells = _distinct_cells(c, drop)
    kept = _classes(dcells, columns, counts).where(F.col("cls") != "empty").select("dataset_id", "position", "column_name", "cls", "gaps", "col")
    key = ["dataset_id", "position"]
    v = F.col("value")
    clean = dcells.join(_header_sized(kept.drop("gaps", "col"), columns), key).withColumn("value", F.when(F.col("cls").isin("numeric", "text"), comma_to_dot(v)).otherwise(v))
    gaps = kept.where(F.col("gaps") > 0)
    numbers = _numeric_cells(dcells.withColumn("value", _number(v)), gaps.where("cls = 'numeric'"))
    moments = _moments(numbers).join(gaps.select(*key, "col"), "col")
    modes = most_common(_ckpt(_text_cells(dcells, gaps.where("cls = 'text'"))), key)
    fills = moments.select(*key, F.col("mean").cast("string").alias("fill")).unionByName(modes.select(*key, F.col("top").alias("fill")))
    fills = (gaps.join(fills, key).groupBy("dataset_id").agg(F.collect_list(F.struct("position", "column_name", "cls", "fill")).alias("_fills"))
             .withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1)))))
    rows = (c.where(~F.col("is_header")).groupBy("dataset_id", "row_no").agg(F.collect_set(F.when(v.isNotNull(), F.col("position"))).alias("_present"))
            .join(F.broadcast(drop) if drop.count() * 64 <= _BROADCAST_BYTES else drop, ["dataset_id", "row_no"], "left_anti")
            .withColumn("_share", F.pmod(F.xxhash64("row_no"), F.lit(_SHARES)).cast("int")))
    lacking = F.filter("_fills", lambda f: ~F.array_contains(F.col("_present"), f["position"]))
    holes = (rows.join(fills, ["dataset_id", "_share"]).select("dataset_id", "row_no", F.explode(lacking).alias("f"))
             .select("dataset_id", "row_no", "f.position", "f.column_name", "f.cls", F.col("f.fill").alias("value")))
    return clean.select("dataset_id", "row_no", "position", "column_name", "cls", "value").unionByName(holes)


def _numeric_columns(kept: DataFrame) -> DataFrame:
    """The numeric columns to profile. Identifiers are left out of student datasets."""
    return (kept.where(F.col("cls") == "numeric")
            .where(~((F.col("detected_type") == "student") & S.is_identifier_name(F.col("column_name")))))


def _numeric_profile(values: DataFrame, num_cols: DataFrame, **median_opts) -> DataFrame:
    """Statistics of the numeric columns after the mean fill, from their ``values`` (col, value)."""
    key = ["dataset_id", "position"]
    stats = num_cols.select(*key, "col", "column_name", "rows_out", "gaps").join(_moments(values), "col")
    # After the mean fill: same mean/min/max; squared deviations unchanged, spread over all rows.
    m2 = F.coalesce(F.col("_var") * (F.col("_n") - 1), F.lit(0.0))
    stats = _ckpt(stats.withColumn("std", F.when(F.col("rows_out") > 1, F.sqrt(m2 / (F.col("rows_out") - 1)))))
    fill_rows = stats.where(F.col("gaps") > 0).select("col", F.col("mean").alias("value"), F.col("gaps").alias("w"))
    weighted = values.select("col", "value", F.lit(1).cast("bigint").alias("w")).unionByName(fill_rows)
    med = exact_median(weighted, ["col"], weight_col="w", **median_opts)
    return stats.join(med, "col", "left").select(
        *key, "column_name", F.col("rows_out").alias("row_count"), "mean", "median",
        "min", "max", "std", F.lit(0).cast("bigint").alias("missing"))


def _categorical_profile(dcells: DataFrame, kept: DataFrame) -> DataFrame:
    """Text columns: values counted once, by hash; the mode fill adds the gaps to the mode."""
    key = ["dataset_id", "position"]
    txt_cols = kept.where(F.col("cls") == "text").select(*key, "column_name", "gaps")
    top = most_common(_text_cells(dcells, txt_cols), key)
    return txt_cols.join(top, key).select(
        *key, "column_name", "unique_values", F.col("top").alias("most_common"),
        (F.col("top_n") + F.col("gaps")).alias("most_common_count"), F.lit(0).cast("bigint").alias("missing"))


def profile_cells(cells: DataFrame, materialize: bool = True, **median_opts):
    """(datasets, numeric, categorical, clean_summary) for every dataset in ``cells``.

    The four results have one row per dataset or per dataset column; with ``materialize``
    they are checkpointed, so texts rendered from them plan from small leaves.
    """
    c = _prepare(cells)
    columns = _columns(c)
    counts, drop = _rows(c, columns)
    dcells = _distinct_cells(c, drop)
    cols = _classes(dcells, columns, counts)
    kept = cols.where(F.col("cls") != "empty")
    ds = (cols.groupBy("dataset_id", "rows_out", "detected_type")
          .agg(F.sort_array(F.collect_list(F.when(F.col("cls") != "empty", F.struct("position", "column_name")))).alias("_c"))
          .select("dataset_id", F.col("rows_out").alias("row_count"),
                  F.size("_c").cast("int").alias("column_count"),
                  F.transform("_c", lambda s: s["column_name"]).alias("columns"), "detected_type"))
    summary = _summary(columns, counts)
    num_cols = _numeric_columns(kept)
    numbers = _numeric_cells(dcells.withColumn("value", _number(F.col("value"))), num_cols)
    num = _numeric_profile(numbers, num_cols, **median_opts)
    cat = _categorical_profile(dcells, kept)
    if materialize:
        ds, num, cat, summary = (_ckpt(d) for d in (ds, num, cat, summary))
    return ds, num, cat, summary


def numeric_profile_cells(cells: DataFrame, **median_opts) -> DataFrame:
    """The numeric part of ``profile_cells`` alone."""
    c = _prepare(cells)
    columns = _columns(c)
    counts, drop = _rows(c, columns)
    numbers = _distinct_numbers(c, drop)
    num_cols = _numeric_columns(_classes(numbers, columns, counts).where(F.col("cls") != "empty"))
    return _numeric_profile(_numeric_cells(numbers.where(VT.has(F.col("vote"), VT.NUMBER)), num_cols), num_cols, **median_opts)


def stack_table(df: DataFrame, dataset_col: str, row_col: str, data_cols=None) -> DataFrame:
    """A wide table as cells: one dataset per value of ``dataset_col``, a header row 0, and one
    cell per present value (numbers as kind 'n', text as 's'); the first column's cell is always
    there, so that a row without any value is still a row. Useful to feed ``profile_cells``
    from tables instead of workbooks."""
    from ..functions.names import qcol
    from pyspark.sql import types as T
    cols = list(data_cols) if data_cols is not None else [c for c in df.columns if c not in (dataset_col, row_col)]
    kind = {f.name: ("n" if isinstance(f.dataType, S.NUMERIC_TYPES) else
                     "b" if isinstance(f.dataType, T.BooleanType) else
                     "d" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "s")
            for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(i + 1).alias("position"), qcol(c).cast("string").alias("value"),
                               F.lit(kind[c]).alias("kind")) for i, c in enumerate(cols)])
    body = df.select(qcol(dataset_col).cast("string").alias("dataset_id"),
                     (qcol(row_col).cast("bigint") + 1).alias("row_no"), F.inline(cells),
                     F.lit(False).alias("is_header")) \
        .where(F.col("value").isNotNull() | (F.col("position") == 1))
    datasets = df.groupBy(qcol(dataset_col).cast("string").alias("dataset_id")).agg(F.lit(1).alias("_x"))
    head = datasets.select("dataset_id", F.lit(0).cast("bigint").alias("row_no"), F.inline(F.array(
        *[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("value"), F.lit("s").alias("kind"))
          for i, c in enumerate(cols)])), F.lit(True).alias("is_header"))
    return head.unionByName(body)
