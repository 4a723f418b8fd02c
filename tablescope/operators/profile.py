"""Column profiles: numeric statistics and text value summaries, as long tables.

Numeric (A3, A6–A11): one wide aggregate gives every column's count, missing count, mean, min,
max and deviation (buffers of a few numbers, nothing shuffled but partial sums). The exact
median counts bucketed rows in narrowing rounds (``median.exact_median``): no exchange carries
rows × columns, and the plan is the same at every size. ``median="approximate"`` takes
``percentile_approx`` in the wide aggregate instead.

Text (A12–A16, O3): the text columns are stacked into (column, value) and counted by hash
(``top.most_common``): distinct count, top count and missing count come from those counts, and only texts that
may be a column's most common value (count desc, then smallest value) are looked up. ``value_counts`` (O1, O2) lists
the values themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import qcol
from ..session import checkpoint as _ckpt
from ..functions.numbers import nan_is_missing
from . import schema as S
from .blocks import in_blocks
from .median import exact_median
from .top import most_common

NUMERIC_SCHEMA = ("position int, column_name string, row_count bigint, mean double, median double, "
                  "min double, max double, std double, missing bigint")
CATEGORICAL_SCHEMA = ("position int, column_name string, unique_values bigint, most_common string, "
                      "most_common_count bigint, missing bigint")


def numeric_value(df: DataFrame, name: str) -> Column:
    """Column as DOUBLE with NaN folded into NULL (one notion of missing)."""
    dt = df.schema[name].dataType
    c = qcol(name).cast("double")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = nan_is_missing(c)
    return c


def profile_numeric(df: DataFrame, columns=None, keys=(), median: str = "exact",
                    **median_opts) -> DataFrame:
    """(keys..., position, column_name, row_count, mean, median, min, max, std, missing).

    ``median``: "exact" (default, distributed selection) or "approximate"
    (``percentile_approx``, named so on purpose).
    """
    keys = list(keys)
    cols = list(columns) if columns is not None else S.numeric_columns(df, exclude=keys)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], _with_keys(df, keys, NUMERIC_SCHEMA))
    pos = S.positions(df)
    # Keys get working names, so that none of them clashes with a column of the result.
    ks = [f"_k{i}" for i in range(len(keys))]
    keyed = [qcol(k).alias(ks[i]) for i, k in enumerate(keys)]
    values, width = in_blocks(df, keyed, _x=[numeric_value(df, c) for c in cols])
    aggs = [F.sum("_one").alias("_rows")]
    for i in range(width):
        x = F.col(f"_x{i}")
        aggs += [F.avg(x).alias(f"_avg{i}"), F.min(x).alias(f"_min{i}"), F.max(x).alias(f"_max{i}"),
                 F.stddev_samp(x).alias(f"_std{i}"), F.count(x).alias(f"_cnt{i}")]
        if median == "approximate":
            aggs.append(F.percentile_approx(x, 0.5, 10_000).cast("double").alias(f"_med{i}"))
    wide = values.groupBy(*ks, "_b").agg(*aggs)
    nth = lambda i: F.col("_b") * width + i  # noqa: E731  (the number of a column among ``cols``)
    place, name = F.array(*[F.lit(pos[c]) for c in cols]), F.array(*[F.lit(c) for c in cols])
    rows = F.array(*[
        F.struct(F.get(place, nth(i)).alias("position"), F.get(name, nth(i)).alias("column_name"),
                 F.col("_rows").alias("row_count"), F.col(f"_avg{i}").alias("mean"),
                 F.col(f"_min{i}").alias("min"), F.col(f"_max{i}").alias("max"), F.col(f"_std{i}").alias("std"),
                 (F.col("_rows") - F.col(f"_cnt{i}")).alias("missing"),
                 *([F.col(f"_med{i}").alias("median")] if median == "approximate" else []))
        for i in range(width)])
    stats = wide.select(*ks, F.inline(rows)).where(F.col("position").isNotNull())
    if median != "approximate":
        args = [F.lit(width)]
        for i in range(width):
            args += [F.get(place, nth(i)), F.col(f"_x{i}")]
        stacked = values.select(*ks, F.stack(*args).alias("_p", "value"))
        med = exact_median(stacked, [*ks, "_p"], **median_opts).select(*[F.col(k).alias(f"m{k}") for k in ks], "_p", "median")
        on = (F.col("position") == F.col("_p"))
        for k in ks:
            on = on & F.col(k).eqNullSafe(F.col(f"m{k}"))
        stats = stats.join(med, on, "left")
    return stats.select(*[F.col(k).alias(keys[i]) for i, k in enumerate(ks)], "position", "column_name", "row_count",
                        "mean", "median", "min", "max", "std", "missing")


def _with_keys(df: DataFrame, keys, ddl: str) -> str:
    if not keys:
        return ddl
    parts = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    return ", ".join(parts) + ", " + ddl


def value_counts(df: DataFrame, columns=None, keys=(), include_missing: bool = False) -> DataFrame:
    """(keys..., position, column_name, value, n): one hash shuffle on (column, value)."""
    keys = list(keys)
    cols = list(columns) if columns is not None else S.text_columns(df, exclude=keys)
    pos = S.positions(df)
    ks = [f"_k{i}" for i in range(len(keys))]
    cells = F.array(*[F.struct(F.lit(pos[c]).alias("position"), F.lit(c).alias("column_name"),
                               qcol(c).cast("string").alias("value")) for c in cols])
    vc = (df.select(*[qcol(k).alias(ks[i]) for i, k in enumerate(keys)], F.inline(cells))
          .groupBy(*ks, "position", "column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    vc = vc if include_missing else vc.where(F.col("value").isNotNull())
    return vc.select(*[F.col(k).alias(keys[i]) for i, k in enumerate(ks)], "position", "column_name", "value", "n")


def profile_categorical(df: DataFrame, columns=None, keys=()) -> DataFrame:
    """(keys..., position, column_name, unique_values, most_common, most_common_count, missing)."""
    keys = list(keys)
    cols = list(columns) if columns is not None else S.text_columns(df, exclude=keys)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], _with_keys(df, keys, CATEGORICAL_SCHEMA))
    pos = S.positions(df)
    # Keys get working names, so that none of them clashes with a column of the result.
    ks = [f"_k{i}" for i in range(len(keys))]
    named = df.select(*[qcol(k).alias(ks[i]) for i, k in enumerate(keys)], *[qcol(c).cast("string").alias(f"_c{i}") for i, c in enumerate(cols)])
    args = [F.lit(len(cols))]
    for i, c in enumerate(cols):
        args += [F.lit(pos[c]), F.col(f"_c{i}")]
    prof = most_common(named.select(*ks, F.stack(*args).alias("position", "value")), [*ks, "position"])
    names = F.create_map(*[x for c in cols for x in (F.lit(pos[c]), F.lit(c))])
    prof = prof.select(*[F.col(k).alias(keys[i]) for i, k in enumerate(ks)], "position", names[F.col("position")].alias("column_name"),
                       "unique_values", F.col("top").alias("most_common"), F.col("top_n").alias("most_common_count"), "missing")
    if keys:
        return prof
    # An empty table still lists every text column (0 distinct, no most common value).
    listed = spark.createDataFrame([(pos[c], c) for c in cols], "position int, column_name string")
    return (listed.join(prof, ["position", "column_name"], "left")
            .select("position", "column_name",
                    F.coalesce("unique_values", F.lit(0)).cast("bigint").alias("unique_values"),
                    "most_common",
                    F.coalesce("most_common_count", F.lit(0)).cast("bigint").alias("most_common_count"),
                    F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing")))


def profile_categorical_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, position, column_name, unique_values, most_common, most_common_count, missing) of the text columns of tables
    with different schemas: their stacked values are one table keyed by (dataset, position), counted in one exchange, so
    the number of jobs does not grow with the number of tables."""
    key, parts, listed = ["dataset", "position"], [], []
    for name, df in tables.items():
        pos, cols = S.positions(df), S.text_columns(df)
        if cols:
            args = [F.lit(len(cols))]
            for c in cols:
                args += [F.lit(pos[c]), qcol(c).cast("string")]
            parts.append(df.select(F.lit(name).alias("dataset"), F.stack(*args).alias("position", "value")))
        listed += [(name, pos[c], c) for c in cols]
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame(listed, "dataset string, position int, column_name string")
    prof = most_common(reduce(DataFrame.unionAll, parts), key) if parts else names.select(
        *key, F.lit(None).cast("string").alias("top"), *[F.lit(0).cast("bigint").alias(c) for c in ("top_n", "unique_values", "missing")])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return names.join(prof, key, "left").select(*key, "column_name", zero("unique_values").alias("unique_values"), F.col("top").alias("most_common"),
                                                zero("top_n").alias("most_common_count"), zero("missing").alias("missing"))


def dataset_profile(df: DataFrame, dataset_id: str, detected_type: str | None = None) -> DataFrame:
    """One row: (dataset_id, row_count, column_count, columns ARRAY<STRING>, detected_type)."""
    detected = detected_type or S.detect_type(df)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset_id).alias("dataset_id"),
        "row_count",
        F.lit(len(df.columns)).cast("int").alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("columns"),
        F.lit(detected).alias("detected_type"))


def analyze(df: DataFrame, dataset_id: str, median: str = "exact", materialize: bool = True):
    """The full profile of one table: (dataset row, numeric long table, text long table).

    Type detection runs on the header; identifiers are left out of a student profile. The
    results are header-sized and feed several renderers; with ``materialize`` they are
    checkpointed once.
    """
    detected = S.detect_type(df)
    num_cols = S.profiled_numeric_columns(df, detected)
    ds = dataset_profile(df, dataset_id, detected)
    num = profile_numeric(df, num_cols, median=median).select(F.lit(dataset_id).alias("dataset_id"), "*")
    cat = profile_categorical(df).select(F.lit(dataset_id).alias("dataset_id"), "*")
    if materialize:
        ds, num, cat = _ckpt(ds), _ckpt(num), _ckpt(cat)
    return ds, num, cat


def missing_counts(df: DataFrame, columns=None) -> DataFrame:
    """(position, column_name, missing) for every column, one aggregate pass."""
    cols = list(columns) if columns is not None else list(df.columns)
    pos = S.positions(df)
    flt = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    miss = lambda c: (qcol(c).isNull() | F.isnan(qcol(c))) if c in flt else qcol(c).isNull()
    wide = df.agg(*[F.count_if(miss(c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(pos[c]).alias("position"), F.lit(c).alias("column_name"),
                              F.col(f"_m{i}").alias("missing")) for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def analyze_by_key(df: DataFrame, key: str, median: str = "exact", materialize: bool = True):
    """Many datasets in one table, one per value of ``key``: (dataset rows, numeric, text).

    The key identifies the dataset and is not profiled; every dataset shares the header, so
    the type and the profiled columns are decided once.
    """
    cols = [c for c in df.columns if c != key]
    detected = S.detect_type(cols)
    body = df.select(*[qcol(c) for c in df.columns])
    num_cols = [c for c in S.profiled_numeric_columns(body, detected, keys=[key])]
    txt_cols = S.text_columns(body, exclude=[key])
    ds = (df.groupBy(qcol(key).alias(key)).agg(F.count(F.lit(1)).alias("row_count"))
          .select(key, "row_count", F.lit(len(cols)).cast("int").alias("column_count"),
                  F.array(*[F.lit(c) for c in cols]).cast("array<string>").alias("columns"),
                  F.lit(detected).alias("detected_type")))
    num = profile_numeric(df, num_cols, keys=[key], median=median)
    cat = profile_categorical(df, txt_cols, keys=[key])
    if materialize:
        ds, num, cat = _ckpt(ds), _ckpt(num), _ckpt(cat)
    return ds, num, cat


def summaries_by_key(df: DataFrame, key: str) -> DataFrame:
    """(key, summary_text): one data summary per dataset, all datasets in one job graph."""
    from .render import summary_text
    ds, num, cat = analyze_by_key(df, key)
    return summary_text(ds, num, cat, dataset_cols=[key])


def analysis_record(datasets: DataFrame, numeric: DataFrame, categorical: DataFrame,
                    dataset_cols=("dataset_id",)) -> DataFrame:
    """(dataset cols, analysis STRUCT): the nested profile kept in report metadata —
    row_count, column_count, columns, statistics{column → six numbers}, summary{column → four
    values}, detected_type. Each map holds one dataset's columns (bounded by its header)."""
    d = list(dataset_cols)
    stats = numeric.groupBy(*d).agg(F.map_from_entries(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "column_name", "mean", "median", "min", "max", "std",
                                             "missing"))),
        lambda s: F.struct(s["column_name"], F.struct(s["mean"].alias("mean"), s["median"].alias("median"),
                                                      s["min"].alias("min"), s["max"].alias("max"),
                                                      s["std"].alias("std"), s["missing"].alias("missing")))))
        .alias("statistics"))
    summ = categorical.groupBy(*d).agg(F.map_from_entries(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "column_name", "unique_values", "most_common",
                                             "most_common_count", "missing"))),
        lambda s: F.struct(s["column_name"], F.struct(
            s["unique_values"].alias("unique_values"), s["most_common"].alias("most_common"),
            s["most_common_count"].alias("most_common_count"), s["missing"].alias("missing")))))
        .alias("summary"))
    return (datasets.join(stats, d, "left").join(summ, d, "left")
            .select(*d, F.struct("row_count", "column_count", "columns", "statistics", "summary",
                                 "detected_type").alias("analysis")))
