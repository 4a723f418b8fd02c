"""Table cleaning: dedup → drop empty columns → coerce text to numbers → fill means → fill modes.

Two data passes decide the output schema, then one lazy plan produces the cleaned table:

* pass 1 over the deduplicated rows: non-null count per column (P4/A19), and for every
  text column whether all of it converts after comma → dot (A20) and whether it is
  integral without gaps (C5). The input row count rides along as an observation (A2).
* pass 2: column means after coercion (A17) and, for text columns with gaps only, the
  most frequent value with ties to the smallest (A18), from one (column, value) count.

Fill values are one scalar per column (bounded by the header width), applied with
``coalesce`` — no join, no cross join. The deduplicated rows are written once to the
checkpoint folder between the passes, so the dedup shuffle runs once and a lost executor costs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import qcol
from ..functions.numbers import (blank_is_missing, comma_to_dot, nan_is_missing, text_to_double, text_to_long,
                                 text_to_unsigned)
from . import schema as S
from . import votes as VT
from .blocks import in_blocks
from .top import most_common
from ..session import checkpoint as _ckpt
from ..session import release as _release


@dataclass
class CleanReport:
    rows_in: int
    rows_out: int
    duplicates_removed: int
    empty_columns: list[str]
    converted: dict[str, str] = field(default_factory=dict)
    fill_values: dict[str, object] = field(default_factory=dict)
    written: DataFrame | None = field(default=None, repr=False)

    def release(self) -> None:
        """Delete the written dedup result once the cleaned table has been written or is not needed.
        (It goes with the application otherwise.)"""
        if self.written is not None:
            _release(self.written)
            self.written = None

    def to_df(self, spark, dataset_id: str | None = None) -> DataFrame:
        return spark.createDataFrame(
            [(dataset_id, self.rows_in, self.rows_out, self.duplicates_removed, len(self.empty_columns),
              self.empty_columns)],
            "dataset_id string, rows_in bigint, rows_out bigint, duplicates_removed bigint, "
            "empty_columns_dropped bigint, empty_columns array<string>")


def dedup(df: DataFrame) -> DataFrame:
    """Full-row distinct (A1): NULL equals NULL, NaN equals NaN; hash aggregate with map-side combine."""
    return df.dropDuplicates()


def duplicates_removed(df: DataFrame) -> DataFrame:
    """(rows_in, rows_out, duplicates_removed) from one grouped count: sum(n) and count(groups)."""
    cols = [qcol(c) for c in df.columns]
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").cast("bigint").alias("rows_in"),
                      F.count(F.lit(1)).alias("rows_out")).select(
        "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("duplicates_removed"))


def _present(df: DataFrame, c: str):
    """The column with every kind of missing (NULL, and NaN in floating columns) as NULL."""
    dt = df.schema[c].dataType
    return nan_is_missing(qcol(c)) if isinstance(dt, (T.FloatType, T.DoubleType)) else qcol(c)


def empty_columns(df: DataFrame) -> list[str]:
    """Columns with no present value (A19), from one aggregate of non-missing counts."""
    counts = df.agg(*[F.count(_present(df, c)).alias(f"_c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if counts[f"_c{i}"] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df)) if df.columns else df


@dataclass
class ConversionPlan:
    rows: int
    nonnull: dict[str, int]
    targets: dict[str, str]
    gaps: dict[str, int]
    rows_in: int | None = None


def conversion_plan(df: DataFrame, counted: str | None = None, source: DataFrame | None = None) -> ConversionPlan:
    """One pass: rows, non-null count per column, target type per text column, and the
    number of cells each column will have missing after coercion.

    ``source``/``counted``: aggregate over a frame that has ``df``'s columns and a column ``counted`` of copies per row,
    whose sum is the number of rows before the dedup. Wide headers are judged in blocks of columns (``blocks``).
    """
    texts, nums, names = set(S.text_columns(df)), set(S.numeric_columns(df)), df.columns
    if not names:
        return ConversionPlan((df if source is None else source).count(), {}, {}, {})
    none = F.lit(None).cast("int")
    rows, width = in_blocks(df if source is None else source, [], copies=[qcol(counted) if counted else F.lit(1).cast("bigint")] * len(names),
                            there=[_present(df, c).isNotNull().cast("int") for c in names],
                            vote=[VT.vote(blank_is_missing(qcol(c))) if c in texts else none for c in names])
    aggs = [F.sum("_one").alias("_rows"), F.coalesce(F.sum("copies0"), F.lit(0)).alias("_rows_in")]
    for j in range(width):
        aggs += [F.coalesce(F.sum(f"there{j}"), F.lit(0)).alias(f"_nn{j}"), *VT.tally(F.col(f"vote{j}"), f"_every{j}", f"_some{j}"),
                 F.count(f"vote{j}").alias(f"_seen{j}")]
    found = []
    for j in range(width):
        every, some, seen = (F.col(f"{k}{j}") for k in ("_every", "_some", "_seen"))
        # Whole numbers beyond 64 bits are refused: the column stays text and loses nothing.
        to = F.when((F.col(f"_nn{j}") > 0) & (VT.is_number(every, some) | (seen == 0)), VT.number_type(every, some, seen == F.col("_rows")))
        found.append(F.struct((F.col("_b") * width + j).alias("i"), F.col(f"_nn{j}").alias("nonnull"), seen.alias("seen"), to.alias("target")))
    judged = rows.groupBy("_b").agg(*aggs).select("_rows", "_rows_in", F.inline(F.array(*found))).where(F.col("i") < len(names)).collect()  # one row per column
    total = judged[0]["_rows"]
    nonnull, targets, gaps = {}, {}, {}
    for r in sorted(judged, key=lambda r: r["i"]):
        c = names[r["i"]]
        nonnull[c] = r["nonnull"]
        if c in texts and r["target"]:
            targets[c], gaps[c] = r["target"], total - r["seen"]
        elif c in texts or c in nums:
            gaps[c] = total - r["nonnull"]
    return ConversionPlan(total, nonnull, targets, gaps, judged[0]["_rows_in"] if counted else None)


def coerce(df: DataFrame, targets: dict[str, str], rewrite_text: bool = True) -> DataFrame:
    """Apply C1/C2/C5: converted columns get their type; other text columns keep text (commas → dots)."""
    texts = set(S.text_columns(df))
    out = []
    for c in df.columns:
        if c in targets:
            v = blank_is_missing(comma_to_dot(qcol(c)))
            to = {"bigint": text_to_long, "double": text_to_double}.get(targets[c], text_to_unsigned)
            out.append(to(v).alias(c))
        elif c in texts and rewrite_text:
            out.append(comma_to_dot(qcol(c)).alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def coerce_numbers(df: DataFrame, rewrite_text: bool = True) -> DataFrame:
    """Text columns that fully convert become numbers; the rest stay text (with dots)."""
    return coerce(df, conversion_plan(df).targets, rewrite_text)


def fill_values(df: DataFrame, numeric_cols: list[str], text_cols: list[str]) -> dict[str, object]:
    """Mean per numeric column (NaN counts as missing) and mode per text column with gaps."""
    values: dict[str, object] = {}
    if numeric_cols:
        rows, width = in_blocks(df, [], x=[_num(df, c) for c in numeric_cols])
        means = rows.groupBy("_b").agg(*[F.avg(f"x{j}").alias(f"_m{j}") for j in range(width)]).select(
            F.inline(F.array(*[F.struct((F.col("_b") * width + j).alias("i"), F.col(f"_m{j}").alias("mean")) for j in range(width)])))
        values.update({numeric_cols[r["i"]]: r["mean"] for r in means.collect() if r["i"] < len(numeric_cols)})
    if text_cols:
        cells = F.array(*[F.struct(F.lit(i).alias("position"), qcol(c).alias("value")) for i, c in enumerate(text_cols)])
        tops = {r["position"]: r["top"] for r in most_common(df.select(F.inline(cells)), ["position"]).collect()}  # one row per column
        found = {c: tops.get(i) for i, c in enumerate(text_cols)}
        values.update({c: found.get(c) if found.get(c) is not None else "" for c in text_cols})
    return values


def _num(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    x = qcol(c).cast("double")
    return nan_is_missing(x) if isinstance(dt, (T.FloatType, T.DoubleType)) else x


def _gaps(df: DataFrame, num_cols, text_cols) -> tuple[list[str], list[str]]:
    """Which of the columns have at least one missing cell (one aggregate)."""
    if not (num_cols or text_cols):
        return [], []
    r = df.agg(*[F.count_if(_num(df, c).isNull()).alias(f"_g{i}") for i, c in enumerate(num_cols)],
               *[F.count_if(qcol(c).isNull()).alias(f"_t{i}") for i, c in enumerate(text_cols)]).first()
    return ([c for i, c in enumerate(num_cols) if r[f"_g{i}"] > 0],
            [c for i, c in enumerate(text_cols) if r[f"_t{i}"] > 0])


def fill_mean(df: DataFrame, columns=None, means: dict | None = None) -> DataFrame:
    """Missing numeric cells → column mean.

    Only columns with gaps change, and they become DOUBLE; complete columns keep their type.
    With ``means`` given, ``columns`` are taken as the columns to fill.
    """
    cols = list(columns) if columns is not None else S.numeric_columns(df)
    if means is None:
        cols, _ = _gaps(df, cols, [])
        means = fill_values(df, cols, [])
    out = []
    for c in df.columns:
        if c in cols and means.get(c) is not None:
            out.append(F.coalesce(_num(df, c), F.lit(float(means[c]))).alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def fill_mode(df: DataFrame, columns=None, modes: dict | None = None) -> DataFrame:
    """Missing text cells → most frequent value, ties to the smallest; none → '' (A18/C4).

    Only text columns with gaps are touched.
    """
    cols = list(columns) if columns is not None else S.text_columns(df)
    if modes is None:
        _, cols = _gaps(df, [], cols)
        modes = fill_values(df, [], cols)
    return df.select(*[F.coalesce(qcol(c), F.lit(modes[c])).alias(c) if c in modes and c in cols
                       else qcol(c) for c in df.columns])


def _grouped(df: DataFrame) -> DataFrame:
    return df.groupBy(*[qcol(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))


def _plan(df: DataFrame, grouped: DataFrame) -> tuple[DataFrame, ConversionPlan, list[str]]:
    deduped = grouped.select(*[qcol(c) for c in df.columns])
    plan = conversion_plan(deduped, "__copies", grouped)
    return deduped, plan, [c for c in deduped.columns if plan.nonnull[c] == 0]


def cleaning_summary(df: DataFrame) -> CleanReport:
    """What ``clean`` would remove and convert, from one pass: no fill values, nothing written."""
    _, plan, empty = _plan(df, _grouped(df))
    rows_in = plan.rows_in or 0
    return CleanReport(rows_in, plan.rows, rows_in - plan.rows, empty,
                       {c: t for c, t in plan.targets.items() if c not in empty})


def clean(df: DataFrame, rewrite_text: bool = True) -> tuple[DataFrame, CleanReport]:
    """The whole clean step. Returns (cleaned lazy DataFrame, report).

    The dedup is a grouped count over all columns, so the input row count is ``sum(copies)``
    of the same aggregate — exact even when stages are re-run after an executor loss.
    """
    grouped = _ckpt(_grouped(df))
    deduped, plan, empty = _plan(df, grouped)
    rows_in = plan.rows_in or 0
    kept = deduped.drop(*empty) if empty else deduped
    targets = {c: t for c, t in plan.targets.items() if c not in empty}
    coerced = coerce(kept, targets, rewrite_text)
    num_fill = [c for c in S.numeric_columns(coerced) if plan.gaps.get(c, 0) > 0]
    text_fill = [c for c in S.text_columns(coerced) if plan.gaps.get(c, 0) > 0]
    values = fill_values(coerced, num_fill, text_fill)
    out = fill_mode(fill_mean(coerced, num_fill, values), text_fill, values)
    report = CleanReport(rows_in=rows_in, rows_out=plan.rows, duplicates_removed=rows_in - plan.rows,
                         empty_columns=empty, converted=targets, fill_values=values, written=grouped)
    return out, report
