import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators import profile as P
from tablescope.operators.median import exact_median


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols[:1]).collect()]


def test_numeric_matches_pandas(spark):
    pdf = pd.DataFrame({"a": [1, 2, 4, 9, 9, 3], "b": [0.5, None, 2.5, 1.0, 1.0, 7.25]})
    df = spark.createDataFrame(pdf)
    got = {r["column_name"]: r for r in P.profile_numeric(df).collect()}
    for c in ("a", "b"):
        s = pdf[c]
        assert got[c]["mean"] == pytest.approx(s.mean())
        assert got[c]["median"] == pytest.approx(s.median())
        assert got[c]["min"] == s.min() and got[c]["max"] == s.max()
        assert got[c]["std"] == pytest.approx(s.std())
        assert got[c]["missing"] == int(s.isna().sum())
    assert got["a"]["median"] == 3.5  # interpolated, pandas semantics


def test_median_of_four_is_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    assert P.profile_numeric(df).first()["median"] == 3.0


def test_nan_is_missing_and_one_row_std_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,)], "x double")
    r = P.profile_numeric(df).first()
    assert r["missing"] == 1 and r["mean"] == 5.0 and r["std"] is None  # D7, D8


@pytest.mark.parametrize("limit", [3, 50])
def test_exact_median_narrowing_path(spark, limit):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(1000, 0.25), rng.integers(0, 40, 500)])
    groups = np.repeat([0, 1, 2], [1500, 1500, 1500])
    pdf = pd.DataFrame({"g": groups, "value": vals.astype(float)})
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], finish_rows=limit, buckets=16).collect()}
    for g, sub in pdf.groupby("g"):
        assert got[g] == pytest.approx(float(np.median(sub["value"])))


@pytest.mark.parametrize("limit", [2, 10_000])
def test_grouped_profile_null_key_both_median_paths(spark, limit):
    """A NULL group key is a group of its own in the one-pass path and in the narrowing rounds."""
    rows = [(k, float(v)) for k in ("a", None) for v in range(1, 8)] + [(None, None), ("a", 100.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in P.profile_numeric(df, ["x"], keys=["k"], finish_rows=limit, buckets=4).collect()}
    assert got["a"]["median"] == 4.5 and got["a"]["row_count"] == 8 and got["a"]["missing"] == 0
    assert got[None]["median"] == 4.0 and got[None]["row_count"] == 8 and got[None]["missing"] == 1
    assert got[None]["std"] == pytest.approx(pd.Series(range(1, 8)).std())


def test_profile_of_empty_table_lists_columns(spark):
    df = spark.createDataFrame([], "x double, y long")
    got = {r["column_name"]: r for r in P.profile_numeric(df).collect()}
    assert set(got) == {"x", "y"}
    assert all(r["row_count"] == 0 and r["missing"] == 0 and r["median"] is None for r in got.values())


def test_categorical_ties_go_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")  # D5
    r = P.profile_categorical(df).first()
    assert (r["unique_values"], r["most_common"], r["most_common_count"], r["missing"]) == (2, "a", 2, 1)


def test_categorical_empty_and_all_missing(spark):
    empty = spark.createDataFrame([], "t string")
    r = P.profile_categorical(empty).first()
    assert (r["unique_values"], r["most_common"], r["most_common_count"], r["missing"]) == (0, None, 0, 0)
    nulls = spark.createDataFrame([(None,), (None,)], "t string")
    r = P.profile_categorical(nulls).first()
    assert (r["unique_values"], r["most_common"], r["most_common_count"], r["missing"]) == (0, None, 0, 2)


def test_value_counts_sum_plus_missing_is_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    vc = P.value_counts(df, ["o_orderpriority"])
    total = vc.agg(F.sum("n")).first()[0]
    miss = P.missing_counts(df, ["o_orderpriority"]).first()["missing"]
    assert total + miss == df.count()


def test_grouped_profile_matches_pandas(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    pdf = df.toPandas()
    got = P.profile_numeric(df, ["l_quantity"], keys=["l_returnflag"]).collect()
    for r in got:
        s = pdf.loc[pdf.l_returnflag == r["l_returnflag"], "l_quantity"]
        assert r["median"] == pytest.approx(s.median()) and r["mean"] == pytest.approx(s.mean())


def test_analyze_student_excludes_identifiers(spark):
    df = spark.createDataFrame([(2100001, "Ani", 80, 3.5), (2100002, "Budi", 70, 3.1)],
                               "NIM long, `Nama Mahasiswa` string, `Nilai UTS` long, IPK double")
    ds, num, cat = P.analyze(df, "students")
    assert ds.first()["detected_type"] == "student"
    assert sorted(r["column_name"] for r in num.collect()) == ["IPK", "Nilai UTS"]
    assert [r["column_name"] for r in cat.collect()] == ["Nama Mahasiswa"]
    assert not math.isnan(num.where("column_name = 'IPK'").first()["mean"])
