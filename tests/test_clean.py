import pytest
from pyspark.sql import functions as F

from tablescope.operators import clean as C


def test_dedup_before_coercion_keeps_both_spellings(spark):
    df = spark.createDataFrame([("1,5",), ("1.5",), ("1,5",)], "x string")  # D1
    out, rep = C.clean(df)
    assert rep.duplicates_removed == 1 and rep.rows_out == 2
    assert sorted(r["x"] for r in out.collect()) == [1.5, 1.5]
    assert dict(out.dtypes)["x"] == "double"


@pytest.mark.parametrize("bad", ["1d", "0x10", "1_000", "1.234.56", "nan", " "])
def test_refused_numbers_keep_column_text(spark, bad):
    df = spark.createDataFrame([("1,5",), (bad,)], "x string")  # D2
    out = C.coerce_numbers(df)
    assert dict(out.dtypes)["x"] == "string"
    assert sorted(r["x"] for r in out.collect()) == sorted(["1.5", bad.replace(",", ".")])


@pytest.mark.parametrize("good,expected", [(" 12 ", 12.0), ("+5", 5.0), (".5", 0.5), ("5.", 5.0),
                                           ("1e5", 1e5), ("inf", float("inf")), ("Infinity", float("inf"))])
def test_accepted_number_grammar(spark, good, expected):
    df = spark.createDataFrame([("0,5",), (good,)], "x string")
    got = sorted(r["x"] for r in C.coerce_numbers(df).collect())
    assert got == sorted([0.5, expected])


def test_prose_commas_become_dots(spark):
    df = spark.createDataFrame([("Smith, John",), ("1,234,567",)], "x string")  # D3
    assert sorted(r["x"] for r in C.coerce_numbers(df).collect()) == ["1.234.567", "Smith. John"]
    kept = C.coerce_numbers(df, rewrite_text=False)
    assert sorted(r["x"] for r in kept.collect()) == ["1,234,567", "Smith, John"]


def test_integer_text_without_gaps_is_bigint(spark):
    df = spark.createDataFrame([("12",), (" 7 ",)], "x string")  # C5
    assert dict(C.coerce_numbers(df).dtypes)["x"] == "bigint"
    gaps = spark.createDataFrame([("12",), ("",)], "x string")
    out = C.coerce_numbers(gaps)
    assert dict(out.dtypes)["x"] == "double" and sorted(r["x"] for r in out.collect() if r["x"] is not None) == [12.0]


def test_only_blank_column_stays_missing(spark):
    df = spark.createDataFrame([("",), ("",)], "x string")  # D9
    out, rep = C.clean(df)
    assert rep.empty_columns == [] and dict(out.dtypes)["x"] == "double"
    assert [r["x"] for r in out.collect()] == [None]  # dedup leaves one row, mean of nothing


def test_fill_mean_and_mode(spark):
    df = spark.createDataFrame([(1, 2.0, "b"), (2, None, "a"), (3, 4.0, None), (4, float("nan"), "b")],
                               "k long, x double, t string")
    out, rep = C.clean(df)
    rows = {r["k"]: r for r in out.collect()}
    assert rows[2]["x"] == 3.0 and rows[4]["x"] == 3.0 and rows[3]["t"] == "b"
    assert dict(out.dtypes)["k"] == "bigint"  # complete column keeps its type


def test_mode_ties_to_smallest_and_no_mode_is_blank(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    assert sorted(r["t"] for r in C.fill_mode(df).collect()) == ["a", "a", "b"]


def test_empty_columns_dropped_and_counted(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None)], "k long, e string")
    out, rep = C.clean(df)
    assert out.columns == ["k"] and rep.empty_columns == ["e"] and rep.duplicates_removed == 1
    s = rep.to_df(spark).first()
    assert (s["rows_in"], s["rows_out"], s["empty_columns_dropped"]) == (3, 2, 1)


def test_duplicates_removed_counts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (2, float("nan"))], "k long, x double")
    r = C.duplicates_removed(df).first()
    assert (r["rows_in"], r["rows_out"], r["duplicates_removed"]) == (4, 2, 2)


def test_clean_properties_on_orders(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_totalprice")))
    out, rep = C.clean(df)
    assert out.count() == df.distinct().count() == rep.rows_out
    assert out.where(F.col("o_totalprice").isNull()).count() == 0
    kept = out.join(df.where(F.col("o_totalprice").isNotNull()).select("o_orderkey", F.col("o_totalprice").alias("t")),
                    "o_orderkey")
    assert kept.where(F.col("t") != F.col("o_totalprice")).count() == 0  # present cells keep their value


def test_nan_only_column_is_empty(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None)], "k long, x double")
    out, rep = C.clean(df)
    assert rep.empty_columns == ["x"] and out.columns == ["k"]
    assert C.drop_empty_columns(df).columns == ["k"]
