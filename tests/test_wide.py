"""Headers of thousands of columns: the same results, by aggregates that Spark still compiles."""
from pyspark.sql import functions as F

from tablescope.operators import clean as C
from tablescope.operators import profile as P
from tablescope.operators.blocks import in_blocks


def wide(spark, n, rows=30):
    base = spark.range(rows)
    return base.select(*[F.when(F.col("id") % 7 != k % 7, (F.col("id") * (k % 5) + k) % 11).cast("double").alias(f"c{k}") for k in range(n)])


def test_blocks_give_the_results_of_single_columns(spark):
    df = wide(spark, 40)
    got = {r["column_name"]: r for r in P.profile_numeric(df).collect()}
    assert len(got) == 40
    for c in ("c0", "c13", "c24", "c39"):
        one = df.agg(F.avg(c), F.median(c), F.min(c), F.max(c), F.stddev_samp(c), F.count_if(F.col(c).isNull())).first()
        r = got[c]
        assert [round(x, 9) for x in (r["mean"], r["median"], r["min"], r["max"], r["std"], r["missing"])] == [round(x, 9) for x in one]


def test_aggregates_of_wide_headers_stay_compiled(spark, tmp_path):
    wide(spark, 400, 20).coalesce(1).write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    rows, width = in_blocks(df, [], x=[F.col(c) for c in df.columns])
    agg = rows.groupBy("_b").agg(*[f(f"x{j}") for j in range(width) for f in (F.avg, F.min, F.max, F.stddev_samp, F.count)])
    agg.collect()
    plan = agg._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(rows.columns) <= 100 and all("*(" in line for line in plan.splitlines() if "HashAggregate(" in line)
    prof = P.profile_numeric(df, median="approximate").collect()
    assert len(prof) == 400 and {r["row_count"] for r in prof} == {20}


def test_empty_wide_table_lists_every_column(spark):
    prof = P.profile_numeric(wide(spark, 30).limit(0)).collect()
    assert len(prof) == 30 and all((r["row_count"], r["missing"], r["median"]) == (0, 0, None) for r in prof)
    out, report = C.clean(wide(spark, 30).limit(0))
    assert report.rows_out == 0 and len(report.empty_columns) == 30


def test_wide_clean_converts_and_fills_every_block(spark):
    df = spark.range(20).select(*[F.when(F.col("id") != k % 20, F.concat((F.col("id") + k).cast("string"), F.lit(",5"))).alias(f"t{k}") for k in range(60)],
                                *[F.lit(None).cast("string").alias(f"e{k}") for k in range(15)])
    out, report = C.clean(df)
    assert set(dict(out.dtypes).values()) == {"double"} and len(out.columns) == 60 and len(report.empty_columns) == 15
    assert (report.rows_in, report.rows_out) == (20, 20)
    first = out.agg(*[F.count(c).alias(c) for c in out.columns]).first()
    assert set(first) == {20}
