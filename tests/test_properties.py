"""Properties from SURVEY §5(c), on small generated frames (few examples: each is a Spark job)."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.operators import clean as C
from tablescope.operators import profile as P
from tablescope.operators.median import exact_median

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

cell_num = st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-100, 100, allow_nan=False))
cell_txt = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "1,5", "2", ""]))
rows = st.lists(st.tuples(st.integers(0, 3), cell_num, cell_txt), min_size=1, max_size=25)


@SETTINGS
@given(rows)
def test_clean_invariants(spark, data):
    df = spark.createDataFrame(data, "k long, x double, t string")
    out, rep = C.clean(df)
    assert rep.rows_in == len(data)
    assert rep.rows_out == out.count() == len(set(data))
    for c, dt in out.dtypes:
        if c in rep.fill_values and rep.fill_values[c] is not None:
            assert out.where(F.col(c).isNull()).count() == 0
    if "x" in out.columns:  # present numbers keep their value
        present = {(k, x) for k, x, _ in data if x is not None}
        got = {(r["k"], r["x"]) for r in out.collect()}
        assert present <= got


@SETTINGS
@given(rows)
def test_value_counts_plus_missing_is_rows(spark, data):
    df = spark.createDataFrame(data, "k long, x double, t string")
    total = P.value_counts(df, ["t"]).agg(F.sum("n")).first()[0] or 0
    missing = P.missing_counts(df, ["t"]).first()["missing"]
    assert total + missing == len(data)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.integers(-3, 3).map(float),
                                                        st.floats(-1e6, 1e6, allow_nan=False))),
                min_size=1, max_size=80),
       st.integers(1, 20))
def test_exact_median_any_limit(spark, data, limit):
    pdf = pd.DataFrame(data, columns=["g", "value"])
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], finish_rows=limit, buckets=8).collect()}
    want = {g: float(np.median(s["value"])) for g, s in pdf.groupby("g")}
    assert got.keys() == want.keys()
    for g in want:
        assert abs(got[g] - want[g]) <= 1e-9 * max(1.0, abs(want[g]))
