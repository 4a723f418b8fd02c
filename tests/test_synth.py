from pyspark.sql import functions as F

from tablescope.operators import synth as Y
from tablescope.operators.schema import detect_type


def test_students_shape_ranges_and_rules(spark):
    df = Y.synth_students(spark, 30)
    rows = df.collect()
    assert len(rows) == 30 and rows[0]["NIM"] == "2100001" and detect_type(df) == "student"
    for r in rows:
        assert 65 <= r["Nilai UTS"] <= 95 and 60 <= r["Nilai UAS"] <= 100 and 70 <= r["Nilai Tugas"] <= 100
        assert r["Nilai Akhir"] == int(0.3 * r["Nilai UTS"] + 0.4 * r["Nilai UAS"] + 0.3 * r["Nilai Tugas"])
        lo, hi = (3.5, 4.0) if r["Nilai Akhir"] >= 85 else (3.0, 3.5) if r["Nilai Akhir"] >= 70 else (2.5, 3.0)
        assert lo <= r["IPK"] <= hi and round(r["IPK"], 2) == r["IPK"]
        assert r["Status"] in ("Aktif", "Cuti") and 1 <= r["Semester"] <= 8


def test_generation_independent_of_partitioning(spark):
    a = Y.students(spark.range(1, 200, numPartitions=1), "id").collect()
    b = Y.students(spark.range(1, 200, numPartitions=7), "id").collect()
    assert sorted(a) == sorted(b)


def test_finance_grid_and_balance(spark):
    df = Y.synth_finance(spark)
    rows = df.collect()
    assert len(rows) == 48 and detect_type(df) == "unknown"
    assert df.select("Bulan", "Kategori").distinct().count() == 48
    for r in rows:
        assert r["Saldo (Rp)"] == r["Pemasukan (Rp)"] - r["Pengeluaran (Rp)"]
        if "SPP" in r["Kategori"]:
            assert 150_000_000 <= r["Pemasukan (Rp)"] <= 200_000_000 and r["Pengeluaran (Rp)"] == 0
        if "Gaji" in r["Kategori"]:
            assert r["Pemasukan (Rp)"] == 0
    assert df.where(F.col("Bulan") == "Juni").count() == 8
