from tablescope.operators import validate as V


def _v(spark, rows, departments=None, totals=None):
    reports = spark.createDataFrame(rows, "report_id int, dataset_id int, report_text string")
    d = spark.createDataFrame(departments, "dataset_id int, department string") if departments is not None else None
    t = spark.createDataFrame(totals, "dataset_id int, total_students long") if totals is not None else None
    return {r["report_id"]: r for r in V.validate_reports(reports, d, t).collect()}


def test_length_boundary_and_placeholder(spark):
    out = _v(spark, [(1, 1, "x" * 199), (2, 1, "y" * 200), (3, 1, "Data Tidak Dapat dipastikan " + "z" * 200)])
    assert out[1]["issues"] == ["Teks laporan terlalu pendek (<200 karakter)"]
    assert out[2]["is_valid"] and out[2]["issues"] == []
    assert out[3]["issues"] == ["Laporan menyiratkan ketidakpastian atau kekurangan data"]


def test_entities_once_per_occurrence_and_empty_list_not_checked(spark):
    text = "Departemen Teknik naik, Departemen Hukum turun, Departemen Hukum lagi. " + "a" * 200
    out = _v(spark, [(1, 1, text), (2, 2, text)], departments=[(1, "Teknik"), (1, "Ekonomi")])
    assert out[1]["issues"] == ["Departemen 'Hukum' disebut dalam teks, tapi tidak ada di data"] * 2  # D14
    assert out[2]["is_valid"]  # dataset 2 has no department list


def test_claim_tolerance(spark):
    base = "b" * 200
    rows = [(1, 1, f"mahasiswa = 105 {base}"), (2, 1, f"mahasiswa: 106 {base}"), (3, 2, f"mahasiswa 2 {base}"),
            (4, 2, f"mahasiswa 3 {base}"), (5, 1, f"Mahasiswa = 999 {base}"), (6, 3, f"mahasiswa = 1 {base}")]
    out = _v(spark, rows, totals=[(1, 100), (2, 1)])
    assert out[1]["is_valid"]  # 5 == 5% of 100, not beyond
    assert out[2]["issues"] == ["Isi narasi menyebut total mahasiswa = 106, tetapi data menyebut 100"]
    assert out[3]["is_valid"]  # |2-1| = 1 is within max(1, 0.05)
    assert not out[4]["is_valid"]
    assert out[5]["is_valid"]  # case-sensitive pattern
    assert out[6]["is_valid"]  # no total for dataset 3


def test_number_count_and_order_of_issues(spark):
    text = "Departemen Xyz mahasiswa = 50 angka 1.5 dan 3. tidak dapat"
    out = _v(spark, [(1, 1, text)], departments=[(1, "Abc")], totals=[(1, 10)])
    assert out[1]["num_extracted"] == 3
    assert out[1]["issues"] == [
        "Teks laporan terlalu pendek (<200 karakter)",
        "Laporan menyiratkan ketidakpastian atau kekurangan data",
        "Departemen 'Xyz' disebut dalam teks, tapi tidak ada di data",
        "Isi narasi menyebut total mahasiswa = 50, tetapi data menyebut 10"]


def test_ascii_digits_only(spark):
    out = _v(spark, [(1, 1, "١٢٣ and 12")])  # D16: Unicode digits are not numbers here
    assert out[1]["num_extracted"] == 1
