from tablescope.operators import schema as S


def test_detect_type_order_and_substrings():
    assert S.detect_type(["NIM", "Nama Mahasiswa", "IPK"]) == "student"
    assert S.detect_type(["Bulan", "Kategori", "Pemasukan (Rp)", "Pengeluaran (Rp)", "Saldo (Rp)"]) == "unknown"  # D12
    assert S.detect_type(["Nama Barang", "Biaya"]) == "student"  # D11: 'nama' inside a longer name, student first
    assert S.detect_type(["Revenue", "Expense"]) == "finance"
    assert S.detect_type(["x", "y"]) == "unknown"


def test_identifier_exclusion_substring(spark):
    df = spark.createDataFrame([(1, 2, 3, 4.0)], "Bidang long, kode_mk long, NIM long, Nilai double")
    assert S.profiled_numeric_columns(df, "student") == ["Nilai"]  # 'Bidang' holds 'id'
    assert S.profiled_numeric_columns(df, "finance") == ["Bidang", "kode_mk", "NIM", "Nilai"]


def test_detect_types_per_dataset(spark):
    names = spark.createDataFrame([(1, "Nilai UTS"), (1, "kode"), (2, "Biaya"), (3, "Bulan")],
                                  "dataset_id int, column_name string")
    got = {r["dataset_id"]: r["detected_type"] for r in S.detect_types(names).collect()}
    assert got == {1: "student", 2: "finance", 3: "unknown"}


def test_exclude_identifiers_table(spark):
    names = spark.createDataFrame([(1, 1, "Nilai widget", True), (1, 2, "Nilai UAS", True), (2, 1, "Biaya id", True),
                                   (1, 3, "Nama", False)],
                                  "dataset_id int, position int, column_name string, is_numeric boolean")
    kept = S.exclude_identifiers(names, S.detect_types(names))
    assert sorted((r["dataset_id"], r["column_name"]) for r in kept.collect()) == [(1, "Nilai UAS"), (2, "Biaya id")]
