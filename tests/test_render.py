from pyspark.sql import functions as F

from tablescope.functions.text import fixed2
from tablescope.operators import profile as P
from tablescope.operators import render as R


def test_fixed2_rounds_binary_value_half_even(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.375,), (1.005,), (1e20,), (None,), (float("nan"),),
                                (float("inf"),), (-3.0,)], "x double")
    got = [r[0] for r in df.select(fixed2(F.col("x"))).collect()]
    assert got == [f"{v:.2f}" for v in (0.125, 2.675, 0.375, 1.005, 1e20)] + ["nan", "nan", "inf", "-3.00"]  # D6


GOLDEN = """Data Overview:
- Total records: 3
- Total columns: 4
- Detected type: student

Columns:
- NIM
- Nama
- Nilai
- Kosong

Numerical Statistics:

Nilai:
  - Mean: 80.00
  - Median: 80.00
  - Range: 70.00 - 90.00
  - Std Dev: 10.00

Categorical Data:

Nama:
  - Unique values: 2
  - Most common: Ani (2 times)

Kosong:
  - Unique values: 1"""


def test_summary_text_golden(spark):
    df = spark.createDataFrame([(1, "Ani", 70, ""), (2, "Ani", 80, ""), (3, "Budi", 90, "")],
                               "NIM long, Nama string, Nilai long, Kosong string")
    ds, num, cat = P.analyze(df, "s")
    assert R.summary_text(ds, num, cat).first()["summary_text"] == GOLDEN  # '' most common is not printed


def test_summary_without_sections(spark):
    df = spark.createDataFrame([(True,)], "flag boolean")
    ds, num, cat = P.analyze(df, "b")
    text = R.summary_text(ds, num, cat).first()["summary_text"]
    assert text == "Data Overview:\n- Total records: 1\n- Total columns: 1\n- Detected type: unknown\n\nColumns:\n- flag"


def test_prompt_templates_and_default(spark):
    df = spark.createDataFrame([("S", "student_performance"), ("S", "financial_analysis"), ("S", "whatever")],
                               "s string, t string")
    got = [r[0] for r in df.select(R.prompt_expr(F.col("s"), F.col("t"))).collect()]
    assert "performa mahasiswa" in got[0] and "laporan keuangan" in got[1] and "analitis umum" in got[2]
    for p in got:
        assert p.startswith(R.PROMPT_BASE) and p.endswith("DATA YANG HARUS DIANALISIS:\nS\n\n" + R.PROMPT_CLOSING)


def test_usage_section_and_fallback_golden(spark):
    df = spark.createDataFrame([(1, 10, 20, 30, "teks"), (2, None, 5, 5, "teks"), (3, 1, None, None, None)],
                               "dataset_id int, prompt_tokens long, output_tokens long, total_tokens long, text string")
    req = df.select("dataset_id", F.lit("RINGKASAN").alias("summary_text"))
    out = {r["dataset_id"]: r for r in R.attach_generated(req, df.where("text is not null")).collect()}
    assert out[1]["report_text"] == ("teks\n\n---\n### 📊 Token Usage\n- Prompt tokens: **10**\n"
                                     "- Output tokens: **20**\n- Total tokens: **30**")
    assert out[2]["report_text"] == "teks\n\n---\n### 📊 Token Usage\n_Token usage data tidak tersedia._"
    assert out[3]["report_text"] == ("# Laporan Universitas (Fallback)\n\nLaporan ini dihasilkan berdasarkan data "
                                     "berikut:\n\nRINGKASAN\n\n*Catatan: AI gagal menghasilkan teks, sehingga laporan "
                                     "fallback digunakan.*")
    assert out[3]["generated"] is False and out[3]["prompt_tokens"] is None and out[1]["n_chars"] == 4
