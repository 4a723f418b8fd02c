"""Sample tables: students (S5) and monthly finance lines.

Each row is a pure function of its id: draws are md5-keyed (``functions.draws``), so the
output does not depend on partitioning and any id column — ``spark.range`` or the keys of
an existing table — drives the generator. The month × category grid is decoded from the
id (id div 8, id mod 8) instead of a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import pick, rand_int, rand_real2, uniform01

# Sample-table vocabulary and ranges.
FIRST_NAMES = ("Ahmad", "Budi", "Siti", "Dewi", "Eko", "Fitri", "Gita", "Hadi",
               "Indah", "Joko", "Kartika", "Lina", "Made", "Nur", "Okta")
LAST_NAMES = ("Santoso", "Pratama", "Wijaya", "Kusuma", "Putra", "Putri",
              "Hidayat", "Rahman", "Sari", "Wati")
SEMESTERS = (1, 2, 3, 4, 5, 6, 7, 8)
MID_RANGE = (65, 95)
FINAL_RANGE = (60, 100)
TASK_RANGE = (70, 100)
SCORE_WEIGHTS = (0.3, 0.4, 0.3)
GPA_BANDS = ((85, 3.5, 4.0), (70, 3.0, 3.5), (None, 2.5, 3.0))  # (min score, gpa lo, gpa hi)
ACTIVE_SHARE_CUT = 0.1  # draw above → 'Aktif', else 'Cuti'
CATEGORIES = ("SPP (Uang Kuliah)", "Biaya Operasional", "Gaji Dosen & Staff", "Penelitian & Pengabdian",
              "Beasiswa Mahasiswa", "Pemeliharaan Gedung", "Peralatan & Laboratorium",
              "Dana Kegiatan Mahasiswa")
MONTHS = ("Januari", "Februari", "Maret", "April", "Mei", "Juni")
# (substring of the category, income range or None for zero, expense range or None for zero);
# the first matching row wins, the last row is the default.
AMOUNT_RULES = (
    ("SPP", (150_000_000, 200_000_000), None),
    ("Gaji", None, (80_000_000, 120_000_000)),
    ("Beasiswa", (10_000_000, 20_000_000), (15_000_000, 25_000_000)),
    ("Penelitian", (20_000_000, 40_000_000), (15_000_000, 35_000_000)),
    (None, (0, 10_000_000), (10_000_000, 50_000_000)),
)


def weighted_score(mid: Column, final: Column, task: Column, weights=SCORE_WEIGHTS) -> Column:
    """Weighted sum in floating point, truncated to an integer."""
    a, b, c = (F.lit(float(w)) for w in weights)
    return (a * mid + b * final + c * task).cast("bigint")


def gpa_band(score: Column, u: Column) -> Column:
    """GPA drawn in the band of the score, two decimals."""
    expr = None
    for lo_score, lo, hi in GPA_BANDS:
        val = rand_real2(u, lo, hi)
        if lo_score is None:
            expr = expr.otherwise(val) if expr is not None else val
        else:
            expr = F.when(score >= lo_score, val) if expr is None else expr.when(score >= lo_score, val)
    return expr


def students(ids: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """S5 driven by an id column: NIM, name, semester, three scores, final score, GPA, status."""
    i = F.col(id_col)
    u = lambda tag: uniform01(i, tag, seed)
    mid = rand_int(u("mid"), *MID_RANGE)
    fin = rand_int(u("final"), *FINAL_RANGE)
    task = rand_int(u("task"), *TASK_RANGE)
    base = ids.select(
        i.alias("_id"),
        F.format_string("210%04d", i.cast("bigint")).alias("NIM"),
        F.concat_ws(" ", pick(u("first"), FIRST_NAMES), pick(u("last"), LAST_NAMES)).alias("Nama Mahasiswa"),
        pick(u("semester"), SEMESTERS).cast("bigint").alias("Semester"),
        mid.alias("Nilai UTS"), fin.alias("Nilai UAS"), task.alias("Nilai Tugas"),
        F.when(u("status") > ACTIVE_SHARE_CUT, F.lit("Aktif")).otherwise(F.lit("Cuti")).alias("Status"))
    score = weighted_score(F.col("`Nilai UTS`"), F.col("`Nilai UAS`"), F.col("`Nilai Tugas`"))
    return base.select(
        "NIM", "`Nama Mahasiswa`", "Semester", "`Nilai UTS`", "`Nilai UAS`", "`Nilai Tugas`",
        score.alias("Nilai Akhir"),
        gpa_band(score, uniform01(F.col("_id"), "gpa", seed)).alias("IPK"),
        "Status")


def synth_students(spark: SparkSession, n: int = 30, seed: int = 42) -> DataFrame:
    """Ids 1..n."""
    return students(spark.range(1, n + 1), "id", seed)


def _amount(u: Column, rng) -> Column:
    return F.lit(0).cast("bigint") if rng is None else rand_int(u, *rng)


def category_amounts(category: Column, u_in: Column, u_out: Column) -> tuple[Column, Column]:
    """Income and expense drawn from the range picked by a substring of the category."""
    income = expense = None
    for needle, r_in, r_out in AMOUNT_RULES:
        a, b = _amount(u_in, r_in), _amount(u_out, r_out)
        if needle is None:
            income, expense = income.otherwise(a), expense.otherwise(b)
        elif income is None:
            income, expense = F.when(category.contains(needle), a), F.when(category.contains(needle), b)
        else:
            income, expense = income.when(category.contains(needle), a), expense.when(category.contains(needle), b)
    return income, expense


def finance_lines(ids: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """S6 driven by an id column: id → (month, category) by id div/mod, amounts, balance."""
    i = F.col(id_col).cast("bigint")
    n_cat = len(CATEGORIES)
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod(i, F.lit(n_cat)) + 1).cast("int"))
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]),
                         (F.pmod(F.floor(i / n_cat), F.lit(len(MONTHS))) + 1).cast("int"))
    income, expense = category_amounts(cat, uniform01(i, "income", seed), uniform01(i, "expense", seed))
    return ids.select(month.alias("Bulan"), cat.alias("Kategori"),
                      income.alias("Pemasukan (Rp)"), expense.alias("Pengeluaran (Rp)")) \
        .withColumn("Saldo (Rp)", F.col("`Pemasukan (Rp)`") - F.col("`Pengeluaran (Rp)`"))


def synth_finance(spark: SparkSession, seed: int = 42) -> DataFrame:
    """6 months × 8 categories = 48 rows."""
    return finance_lines(spark.range(len(MONTHS) * len(CATEGORIES)), "id", seed)


def balance(income: Column, expense: Column) -> Column:
    """Income minus expense."""
    return income - expense
