"""Profile → text: data summary (C9), prompt (C20/J5), fallback report (C21),
token-usage section (C17), and generated text with fallback (J4/C18/C19/C28).

Every text is built per dataset from the long profile tables: each line is a row
(dataset, ordering key, line) and the lines are joined in key order within the dataset.
A dataset has a header's worth of lines, so each group is bounded by the column count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed2

# Report wording (Indonesian), kept byte-for-byte.
PROMPT_BASE = (
    "Anda adalah analis institusi universitas yang sangat berpengalaman. "
    "Tugas Anda adalah menyusun laporan analitis yang terstruktur, informatif, dan formal "
    "berdasarkan data yang diberikan di bawah ini. "
    "Gunakan hanya informasi yang tersedia dalam data — jangan membuat asumsi atau menambahkan data eksternal.\n\n"
)
PROMPT_SPECS = {
    "student_performance": (
        "Tulis laporan performa mahasiswa dengan format berikut:\n"
        "1. RINGKASAN EKSEKUTIF — ringkas temuan utama (jumlah mahasiswa, tren nilai, status aktif, dsb.)\n"
        "2. ANALISIS PERFORMA — bahas analisis nilai (rata-rata, tren, variasi), IPK, dan kategori status\n"
        "3. KESIMPULAN & REKOMENDASI — simpulkan temuan dan berikan saran kebijakan atau tindakan\n\n"
    ),
    "financial_analysis": (
        "Tulis laporan keuangan institusi dengan format berikut:\n"
        "1. TINJAUAN KEUANGAN — gambaran umum kondisi keuangan\n"
        "2. ANALISIS DETAIL — bahas pendapatan, pengeluaran, rasio penting, serta tren utama\n"
        "3. KESIMPULAN & SARAN — simpulkan dan berikan rekomendasi strategis\n\n"
    ),
}
PROMPT_SPEC_GENERAL = (
    "Tulis laporan analitis umum dengan format berikut:\n"
    "1. Ringkasan Umum\n"
    "2. Analisis Data\n"
    "3. Kesimpulan & Rekomendasi\n\n"
)
PROMPT_STYLE = (
    "Gaya penulisan:\n"
    "- Gunakan Bahasa Indonesia yang formal dan jelas.\n"
    "- Jangan hanya menyalin angka; jelaskan makna statistiknya (misalnya: tren IPK, jurusan dominan, variasi nilai).\n"
    "- Gunakan paragraf terstruktur, bukan bullet list.\n"
    "- Jika relevan, hubungkan temuan numerik dan kategorikal untuk memberikan insight.\n\n"
)
PROMPT_DATA_HEADING = "DATA YANG HARUS DIANALISIS:\n"
PROMPT_CLOSING = "Tulislah laporan naratif dalam Bahasa Indonesia sesuai struktur di atas:"
FALLBACK_HEADING = "# Laporan Universitas (Fallback)\n\n"
FALLBACK_LEAD = "Laporan ini dihasilkan berdasarkan data berikut:\n\n"
FALLBACK_NOTE = "*Catatan: AI gagal menghasilkan teks, sehingga laporan fallback digunakan.*"
USAGE_HEADING = "### 📊 Token Usage"
USAGE_MISSING = "_Token usage data tidak tersedia._"
USAGE_SEPARATOR = "\n\n---\n"


def _line(dataset_cols, section: int, pos, sub: int, text: Column) -> list[Column]:
    return [*[F.col(c) for c in dataset_cols], F.lit(section).alias("_sec"),
            F.lit(pos).cast("int").alias("_pos") if not isinstance(pos, Column) else pos.cast("int").alias("_pos"),
            F.lit(sub).alias("_sub"), text.alias("_line")]


def summary_lines(datasets: DataFrame, numeric: DataFrame, categorical: DataFrame,
                  dataset_cols=("dataset_id",)) -> DataFrame:
    """Long form of the summary: (dataset cols, _sec, _pos, _sub, _line)."""
    d = list(dataset_cols)
    ds = datasets.select(*d, "row_count", "column_count", "columns", "detected_type")
    head = ds.select(*d, F.inline(F.array(
        F.struct(F.lit(0).alias("_sub"), F.lit("Data Overview:").alias("_line")),
        F.struct(F.lit(1).alias("_sub"), F.concat(F.lit("- Total records: "), F.col("row_count").cast("string")).alias("_line")),
        F.struct(F.lit(2).alias("_sub"), F.concat(F.lit("- Total columns: "), F.col("column_count").cast("string")).alias("_line")),
        F.struct(F.lit(3).alias("_sub"), F.concat(F.lit("- Detected type: "), F.col("detected_type")).alias("_line")),
        F.struct(F.lit(4).alias("_sub"), F.lit("").alias("_line")),
        F.struct(F.lit(5).alias("_sub"), F.lit("Columns:").alias("_line")),
    ))).select(*d, F.lit(0).alias("_sec"), F.lit(0).alias("_pos"), "_sub", "_line")
    cols = ds.select(*d, F.posexplode("columns").alias("_p", "_c")).select(
        *d, F.lit(1).alias("_sec"), (F.col("_p") + 1).cast("int").alias("_pos"), F.lit(0).alias("_sub"),
        F.concat(F.lit("- "), F.col("_c")).alias("_line"))
    num = numeric.select(*d, F.lit(3).alias("_sec"), F.col("position").cast("int").alias("_pos"), F.inline(F.array(
        F.struct(F.lit(0).alias("_sub"), F.lit("").alias("_line")),
        F.struct(F.lit(1).alias("_sub"), F.concat(F.col("column_name"), F.lit(":")).alias("_line")),
        F.struct(F.lit(2).alias("_sub"), F.concat(F.lit("  - Mean: "), fixed2(F.col("mean"))).alias("_line")),
        F.struct(F.lit(3).alias("_sub"), F.concat(F.lit("  - Median: "), fixed2(F.col("median"))).alias("_line")),
        F.struct(F.lit(4).alias("_sub"), F.concat(F.lit("  - Range: "), fixed2(F.col("min")), F.lit(" - "),
                                                   fixed2(F.col("max"))).alias("_line")),
        F.struct(F.lit(5).alias("_sub"), F.concat(F.lit("  - Std Dev: "), fixed2(F.col("std"))).alias("_line")),
    )))
    # A section heading appears only when its section has at least one column.
    num_head = numeric.groupBy(*d).agg(F.count(F.lit(1)).alias("_k")).select(
        *d, F.lit(2).alias("_sec"), F.lit(0).alias("_pos"), F.inline(F.array(
            F.struct(F.lit(0).alias("_sub"), F.lit("").alias("_line")),
            F.struct(F.lit(1).alias("_sub"), F.lit("Numerical Statistics:").alias("_line")))))
    most = F.concat(F.lit("  - Most common: "), F.col("most_common"), F.lit(" ("),
                    F.col("most_common_count").cast("string"), F.lit(" times)"))
    cat = categorical.select(*d, F.lit(5).alias("_sec"), F.col("position").cast("int").alias("_pos"), F.inline(F.array(
        F.struct(F.lit(0).alias("_sub"), F.lit("").alias("_line")),
        F.struct(F.lit(1).alias("_sub"), F.concat(F.col("column_name"), F.lit(":")).alias("_line")),
        F.struct(F.lit(2).alias("_sub"), F.concat(F.lit("  - Unique values: "),
                                                   F.col("unique_values").cast("string")).alias("_line")),
        F.struct(F.lit(3).alias("_sub"), F.when(F.col("most_common").isNotNull() & (F.col("most_common") != ""),
                                                 most).alias("_line")),
    ))).where(F.col("_line").isNotNull())
    cat_head = categorical.groupBy(*d).agg(F.count(F.lit(1)).alias("_k")).select(
        *d, F.lit(4).alias("_sec"), F.lit(0).alias("_pos"), F.inline(F.array(
            F.struct(F.lit(0).alias("_sub"), F.lit("").alias("_line")),
            F.struct(F.lit(1).alias("_sub"), F.lit("Categorical Data:").alias("_line")))))
    cols_order = [*d, "_sec", "_pos", "_sub", "_line"]
    return (head.select(*cols_order).unionByName(cols.select(*cols_order))
            .unionByName(num_head.select(*cols_order)).unionByName(num.select(*cols_order))
            .unionByName(cat_head.select(*cols_order)).unionByName(cat.select(*cols_order)))


def join_lines(lines: DataFrame, dataset_cols=("dataset_id",), out: str = "summary_text") -> DataFrame:
    """Lines → one text per dataset, in (_sec, _pos, _sub) order."""
    d = list(dataset_cols)
    ordered = F.sort_array(F.collect_list(F.struct("_sec", "_pos", "_sub", "_line")))
    return lines.groupBy(*d).agg(F.array_join(F.transform(ordered, lambda s: s["_line"]), "\n").alias(out))


def summary_text(datasets: DataFrame, numeric: DataFrame, categorical: DataFrame,
                 dataset_cols=("dataset_id",)) -> DataFrame:
    """(dataset cols, summary_text): the data summary handed to the writer."""
    return join_lines(summary_lines(datasets, numeric, categorical, dataset_cols), dataset_cols)


def prompt_expr(summary: Column, report_type: Column) -> Column:
    """C20 + J5: template by report type; unknown types get the general block."""
    spec_map = F.create_map(*[x for k, v in PROMPT_SPECS.items() for x in (F.lit(k), F.lit(v))])
    spec = F.coalesce(F.try_element_at(spec_map, report_type), F.lit(PROMPT_SPEC_GENERAL))
    return F.concat(F.lit(PROMPT_BASE), spec, F.lit(PROMPT_STYLE), F.lit(PROMPT_DATA_HEADING), summary,
                    F.lit("\n\n" + PROMPT_CLOSING))


def fallback_expr(summary: Column) -> Column:
    """C21."""
    return F.concat(F.lit(FALLBACK_HEADING + FALLBACK_LEAD), summary, F.lit("\n\n" + FALLBACK_NOTE))


def _py_str(c: Column) -> Column:
    """A nullable count printed the way Python prints it inside text (None when missing)."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def usage_section_expr(prompt_tokens: Column, output_tokens: Column, total_tokens: Column) -> Column:
    """C17: heading plus three counts, or a not-available line when prompt tokens are missing."""
    counts = F.concat(F.lit("- Prompt tokens: **"), _py_str(prompt_tokens), F.lit("**\n- Output tokens: **"),
                      _py_str(output_tokens), F.lit("**\n- Total tokens: **"), _py_str(total_tokens), F.lit("**"))
    return F.concat(F.lit(USAGE_HEADING + "\n"),
                    F.when(prompt_tokens.isNull(), F.lit(USAGE_MISSING)).otherwise(counts))


def attach_generated(requests: DataFrame, generated: DataFrame, key_cols=("dataset_id",),
                     summary_col: str = "summary_text") -> DataFrame:
    """Left join generated text (at most one row per key) onto the requests.

    Generated rows get the usage section appended (C19); missing ones get the fallback
    text and null usage. Output adds report_text, generated, n_chars and the token counts.
    """
    k = list(key_cols)
    g = generated.select(*k, F.col("text").alias("_gen_text"),
                         F.col("prompt_tokens").cast("bigint").alias("_pt"),
                         F.col("output_tokens").cast("bigint").alias("_ot"),
                         F.col("total_tokens").cast("bigint").alias("_tt"))
    j = requests.join(g, k, "left")
    has = F.col("_gen_text").isNotNull()
    return j.select(
        *requests.columns,
        F.when(has, F.concat(F.col("_gen_text"), F.lit(USAGE_SEPARATOR),
                             usage_section_expr(F.col("_pt"), F.col("_ot"), F.col("_tt"))))
        .otherwise(fallback_expr(F.col(summary_col))).alias("report_text"),
        has.alias("generated"),
        F.length("_gen_text").cast("bigint").alias("n_chars"),
        F.when(has, F.col("_pt")).alias("prompt_tokens"),
        F.when(has, F.col("_ot")).alias("output_tokens"),
        F.when(has, F.col("_tt")).alias("total_tokens"),
    )
