"""Registered queries: each runs library operators on the driver tables, and each has an
independent DuckDB formulation (``ORACLES``) written directly in SQL.

Computed floating columns are rounded to 4 places on both sides (summation order
differs between engines); counts are BIGINT on both sides.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as CL
from ..operators import clean as C
from ..operators import profile as P
from ..operators import render as R
from ..operators import reports as RP
from ..operators import schema as S
from ..operators import synth as Y
from ..operators import validate as V
from . import inputs as I
from .text_oracles import TEXT_ORACLES

REPORT_TS = dt.datetime(2025, 1, 15, 10, 30, 0)
SEED = 42

# Table columns the oracles are written against (driver schema).
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
}
TEXT = {
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "part": ["p_name", "p_brand", "p_type"],
    "customer": ["c_name", "c_mktsegment"],
    "documents": ["text", "lang", "source"],
}


def _pos(table: str, col: str) -> int:
    return COLUMNS[table].index(col) + 1


def _r4(c):
    return F.round(c, 4)


def _union(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _sql_union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- profiles

def q_numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = []
    for t, df in (("lineitem", I.run(spark, sf, I.LINEITEM_GAPS)), ("part", I.load(spark, sf, "part"))):
        prof = P.profile_numeric(df)
        out.append(prof.select(F.lit(t).alias("dataset"), "position", "column_name", "row_count",
                               *[_r4(F.col(c)).alias(c) for c in ("mean", "median", "min", "max", "std")],
                               "missing"))
    return _union(out)


def _o_numeric(t: str, c: str, group: str | None = None, src: str | None = None) -> str:
    x = f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
    g_sel = f"{group}, " if group else ""
    g_by = f" GROUP BY {group}" if group else ""
    ds = "" if group else f"'{t}' AS dataset, "
    return (f"SELECT {ds}{g_sel}{_pos(t, c)} AS position, '{c}' AS column_name, count(*) AS row_count, "
            f"round(avg({x}), 4) AS mean, round(median({x}), 4) AS median, round(min({x}), 4) AS \"min\", "
            f"round(max({x}), 4) AS \"max\", round(stddev_samp({x}), 4) AS std, "
            f"count(*) - count({x}) AS missing FROM {src or t}{g_by}")


_O_GAPS = f"({I.duck(I.LINEITEM_GAPS)}) gaps"
O_NUMERIC_PROFILE = _sql_union([_o_numeric("lineitem", c, src=_O_GAPS) for c in NUMERIC["lineitem"]]
                               + [_o_numeric("part", c) for c in NUMERIC["part"]])


def q_numeric_profile_grouped(spark: SparkSession, sf: str) -> DataFrame:
    prof = P.profile_numeric(I.run(spark, sf, I.LINEITEM_GAPS), keys=["l_returnflag"])
    return prof.select("l_returnflag", "position", "column_name", "row_count",
                       *[_r4(F.col(c)).alias(c) for c in ("mean", "median", "min", "max", "std")], "missing")


O_NUMERIC_PROFILE_GROUPED = _sql_union([_o_numeric("lineitem", c, "l_returnflag", _O_GAPS) for c in NUMERIC["lineitem"]])

CATEGORICAL_TABLES = ("orders", "lineitem", "events", "part", "customer", "documents")


def q_categorical_profile(spark: SparkSession, sf: str) -> DataFrame:
    tables = {t: I.load(spark, sf, t) for t in CATEGORICAL_TABLES} | {"lineitem": I.run(spark, sf, I.LINEITEM_GAPS)}
    return P.profile_categorical_tables(tables)


def _o_top(t: str, c: str, what: str) -> str:
    counts = f"SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
    if what == "value":
        return f"(SELECT v FROM ({counts}) q ORDER BY n DESC, v ASC LIMIT 1)"
    return f"coalesce((SELECT max(n) FROM ({counts}) q), 0)"


def _o_categorical(t: str, c: str) -> str:
    table, t = t, _O_GAPS if t == "lineitem" else t
    return (f"SELECT '{table}' AS dataset, {_pos(table, c)} AS position, '{c}' AS column_name, "
            f"count(DISTINCT {c}) AS unique_values, {_o_top(t, c, 'value')} AS most_common, "
            f"{_o_top(t, c, 'count')} AS most_common_count, count(*) - count({c}) AS missing FROM {t}")


O_CATEGORICAL_PROFILE = _sql_union([_o_categorical(t, c) for t in CATEGORICAL_TABLES for c in TEXT[t]])


def q_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.value_counts(I.load(spark, sf, "events"))


O_VALUE_COUNTS = _sql_union([
    f"SELECT {_pos('events', c)} AS position, '{c}' AS column_name, {c} AS value, count(*) AS n "
    f"FROM events WHERE {c} IS NOT NULL GROUP BY {c}" for c in TEXT["events"]])


def q_missing_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return P.missing_counts(I.run(spark, sf, I.ORDERS_MISSING))


_OM_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
O_MISSING_BY_COLUMN = _sql_union([
    f"SELECT {i + 1} AS position, '{c}' AS column_name, count(*) - count({c}) AS missing "
    f"FROM ({I.duck(I.ORDERS_MISSING)}) om" for i, c in enumerate(_OM_COLS)])


def q_dataset_overview(spark: SparkSession, sf: str) -> DataFrame:
    return _union([P.dataset_profile(I.load(spark, sf, t), t).select(
        F.col("dataset_id").alias("dataset"), "row_count", "column_count",
        F.array_join("columns", ", ").alias("columns")) for t in I.TABLES])


O_DATASET_OVERVIEW = _sql_union([
    f"SELECT '{t}' AS dataset, count(*) AS row_count, {len(COLUMNS[t])} AS column_count, "
    f"'{', '.join(COLUMNS[t])}' AS columns FROM {t}" for t in I.TABLES])


# ---------------------------------------------------------------- header names

def q_detect_type(spark: SparkSession, sf: str) -> DataFrame:
    return S.detect_types(I.run(spark, sf, I.HEADERS))


def _o_any(col: str, words) -> str:
    return "(" + " OR ".join(f"lower({col}) LIKE '%{w}%'" for w in words) + ")"


O_DETECT_TYPES_SQL = (
    f"SELECT dataset_id, CASE WHEN bool_or({_o_any('column_name', S.STUDENT_KEYWORDS)}) THEN 'student' "
    f"WHEN bool_or({_o_any('column_name', S.FINANCE_KEYWORDS)}) THEN 'finance' ELSE 'unknown' END "
    f"AS detected_type FROM ({I.duck(I.HEADERS)}) h GROUP BY dataset_id")
O_DETECT_TYPE = O_DETECT_TYPES_SQL


def q_exclude_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    headers = I.run(spark, sf, I.HEADERS)
    return S.exclude_identifiers(headers, S.detect_types(headers)).select("dataset_id", "position", "column_name")


O_EXCLUDE_IDENTIFIERS = (
    f"SELECT h.dataset_id, h.position, h.column_name FROM ({I.duck(I.HEADERS)}) h "
    f"JOIN ({O_DETECT_TYPES_SQL}) t ON h.dataset_id = t.dataset_id "
    f"WHERE h.is_numeric AND NOT (t.detected_type = 'student' AND {_o_any('h.column_name', S.IDENTIFIER_KEYWORDS)})")


# ---------------------------------------------------------------- cleaning

def q_dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    return C.dedup(I.run(spark, sf, I.ORDERS_WITH_COPIES))


O_DEDUP_ROWS = f"SELECT DISTINCT * FROM ({I.duck(I.ORDERS_WITH_COPIES)}) x"


def q_duplicates_removed(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicates_removed(I.run(spark, sf, I.ORDERS_WITH_COPIES))


O_DUPLICATES_REMOVED = (
    f"SELECT rows_in, rows_out, rows_in - rows_out AS duplicates_removed FROM "
    f"(SELECT (SELECT count(*) FROM ({I.duck(I.ORDERS_WITH_COPIES)}) a) AS rows_in, "
    f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({I.duck(I.ORDERS_WITH_COPIES)}) b) c) AS rows_out) s")


def q_drop_empty_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_empty_columns(I.run(spark, sf, I.ORDERS_WITH_EMPTY))


O_DROP_EMPTY_COLUMNS = (f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
                        f"FROM ({I.duck(I.ORDERS_WITH_EMPTY)}) x")


def q_coerce_comma_decimals(spark: SparkSession, sf: str) -> DataFrame:
    return C.coerce_numbers(I.run(spark, sf, I.ORDERS_AS_TEXT))


O_COERCE_COMMA_DECIMALS = (
    f"SELECT o_orderkey, CAST(replace(price_text, ',', '.') AS DOUBLE) AS price_text, "
    f"CAST(trim(cust_text) AS BIGINT) AS cust_text, replace(mixed_text, ',', '.') AS mixed_text, "
    f"CAST(nullif(key_text, '') AS DOUBLE) AS key_text, long_text, o_orderdate, o_orderstatus "
    f"FROM ({I.duck(I.ORDERS_AS_TEXT)}) x")


def q_fill_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = C.fill_mean(I.run(spark, sf, I.ORDERS_MISSING))
    return out.withColumn("o_totalprice", _r4(F.col("o_totalprice")))


O_FILL_MEAN = (
    f"SELECT o_orderkey, o_custkey, o_orderstatus, "
    f"round(coalesce(o_totalprice, avg(o_totalprice) OVER ()), 4) AS o_totalprice, o_orderdate, o_orderpriority "
    f"FROM ({I.duck(I.ORDERS_MISSING)}) om")


def q_fill_mode(spark: SparkSession, sf: str) -> DataFrame:
    return C.fill_mode(I.run(spark, sf, I.ORDERS_MISSING))


def _o_mode(src: str, c: str) -> str:
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}) q "
            f"ORDER BY n DESC, v ASC LIMIT 1)")


O_FILL_MODE = (
    f"WITH om AS ({I.duck(I.ORDERS_MISSING)}) "
    f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
    f"coalesce(o_orderpriority, {_o_mode('om', 'o_orderpriority')}) AS o_orderpriority FROM om")


def q_clean_table(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = C.clean(I.run(spark, sf, I.ORDERS_DIRTY))
    return out.select(*[_r4(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                        for f in out.schema.fields])


O_CLEAN_TABLE = (
    f"WITH d AS (SELECT DISTINCT * FROM ({I.duck(I.ORDERS_DIRTY)}) x), "
    f"c AS (SELECT o_orderkey, o_custkey, replace(o_orderstatus, ',', '.') AS o_orderstatus, o_totalprice, "
    f"replace(o_orderpriority, ',', '.') AS o_orderpriority, "
    f"CAST(replace(price_text, ',', '.') AS DOUBLE) AS price_text, CAST(trim(cust_text) AS BIGINT) AS cust_text, "
    f"replace(mixed_text, ',', '.') AS mixed_text, long_text, o_orderdate FROM d) "
    f"SELECT o_orderkey, o_custkey, o_orderstatus, "
    f"round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM c)), 4) AS o_totalprice, "
    f"coalesce(o_orderpriority, {_o_mode('c', 'o_orderpriority')}) AS o_orderpriority, "
    f"round(coalesce(price_text, (SELECT avg(price_text) FROM c)), 4) AS price_text, cust_text, "
    f"coalesce(mixed_text, {_o_mode('c', 'mixed_text')}) AS mixed_text, long_text, o_orderdate FROM c")


def q_cleaning_summary(spark: SparkSession, sf: str) -> DataFrame:
    report = C.cleaning_summary(I.run(spark, sf, I.ORDERS_DIRTY))
    return report.to_df(spark).select("rows_in", "rows_out", "duplicates_removed", "empty_columns_dropped")


_DIRTY_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_note",
               "price_text", "cust_text", "mixed_text", "long_text", "o_orderdate"]
O_CLEANING_SUMMARY = (
    f"WITH x AS ({I.duck(I.ORDERS_DIRTY)}) "
    f"SELECT rows_in, rows_out, rows_in - rows_out AS duplicates_removed, empty_columns_dropped FROM "
    f"(SELECT (SELECT count(*) FROM x) AS rows_in, "
    f"(SELECT count(*) FROM (SELECT DISTINCT * FROM x) d) AS rows_out, "
    f"(SELECT " + " + ".join(f"CAST(count({c}) = 0 AS BIGINT)" for c in _DIRTY_COLS) +
    " FROM x) AS empty_columns_dropped) s")


# ---------------------------------------------------------------- texts

def _profiled_summary(df: DataFrame, dataset_id: str) -> DataFrame:
    ds, num, cat = P.analyze(df, dataset_id)
    return R.summary_text(ds, num, cat)


def q_summary_text(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled_summary(I.load(spark, sf, "part"), "part")


def _segment_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Customer segments as datasets: one summary per segment (grouped profile)."""
    cust = I.load(spark, sf, "customer").withColumnRenamed("c_mktsegment", "dataset_id")
    return P.summaries_by_key(cust, "dataset_id")


def q_summary_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return _segment_summaries(spark, sf)


def q_prompts(spark: SparkSession, sf: str) -> DataFrame:
    req = I.run(spark, sf, I.SEGMENT_REQUESTS)
    s = _segment_summaries(spark, sf).join(req, "dataset_id")
    return s.select("dataset_id", "report_type",
                    R.prompt_expr(F.col("summary_text"), F.col("report_type")).alias("prompt"))


def q_fallback_text(spark: SparkSession, sf: str) -> DataFrame:
    s = _segment_summaries(spark, sf)
    return s.select("dataset_id", R.fallback_expr(F.col("summary_text")).alias("report_text"))


def q_generated_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    req = I.run(spark, sf, I.CONVERSATION_REQUESTS)
    gen = I.run(spark, sf, I.CONVERSATION_GENERATED)
    return R.attach_generated(req, gen).drop("summary_text")


def q_count_numbers(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.load(spark, sf, "documents")
    return docs.select("doc_id", V.number_count(F.col("text")).cast("bigint").alias("num_extracted"))


_O_NUM = r"'\d+(?:\.\d+)?'"
O_COUNT_NUMBERS = (f"SELECT doc_id, CAST(len(regexp_extract_all(text, {_O_NUM})) AS BIGINT) AS num_extracted "
                   f"FROM documents")


def _flat_validation(v: DataFrame) -> DataFrame:
    return v.select("report_id", "is_valid", F.size("issues").cast("bigint").alias("n_issues"),
                    F.array_join("issues", "\n").alias("issues"),
                    F.col("num_extracted").cast("bigint").alias("num_extracted"))


def q_validate_short_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.load(spark, sf, "documents").select(F.col("doc_id").alias("report_id"),
                                                F.col("text").alias("report_text"))
    return _flat_validation(V.validate_reports(docs))


def _o_local_issues(text: str) -> tuple[str, str]:
    short = f"CASE WHEN length({text}) < {V.MIN_CHARS} THEN '{V.MSG_TOO_SHORT.format(n=V.MIN_CHARS)}' END"
    ph = " OR ".join(f"contains(lower({text}), '{p}')" for p in V.PLACEHOLDER_PHRASES)
    placeholder = f"CASE WHEN {ph} THEN '{V.MSG_PLACEHOLDER}' END"
    return short, placeholder


def _o_validation(src: str, text: str, extra_lists: str = "") -> str:
    short, ph = _o_local_issues(text)
    lst = (f"list_filter([{short}, {ph}], lambda x: x IS NOT NULL)")
    if extra_lists:
        lst = f"list_concat({lst}, {extra_lists})"
    return (f"SELECT report_id, len(issues) = 0 AS is_valid, CAST(len(issues) AS BIGINT) AS n_issues, "
            f"array_to_string(issues, chr(10)) AS issues, num_extracted FROM "
            f"(SELECT report_id, {lst} AS issues, "
            f"CAST(len(regexp_extract_all({text}, {_O_NUM})) AS BIGINT) AS num_extracted FROM {src}) v")


O_VALIDATE_SHORT_PLACEHOLDER = _o_validation(
    "(SELECT doc_id AS report_id, text AS report_text FROM documents) d", "report_text")


def q_validate_reports(spark: SparkSession, sf: str) -> DataFrame:
    reports = I.run(spark, sf, I.CUSTOMER_REPORTS)
    v = V.validate_reports(reports, departments=I.run(spark, sf, I.DEPARTMENTS),
                           totals=I.run(spark, sf, I.TOTALS))
    return _flat_validation(v)


_O_DEPT = r"'Departemen\s+([A-Za-z]+)'"
_O_CLAIM = r"'mahasiswa\s*[=:]?\s*(\d+)'"
_O_DIGITS = f"regexp_extract(r.report_text, {_O_CLAIM}, 1)"
_O_CLAIMED = f"(CASE WHEN {_O_DIGITS} <> '' THEN coalesce(nullif(ltrim({_O_DIGITS}, '0'), ''), '0') END)"


def _o_reports_joined(reports: str) -> str:
    return (f"(SELECT r.report_id, r.report_text, k.known, t.total_students, {_O_CLAIMED} AS claimed "
            f"FROM ({I.duck(reports)}) r "
            f"LEFT JOIN (SELECT dataset_id, list(department) AS known FROM ({I.duck(I.DEPARTMENTS)}) d "
            f"GROUP BY dataset_id) k ON r.dataset_id = k.dataset_id "
            f"LEFT JOIN ({I.duck(I.TOTALS)}) t ON r.dataset_id = t.dataset_id) j")




def _o_message(message: str, *values: str) -> str:
    """A message with its gaps filled, as a SQL expression."""
    parts = ["'" + p.replace("'", "''") + "'" for p in message.split("{}")]
    return " || ".join(x for pair in zip(parts, [*values, None]) for x in pair if x)


_O_ENTITY_ISSUES = (
    f"CASE WHEN known IS NULL THEN []::VARCHAR[] ELSE list_transform(list_filter("
    f"regexp_extract_all(report_text, {_O_DEPT}, 1), lambda x: NOT list_contains(known, x)), "
    f"lambda x: {_o_message(V.MSG_UNKNOWN_DEPARTMENT, 'x')}) END")
_O_CLAIM_ISSUE = (
    "CASE WHEN claimed IS NOT NULL AND total_students IS NOT NULL AND "
    "abs(CAST(claimed AS DOUBLE) - CAST(total_students AS DOUBLE)) > "
    "greatest(1.0, 0.05 * CAST(total_students AS DOUBLE)) THEN "
    f"[{_o_message(V.MSG_CLAIM, 'claimed', 'CAST(total_students AS VARCHAR)')}] ELSE []::VARCHAR[] END")
_O_ISSUES = f"list_concat({_O_ENTITY_ISSUES}, {_O_CLAIM_ISSUE})"
O_VALIDATE_REPORTS = _o_validation(_o_reports_joined(I.CUSTOMER_REPORTS), "report_text", _O_ISSUES)


def q_validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Checks by row: ids are null or shared, every row keeps its own issues."""
    return _flat_validation(V.validate_reports(I.run(spark, sf, I.SHARED_ID_REPORTS), departments=I.run(spark, sf, I.DEPARTMENTS),
                                               totals=I.run(spark, sf, I.TOTALS)))


O_VALIDATE_ROWS = _o_validation(_o_reports_joined(I.SHARED_ID_REPORTS), "report_text", _O_ISSUES)


def q_validate_entities(spark: SparkSession, sf: str) -> DataFrame:
    return V.unknown_departments(I.run(spark, sf, I.CUSTOMER_REPORTS), I.run(spark, sf, I.DEPARTMENTS)) \
        .select("report_id", "dataset_id", F.col("occurrence").cast("bigint").alias("occurrence"), "department")


O_VALIDATE_ENTITIES = (
    f"WITH m AS (SELECT report_id, dataset_id, unnest(range(0, len(l))) AS occurrence, unnest(l) AS department "
    f"FROM (SELECT report_id, dataset_id, regexp_extract_all(report_text, {_O_DEPT}, 1) AS l "
    f"FROM ({I.duck(I.CUSTOMER_REPORTS)}) r) q), d AS ({I.duck(I.DEPARTMENTS)}) "
    f"SELECT report_id, dataset_id, occurrence, department FROM m "
    f"WHERE dataset_id IN (SELECT dataset_id FROM d) "
    f"AND NOT EXISTS (SELECT 1 FROM d WHERE d.dataset_id = m.dataset_id AND d.department = m.department)")


def q_validate_claims(spark: SparkSession, sf: str) -> DataFrame:
    return V.claim_checks(I.run(spark, sf, I.CUSTOMER_REPORTS), I.run(spark, sf, I.TOTALS))


O_VALIDATE_CLAIMS = (
    f"SELECT r.report_id, {_O_CLAIMED} AS claimed, t.total_students, "
    f"({_O_CLAIMED} IS NULL OR NOT abs(CAST({_O_CLAIMED} AS DOUBLE) - CAST(t.total_students AS DOUBLE)) > "
    f"greatest(1.0, 0.05 * CAST(t.total_students AS DOUBLE))) AS claim_ok "
    f"FROM ({I.duck(I.CUSTOMER_REPORTS)}) r JOIN ({I.duck(I.TOTALS)}) t ON r.dataset_id = t.dataset_id")


# ---------------------------------------------------------------- report documents

def _customer_documents(spark: SparkSession, sf: str) -> DataFrame:
    reports = I.run(spark, sf, I.CUSTOMER_REPORTS)
    checked = reports.withColumn("is_valid", F.size(V.local_issues(F.col("report_text"))) == 0)
    return RP.report_documents(checked, REPORT_TS)


def q_report_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _customer_documents(spark, sf)


_O_TS_FILE = REPORT_TS.strftime("%Y%m%d_%H%M%S")
_O_TS_HEAD = REPORT_TS.strftime("%Y-%m-%d %H:%M:%S")
_O_KIND = ("CASE WHEN contains(lower(report_type), 'student') THEN 'student_reports' "
           "WHEN contains(lower(report_type), 'finance') THEN 'finance_reports' ELSE '' END")
_O_FILE = f"report_type || '_{_O_TS_FILE}_' || CAST(report_id AS VARCHAR) || '.md'"
_O_DOCS = (
    f"SELECT report_id, {_O_KIND} AS report_kind, {_O_FILE} AS file_name, "
    f"CASE WHEN {_O_KIND} = '' THEN {_O_FILE} ELSE {_O_KIND} || '/' || {_O_FILE} END AS path, "
    f"'metadata/' || replace({_O_FILE}, '.md', '_metadata.json') AS metadata_file, "
    f"concat_ws(chr(10), '---', 'Generated: {_O_TS_HEAD}', 'Source: ' || source_file, "
    f"'Validation: ' || CASE WHEN length(report_text) >= {V.MIN_CHARS} AND NOT ("
    + " OR ".join(f"contains(lower(report_text), '{p}')" for p in V.PLACEHOLDER_PHRASES) +
    f") THEN '{RP.LABEL_PASS}' ELSE '{RP.LABEL_ISSUES}' END, "
    f"'Token Usage: prompt=' || coalesce(CAST(prompt_tokens AS VARCHAR), 'n/a') || ', output=' || "
    f"coalesce(CAST(output_tokens AS VARCHAR), 'n/a') || ', total=' || coalesce(CAST(total_tokens AS VARCHAR), 'n/a'), "
    f"'Generator: {RP.GENERATOR_NAME}', '---' || chr(10)) || report_text AS content "
    f"FROM ({I.duck(I.CUSTOMER_REPORTS)}) r")
O_REPORT_DOCUMENTS = _O_DOCS


def q_list_reports(spark: SparkSession, sf: str) -> DataFrame:
    docs = _customer_documents(spark, sf)
    return RP.list_reports(docs.select("report_id", "path", "report_kind"), "student_report")


O_LIST_REPORTS = f"SELECT report_id, path, report_kind FROM ({_O_DOCS}) x WHERE report_kind = 'student_reports'"


def q_reports_produced(spark: SparkSession, sf: str) -> DataFrame:
    return RP.reports_produced(_customer_documents(spark, sf))


O_REPORTS_PRODUCED = (f"SELECT report_kind, path, count(*) OVER (PARTITION BY report_kind) AS n_reports "
                      f"FROM ({_O_DOCS}) x")


def q_report_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata records (C27, S9) of all customer reports with the analysis of their nation's customers, read back from
    their JSON."""
    reports = I.run(spark, sf, I.CUSTOMER_REPORTS)
    customers = I.load(spark, sf, "customer").withColumnRenamed("c_nationkey", "dataset_id")
    analysis = P.analysis_record(*P.analyze_by_key(customers, "dataset_id"))
    meta = reports.join(analysis, "dataset_id").select("report_id", RP.metadata_json(
        F.col("source_file"), F.col("analysis"),
        V.validation_struct(F.size(V.local_issues(F.col("report_text"))) == 0, V.local_issues(F.col("report_text")),
                            V.number_count(F.col("report_text"))),
        RP.usage_struct(F.col("prompt_tokens"), F.col("output_tokens"), F.col("total_tokens")),
        F.lit(REPORT_TS), F.lit(REPORT_TS)).alias("j"))
    field = lambda path: F.get_json_object("j", f"$.{path}")
    whole = lambda path: field(path).cast("bigint")
    numbers = [_r4(field(f"analysis.statistics.{c}.{k}").cast("double")).alias(f"{c}_{k}")
               for c in ("c_acctbal", "c_custkey") for k in ("mean", "median", "min", "max", "std")]
    return meta.select("report_id", field("source_file").alias("source_file"), field("validation.is_valid").alias("is_valid"),
                       field("validation.num_extracted").alias("num_extracted"), field("token_usage.prompt_tokens").alias("prompt_tokens"),
                       field("token_usage.total_tokens").alias("total_tokens"), field("saved_at").alias("saved_at"),
                       whole("analysis.row_count").alias("row_count"), whole("analysis.column_count").alias("column_count"),
                       F.array_join(F.from_json(field("analysis.columns"), "array<string>"), ", ").alias("columns"),
                       field("analysis.detected_type").alias("detected_type"), *numbers,
                       whole("analysis.statistics.c_acctbal.missing").alias("c_acctbal_missing"),
                       *[whole(f"analysis.summary.{c}.{k}").alias(f"{c}_{k}") for c in ("c_name", "c_mktsegment") for k in ("unique_values", "most_common_count", "missing")],
                       *[field(f"analysis.summary.{c}.most_common").alias(f"{c}_most_common") for c in ("c_name", "c_mktsegment")])


def _o_nation_top(c: str) -> str:
    return (f"(SELECT c_nationkey, arg_min(v, (-n, v)) AS top, max(n) AS top_n FROM (SELECT c_nationkey, {c} AS v, count(*) AS n "
            f"FROM customer WHERE {c} IS NOT NULL GROUP BY 1, 2) q GROUP BY 1)")


_O_NATION_STATS = ", ".join(
    f"round({f}, 4) AS {c}_{k}" for c in ("c_acctbal", "c_custkey")
    for k, f in (("mean", f"avg({c})"), ("median", f"median(CAST({c} AS DOUBLE))"), ("min", f"CAST(min({c}) AS DOUBLE)"),
                 ("max", f"CAST(max({c}) AS DOUBLE)"), ("std", f"stddev_samp({c})")))
O_REPORT_METADATA = (
    f"SELECT report_id, source_file, CASE WHEN length(report_text) >= {V.MIN_CHARS} AND NOT ("
    + " OR ".join(f"contains(lower(report_text), '{p}')" for p in V.PLACEHOLDER_PHRASES) +
    f") THEN 'true' ELSE 'false' END AS is_valid, CAST(len(regexp_extract_all(report_text, {_O_NUM})) AS VARCHAR) AS num_extracted, "
    f"CAST(prompt_tokens AS VARCHAR) AS prompt_tokens, CAST(total_tokens AS VARCHAR) AS total_tokens, "
    f"'{REPORT_TS.strftime('%Y-%m-%dT%H:%M:%S.%f')}' AS saved_at, a.* EXCLUDE (c_nationkey), "
    f"n.top_n AS c_name_most_common_count, m.top_n AS c_mktsegment_most_common_count, n.top AS c_name_most_common, m.top AS c_mktsegment_most_common "
    f"FROM ({I.duck(I.CUSTOMER_REPORTS)}) r JOIN (SELECT c_nationkey, count(*) AS row_count, CAST(4 AS BIGINT) AS column_count, "
    f"'c_custkey, c_name, c_acctbal, c_mktsegment' AS columns, 'unknown' AS detected_type, {_O_NATION_STATS}, "
    f"count(*) - count(c_acctbal) AS c_acctbal_missing, "
    f"count(DISTINCT c_name) AS c_name_unique_values, count(*) - count(c_name) AS c_name_missing, "
    f"count(DISTINCT c_mktsegment) AS c_mktsegment_unique_values, count(*) - count(c_mktsegment) AS c_mktsegment_missing "
    f"FROM customer GROUP BY c_nationkey) a ON a.c_nationkey = r.dataset_id "
    f"LEFT JOIN {_o_nation_top('c_name')} n ON n.c_nationkey = r.dataset_id LEFT JOIN {_o_nation_top('c_mktsegment')} m ON m.c_nationkey = r.dataset_id")


def q_chosen_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Segment reports whose kind the caller chooses for some (a type column beside the dataset's id)."""
    from .report_job import reports_from_summaries
    summaries = _segment_summaries(spark, sf).withColumns({
        "detected_type": F.lit("unknown"), "analysis": F.lit(None).cast("struct<row_count:bigint>")})
    chosen = I.run(spark, sf, I.SEGMENT_CHOICES)
    return reports_from_summaries(summaries, ts=REPORT_TS, report_types=chosen).select(
        "report_id", "report_type", "report_kind", "path", F.col("report_text").alias("report_text"))


O_CHOSEN_REPORTS = (
    f"SELECT f.dataset_id AS report_id, t.report_type, t.report_kind, CASE WHEN t.report_kind = '' THEN '' ELSE t.report_kind || '/' END "
    f"|| t.report_type || '_{_O_TS_FILE}_' || f.dataset_id || '.md' AS path, f.report_text "
    f"FROM ({TEXT_ORACLES['fallback_text']}) f JOIN (SELECT DISTINCT c_mktsegment AS dataset_id, "
    f"CASE c_mktsegment WHEN 'BUILDING' THEN 'student_report' WHEN 'MACHINERY' THEN 'finance_report' ELSE 'general_report' END AS report_type, "
    f"CASE c_mktsegment WHEN 'BUILDING' THEN 'student_reports' WHEN 'MACHINERY' THEN 'finance_reports' ELSE '' END AS report_kind "
    f"FROM customer) t ON f.dataset_id = t.dataset_id")


# ---------------------------------------------------------------- generated tables and arithmetic

def q_balance(spark: SparkSession, sf: str) -> DataFrame:
    li = I.load(spark, sf, "lineitem")
    income = F.col("l_extendedprice")
    expense = F.col("l_extendedprice") * F.col("l_discount")
    return li.select("l_orderkey", "l_linenumber", _r4(income).alias("income"), _r4(expense).alias("expense"),
                     _r4(Y.balance(income, expense)).alias("balance"))


O_BALANCE = ("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS income, "
             "round(l_extendedprice * l_discount, 4) AS expense, "
             "round(l_extendedprice - l_extendedprice * l_discount, 4) AS balance FROM lineitem")

_SCORE_INPUTS = ("(l_quantity + 45)", "(l_partkey % 41 + 60)", "(l_suppkey % 31 + 70)")


def _score_frame(spark: SparkSession, sf: str) -> DataFrame:
    li = I.load(spark, sf, "lineitem")
    mid, fin, task = (F.expr(e) for e in _SCORE_INPUTS)
    return li.select("l_orderkey", "l_linenumber", mid.alias("mid"), fin.alias("final"), task.alias("task"),
                     Y.weighted_score(mid, fin, task).alias("score"))


def q_weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    return _score_frame(spark, sf).select("l_orderkey", "l_linenumber", "score")


_W = Y.SCORE_WEIGHTS
_O_SCORE = (f"CAST(trunc(CAST({_W[0]} AS DOUBLE) * {_SCORE_INPUTS[0]} + CAST({_W[1]} AS DOUBLE) * {_SCORE_INPUTS[1]} "
            f"+ CAST({_W[2]} AS DOUBLE) * {_SCORE_INPUTS[2]}) AS BIGINT)")
O_WEIGHTED_SCORE = f"SELECT l_orderkey, l_linenumber, {_O_SCORE} AS score FROM lineitem"


def q_banding(spark: SparkSession, sf: str) -> DataFrame:
    s = _score_frame(spark, sf).withColumn("draw_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    from ..functions.draws import uniform01
    return s.select("l_orderkey", "l_linenumber", "score",
                    Y.gpa_band(F.col("score"), uniform01(F.col("draw_id"), "gpa", SEED)).alias("gpa"))


def _o_u(id_sql: str, tag: str) -> str:
    return (f"(CAST(('0x' || substr(md5('{SEED}:{tag}:' || CAST({id_sql} AS VARCHAR)), 1, 8)) AS BIGINT) "
            f"/ CAST(4294967296 AS DOUBLE))")


def _o_real2(u: str, lo: float, hi: float) -> str:
    return f"(floor((CAST({float(lo)} AS DOUBLE) + {u} * CAST({float(hi - lo)} AS DOUBLE)) * 100 + 0.5) / 100)"


def _o_gpa(score: str, u: str) -> str:
    parts = []
    for lo_score, lo, hi in Y.GPA_BANDS:
        if lo_score is None:
            parts.append(f"ELSE {_o_real2(u, lo, hi)} END")
        else:
            parts.append(f"WHEN {score} >= {lo_score} THEN {_o_real2(u, lo, hi)}")
    return "CASE " + " ".join(parts)


O_BANDING = (f"SELECT l_orderkey, l_linenumber, score, {_o_gpa('score', _o_u('l_orderkey * 10 + l_linenumber', 'gpa'))} "
             f"AS gpa FROM (SELECT l_orderkey, l_linenumber, {_O_SCORE} AS score FROM lineitem) s")


def q_synth_students(spark: SparkSession, sf: str) -> DataFrame:
    ids = I.load(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("id"))
    return Y.students(ids, "id", SEED)


def _o_int(u: str, lo: int, hi: int) -> str:
    return f"CAST(floor({u} * {hi - lo + 1}) + {lo} AS BIGINT)"


def _o_pick(u: str, values) -> str:
    lst = "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"
    return f"({lst})[CAST(floor({u} * {len(values)}) AS BIGINT) + 1]"


def _o_students() -> str:
    u = lambda tag: _o_u("id", tag)
    mid, fin, task = _o_int(u("mid"), *Y.MID_RANGE), _o_int(u("final"), *Y.FINAL_RANGE), _o_int(u("task"), *Y.TASK_RANGE)
    score = (f"CAST(trunc(CAST({_W[0]} AS DOUBLE) * mid + CAST({_W[1]} AS DOUBLE) * fin "
             f"+ CAST({_W[2]} AS DOUBLE) * task) AS BIGINT)")
    inner = (f"SELECT id, printf('210%04d', id) AS nim, "
             f"{_o_pick(u('first'), Y.FIRST_NAMES)} || ' ' || {_o_pick(u('last'), Y.LAST_NAMES)} AS nama, "
             f"CAST({_o_pick(u('semester'), Y.SEMESTERS)} AS BIGINT) AS semester, {mid} AS mid, {fin} AS fin, "
             f"{task} AS task, CASE WHEN {u('status')} > {Y.ACTIVE_SHARE_CUT} THEN 'Aktif' ELSE 'Cuti' END AS status "
             f"FROM (SELECT c_custkey + 1 AS id FROM customer) ids")
    return (f"SELECT nim AS \"NIM\", nama AS \"Nama Mahasiswa\", semester AS \"Semester\", mid AS \"Nilai UTS\", "
            f"fin AS \"Nilai UAS\", task AS \"Nilai Tugas\", score AS \"Nilai Akhir\", "
            f"{_o_gpa('score', _o_u('id', 'gpa'))} AS \"IPK\", status AS \"Status\" "
            f"FROM (SELECT *, {score} AS score FROM ({inner}) a) b")


O_SYNTH_STUDENTS = _o_students()


def q_synth_finance(spark: SparkSession, sf: str) -> DataFrame:
    return Y.finance_lines(I.load(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", SEED)


def _o_amount(cat: str, u: str, which: int) -> str:
    parts = []
    for needle, r_in, r_out in Y.AMOUNT_RULES:
        rng = (r_in, r_out)[which]
        val = "CAST(0 AS BIGINT)" if rng is None else _o_int(u, *rng)
        parts.append(f"ELSE {val} END" if needle is None else f"WHEN contains({cat}, '{needle}') THEN {val}")
    return "CASE " + " ".join(parts)


def _o_finance() -> str:
    cats = "[" + ", ".join(f"'{c}'" for c in Y.CATEGORIES) + "]"
    months = "[" + ", ".join(f"'{m}'" for m in Y.MONTHS) + "]"
    n = len(Y.CATEGORIES)
    inner = (f"SELECT id, ({months})[(id // {n}) % {len(Y.MONTHS)} + 1] AS bulan, ({cats})[id % {n} + 1] AS kategori "
             f"FROM (SELECT o_orderkey AS id FROM orders) ids")
    return (f"SELECT bulan AS \"Bulan\", kategori AS \"Kategori\", inc AS \"Pemasukan (Rp)\", exp AS \"Pengeluaran (Rp)\", "
            f"inc - exp AS \"Saldo (Rp)\" FROM (SELECT bulan, kategori, "
            f"{_o_amount('kategori', _o_u('id', 'income'), 0)} AS inc, "
            f"{_o_amount('kategori', _o_u('id', 'expense'), 1)} AS exp FROM ({inner}) a) b")


O_SYNTH_FINANCE = _o_finance()


# ---------------------------------------------------------------- long form (many datasets)

def q_cells_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Customer segments stacked into cells and profiled in long form (no per-dataset loop)."""
    cust = I.load(spark, sf, "customer")
    cells = CL.stack_table(cust, "c_mktsegment", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    ds, num, cat, _ = CL.profile_cells(cells)
    return R.summary_text(ds, num, cat)


_CELL_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_note", "price_text", "cust_text",
              "mixed_text", "long_text", "o_orderdate"]


def _dirty_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty orders as cells: one dataset per order status."""
    return CL.stack_table(I.run(spark, sf, I.ORDERS_BLANK_ROWS), "o_orderstatus", "row_id", _CELL_COLS)


def q_cells_cleaning_summary(spark: SparkSession, sf: str) -> DataFrame:
    return CL.cleaning_summary(_dirty_cells(spark, sf))


O_CELLS_CLEANING_SUMMARY = (
    f"WITH x AS (SELECT * EXCLUDE (row_id) FROM ({I.duck(I.ORDERS_BLANK_ROWS)}) r), d AS (SELECT DISTINCT * FROM x) "
    f"SELECT a.dataset_id, a.rows_in, b.rows_out, a.rows_in - b.rows_out AS duplicates_removed, "
    f"a.empty_columns_dropped FROM (SELECT o_orderstatus AS dataset_id, count(*) AS rows_in, "
    + " + ".join(f"CAST(count({'nullif(mixed_text, ' + chr(39) + 'n/a' + chr(39) + ')' if c == 'mixed_text' else c})"
                 f" = 0 AS BIGINT)" for c in _CELL_COLS) +
    f" AS empty_columns_dropped FROM x GROUP BY o_orderstatus) a "
    f"JOIN (SELECT o_orderstatus AS dataset_id, count(*) AS rows_out FROM d GROUP BY o_orderstatus) b "
    f"ON a.dataset_id = b.dataset_id")


def q_cells_numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    num = CL.numeric_profile_cells(_dirty_cells(spark, sf))
    return num.select("dataset_id", "position", "column_name", "row_count",
                      *[_r4(F.col(c)).alias(c) for c in ("mean", "median", "min", "max", "std")], "missing")


_CELL_NUMERIC = {  # column → its value after the reader's markers and comma → dot
    "o_orderkey": "CAST(o_orderkey AS DOUBLE)",
    "o_custkey": "CAST(o_custkey AS DOUBLE)",
    "o_totalprice": "o_totalprice",
    "price_text": "CAST(replace(price_text, ',', '.') AS DOUBLE)",
    "cust_text": "CAST(trim(cust_text) AS DOUBLE)",
    "mixed_text": "CAST(replace(nullif(mixed_text, 'n/a'), ',', '.') AS DOUBLE)",
}


def _o_cells_numeric(c: str) -> str:
    expr = _CELL_NUMERIC[c]
    return (f"SELECT dataset_id, {_CELL_COLS.index(c) + 1} AS position, '{c}' AS column_name, count(*) AS row_count, "
            f"round(avg(v), 4) AS mean, round(median(coalesce(v, m)), 4) AS median, round(min(v), 4) AS \"min\", "
            f"round(max(v), 4) AS \"max\", round(stddev_samp(coalesce(v, m)), 4) AS std, "
            f"CAST(0 AS BIGINT) AS missing FROM (SELECT o_orderstatus AS dataset_id, {expr} AS v, "
            f"avg({expr}) OVER (PARTITION BY o_orderstatus) AS m FROM d) q GROUP BY dataset_id")


O_CELLS_NUMERIC_PROFILE = (f"WITH d AS (SELECT DISTINCT * EXCLUDE (row_id) FROM ({I.duck(I.ORDERS_BLANK_ROWS)}) x) "
                           + _sql_union([_o_cells_numeric(c) for c in _CELL_NUMERIC]))


def q_cells_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of the cleaned datasets; numbers as numbers, all else as text."""
    out = CL.cleaned_cells(_dirty_cells(spark, sf))
    number = F.col("cls") == "numeric"
    return out.select("dataset_id", "row_no", "position", "column_name", "cls",
                      F.when(number, _r4(F.trim("value").try_cast("double"))).alias("number"), F.when(~number, F.col("value")).alias("text_value"))


_CELL_TEXT = {"o_orderpriority": "replace(o_orderpriority, ',', '.')", "long_text": "long_text", "o_orderdate": "CAST(o_orderdate AS VARCHAR)"}


def _o_cells_cleaned(c: str) -> str:
    base = f"SELECT o_orderstatus AS dataset_id, row_no, {_CELL_COLS.index(c) + 1} AS position, '{c}' AS column_name, "
    if c in _CELL_NUMERIC:
        x = _CELL_NUMERIC[c]
        return (f"{base}'numeric' AS cls, round(coalesce({x}, avg({x}) OVER (PARTITION BY o_orderstatus)), 4) AS number, "
                f"CAST(NULL AS VARCHAR) AS text_value FROM d")
    x = _CELL_TEXT[c]
    if c == "o_orderdate":  # dates are not filled: a gap has no row
        return f"{base}'date' AS cls, CAST(NULL AS DOUBLE) AS number, {x} AS text_value FROM d WHERE {x} IS NOT NULL"
    mode = (f"(SELECT o_orderstatus, arg_min(v, (-n, v)) AS top FROM (SELECT o_orderstatus, {x} AS v, count(*) AS n FROM d "
            f"WHERE {x} IS NOT NULL GROUP BY 1, 2) q GROUP BY 1)")
    return (f"SELECT d.o_orderstatus AS dataset_id, row_no, {_CELL_COLS.index(c) + 1} AS position, '{c}' AS column_name, 'text' AS cls, "
            f"CAST(NULL AS DOUBLE) AS number, coalesce({x}, m.top) AS text_value FROM d LEFT JOIN {mode} m ON m.o_orderstatus = d.o_orderstatus")


O_CELLS_CLEANED = (f"WITH d AS (SELECT CAST(min(row_id) + 1 AS BIGINT) AS row_no, * EXCLUDE (row_id) FROM ({I.duck(I.ORDERS_BLANK_ROWS)}) x GROUP BY ALL) "
                   + _sql_union([_o_cells_cleaned(c) for c in _CELL_COLS if c != "o_note"]))


# ---------------------------------------------------------------- registry

QUERIES = {
    "numeric_profile": q_numeric_profile,
    "numeric_profile_grouped": q_numeric_profile_grouped,
    "categorical_profile": q_categorical_profile,
    "value_counts": q_value_counts,
    "missing_by_column": q_missing_by_column,
    "dataset_overview": q_dataset_overview,
    "detect_type": q_detect_type,
    "exclude_identifiers": q_exclude_identifiers,
    "dedup_rows": q_dedup_rows,
    "duplicates_removed": q_duplicates_removed,
    "drop_empty_columns": q_drop_empty_columns,
    "coerce_comma_decimals": q_coerce_comma_decimals,
    "fill_mean": q_fill_mean,
    "fill_mode": q_fill_mode,
    "clean_table": q_clean_table,
    "cleaning_summary": q_cleaning_summary,
    "summary_text": q_summary_text,
    "summary_by_segment": q_summary_by_segment,
    "prompts": q_prompts,
    "fallback_text": q_fallback_text,
    "generated_or_fallback": q_generated_or_fallback,
    "count_numbers": q_count_numbers,
    "validate_short_placeholder": q_validate_short_placeholder,
    "validate_reports": q_validate_reports,
    "validate_rows": q_validate_rows,
    "validate_entities": q_validate_entities,
    "validate_claims": q_validate_claims,
    "report_documents": q_report_documents,
    "list_reports": q_list_reports,
    "reports_produced": q_reports_produced,
    "report_metadata": q_report_metadata,
    "chosen_reports": q_chosen_reports,
    "balance": q_balance,
    "weighted_score": q_weighted_score,
    "banding": q_banding,
    "synth_students": q_synth_students,
    "synth_finance": q_synth_finance,
    "cells_summary": q_cells_summary,
    "cells_cleaning_summary": q_cells_cleaning_summary,
    "cells_numeric_profile": q_cells_numeric_profile,
    "cells_cleaned": q_cells_cleaned,
}

ORACLES = {
    "numeric_profile": O_NUMERIC_PROFILE,
    "numeric_profile_grouped": O_NUMERIC_PROFILE_GROUPED,
    "categorical_profile": O_CATEGORICAL_PROFILE,
    "value_counts": O_VALUE_COUNTS,
    "missing_by_column": O_MISSING_BY_COLUMN,
    "dataset_overview": O_DATASET_OVERVIEW,
    "detect_type": O_DETECT_TYPE,
    "exclude_identifiers": O_EXCLUDE_IDENTIFIERS,
    "dedup_rows": O_DEDUP_ROWS,
    "duplicates_removed": O_DUPLICATES_REMOVED,
    "drop_empty_columns": O_DROP_EMPTY_COLUMNS,
    "coerce_comma_decimals": O_COERCE_COMMA_DECIMALS,
    "fill_mean": O_FILL_MEAN,
    "fill_mode": O_FILL_MODE,
    "clean_table": O_CLEAN_TABLE,
    "cleaning_summary": O_CLEANING_SUMMARY,
    "count_numbers": O_COUNT_NUMBERS,
    "validate_short_placeholder": O_VALIDATE_SHORT_PLACEHOLDER,
    "validate_reports": O_VALIDATE_REPORTS,
    "validate_rows": O_VALIDATE_ROWS,
    "validate_entities": O_VALIDATE_ENTITIES,
    "validate_claims": O_VALIDATE_CLAIMS,
    "report_documents": O_REPORT_DOCUMENTS,
    "list_reports": O_LIST_REPORTS,
    "reports_produced": O_REPORTS_PRODUCED,
    "report_metadata": O_REPORT_METADATA,
    "chosen_reports": O_CHOSEN_REPORTS,
    "balance": O_BALANCE,
    "weighted_score": O_WEIGHTED_SCORE,
    "banding": O_BANDING,
    "synth_students": O_SYNTH_STUDENTS,
    "synth_finance": O_SYNTH_FINANCE,
    "cells_cleaning_summary": O_CELLS_CLEANING_SUMMARY,
    "cells_numeric_profile": O_CELLS_NUMERIC_PROFILE,
    "cells_cleaned": O_CELLS_CLEANED,
}
ORACLES.update(TEXT_ORACLES)
