"""Derived inputs for the catalog queries, as SQL text both Spark and DuckDB run unchanged.

Placeholders ``{orders}`` etc. name the base tables: Spark binds them to DataFrames
(``spark.sql(text, orders=df)``), the DuckDB oracle to its pre-registered views. Every input
reads whole tables; ``%`` tests only decide which cells are blanked or copied.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Orders with gaps: every 7th price and every 5th priority missing.
ORDERS_MISSING = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {orders}
"""

# Orders plus an exact copy of every 10th order.
ORDERS_WITH_COPIES = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders}
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders}
WHERE o_orderkey % 10 = 0
"""

# Orders with gaps and two columns that hold nothing.
ORDERS_WITH_EMPTY = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CAST(NULL AS STRING) AS o_note, o_orderdate,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CAST(NULL AS DOUBLE) AS o_rebate
FROM {orders}
"""

# Numbers written as text: decimal commas, padded integers, a column with a non-number
# marker, a column with blanks, a column with a whole number beyond 64 bits (it stays text).
ORDERS_AS_TEXT = """
SELECT o_orderkey,
       replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',') AS price_text,
       concat(' ', CAST(o_custkey AS STRING), ' ') AS cust_text,
       CASE WHEN o_orderkey % 13 = 0 THEN 'n/a'
            ELSE replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',') END AS mixed_text,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS key_text,
       CASE WHEN o_orderkey % 17 = 0 THEN '99999999999999999999' ELSE CAST(o_custkey AS STRING) END AS long_text,
       o_orderdate, o_orderstatus
FROM {orders}
"""

# Everything at once: copies, gaps, an empty column, comma decimals, a text column with gaps.
# ``row_id`` tells an order from its copy (for the long form, which needs a row number).
ORDERS_DIRTY_ROWS = """
SELECT o_orderkey * 2 + copy_no AS row_id, o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CAST(NULL AS STRING) AS o_note,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL
            ELSE replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',') END AS price_text,
       concat(' ', CAST(o_custkey AS STRING), ' ') AS cust_text,
       CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN NULL
            ELSE replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',') END AS mixed_text,
       CASE WHEN o_orderkey % 17 = 0 THEN '99999999999999999999' ELSE CAST(o_custkey AS STRING) END AS long_text,
       o_orderdate
FROM (SELECT *, 0 AS copy_no FROM {orders}
      UNION ALL SELECT *, 1 AS copy_no FROM {orders} WHERE o_orderkey % 10 = 0) o
"""

# Line items with gaps in numbers and text (missing and NaN), for the profiles.
LINEITEM_GAPS = """
SELECT l_orderkey, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey END AS l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_orderkey % 8 = 0 THEN NULL WHEN l_orderkey % 8 = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS l_quantity,
       l_extendedprice, l_discount, l_tax,
       CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus, l_shipdate
FROM {lineitem}
"""

# Order rows as cells with gaps; every 23rd row has no cell at all.
ORDERS_BLANK_ROWS = """
SELECT row_id, o_orderstatus,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_note,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE price_text END AS price_text,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE cust_text END AS cust_text,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE mixed_text END AS mixed_text,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE long_text END AS long_text,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate
FROM (""" + ORDERS_DIRTY_ROWS + """) r
"""

ORDERS_DIRTY = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_note, "
                "price_text, cust_text, mixed_text, long_text, o_orderdate FROM (" + ORDERS_DIRTY_ROWS + ") r")

# Header rows of many small datasets: one dataset per order, one header per line item,
# named after a word picked by the part's type and the part's name.
HEADERS = """
SELECT l.l_orderkey AS dataset_id, l.l_linenumber AS position,
       concat(CASE p.p_type WHEN 'STANDARD' THEN 'Nilai' WHEN 'PROMO' THEN 'Biaya'
                            WHEN 'SMALL' THEN 'Kode' WHEN 'MEDIUM' THEN 'IPK'
                            WHEN 'LARGE' THEN 'Revenue' ELSE 'Bulan' END, ' ', p.p_name) AS column_name,
       l.l_quantity > 25 AS is_numeric
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""

# One report text per customer; its dataset is the customer's nation.
CUSTOMER_REPORTS = """
SELECT c.c_custkey AS report_id, c.c_nationkey AS dataset_id,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'student_report' WHEN 'MACHINERY' THEN 'finance_report'
            ELSE 'general_report' END AS report_type,
       concat('Ringkasan ', c.c_name, '. Departemen ', c.c_mktsegment, ' mencatat ',
              CAST(coalesce(n.n_orders, 0) AS STRING), ' pesanan, sedangkan Departemen ',
              CASE WHEN c.c_acctbal < 0 THEN 'Keuangan' ELSE 'Akademik' END,
              ' stabil. Total mahasiswa = ',
              CASE WHEN c.c_custkey % 11 = 0 THEN '0099999999999999999999' ELSE CAST(coalesce(n.n_orders, 0) AS STRING) END, '.',
              CASE WHEN c.c_custkey % 9 = 0 THEN ' Data terbatas untuk periode ini.' ELSE '' END,
              CASE WHEN c.c_custkey % 4 = 0 THEN '' ELSE repeat(' Analisis lanjutan tersedia.', 8) END
       ) AS report_text,
       concat('data/nation_', CAST(c.c_nationkey AS STRING), '.xlsx') AS source_file,
       CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE c.c_custkey + 100 END AS prompt_tokens,
       CASE WHEN c.c_custkey % 3 = 0 OR c.c_custkey % 5 = 0 THEN NULL ELSE coalesce(n.n_orders, 0) * 50 END
           AS output_tokens,
       CASE WHEN c.c_custkey % 3 = 0 OR c.c_custkey % 5 = 0 THEN NULL
            ELSE c.c_custkey + 100 + coalesce(n.n_orders, 0) * 50 END AS total_tokens
FROM {customer} c
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM {orders} GROUP BY o_custkey) n
       ON c.c_custkey = n.o_custkey
"""

# The same reports under ids that are null or shared by many reports.
SHARED_ID_REPORTS = ("SELECT CASE WHEN report_id % 10 = 0 THEN NULL ELSE report_id % 50 END AS report_id, dataset_id, report_text FROM ("
                     + CUSTOMER_REPORTS + ") s")

# Known department names by nation, from all customers: a customer's balance decides which of a few names
# it stands for, and every sixth nation's list is filed under a key that no report has, so that
# its reports are not checked.
DEPARTMENTS = """
SELECT DISTINCT CASE WHEN c_nationkey % 6 = 0 THEN -1 - c_nationkey ELSE c_nationkey END AS dataset_id,
       CASE WHEN c_acctbal > 9000 THEN c_mktsegment WHEN c_acctbal < 0 THEN 'Keuangan' ELSE 'Pusat' END AS department
FROM {customer}
"""

# Orders per customer, averaged per nation over all customers, as the nation's 'total'; every fourth
# nation's total is filed under a key that no report has.
TOTALS = """
SELECT CASE WHEN c.c_nationkey % 4 = 0 THEN -1 - c.c_nationkey ELSE c.c_nationkey END AS dataset_id,
       CAST(floor(CAST(sum(coalesce(n.n_orders, 0)) AS DOUBLE) / count(*)) AS BIGINT) AS total_students
FROM {customer} c
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM {orders} GROUP BY o_custkey) n ON c.c_custkey = n.o_custkey
GROUP BY c.c_nationkey
"""

# Conversations as report requests: the user turns, in order, stand for the data summary (empty without any),
# the assistant turns for the generated text (none: the fallback); token counts come from the turns.
# A conversation's text is bounded by its own turns.
CONVERSATION_REQUESTS = """
SELECT conv_id AS dataset_id,
       coalesce(string_agg(CASE WHEN role = 'user' THEN text END, '\\n') WITHIN GROUP (ORDER BY turn), '') AS summary_text
FROM {conversations}
GROUP BY conv_id
"""

CONVERSATION_GENERATED = """
SELECT conv_id AS dataset_id, text,
       CASE WHEN conv_id % 5 = 0 THEN NULL ELSE turn * 100 + 7 END AS prompt_tokens,
       CASE WHEN conv_id % 7 = 0 THEN NULL ELSE CAST(length(text) AS BIGINT) END AS output_tokens,
       CASE WHEN conv_id % 7 = 0 OR conv_id % 5 = 0 THEN NULL
            ELSE turn * 100 + 7 + CAST(length(text) AS BIGINT) END AS total_tokens
FROM (SELECT conv_id, max(turn) AS turn,
             string_agg(CASE WHEN role = 'assistant' THEN text END, '\\n') WITHIN GROUP (ORDER BY turn) AS text
      FROM {conversations} GROUP BY conv_id) a
WHERE text IS NOT NULL
"""

# Customer segments as datasets, with the report type each one asks for.
SEGMENT_REQUESTS = """
SELECT DISTINCT c_mktsegment AS dataset_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'student_performance'
                         WHEN 'MACHINERY' THEN 'financial_analysis'
                         WHEN 'AUTOMOBILE' THEN 'general' ELSE 'other' END AS report_type
FROM {customer}
"""

# The report kind a caller asks for; the other segments keep the kind of their detected type.
SEGMENT_CHOICES = """
SELECT DISTINCT c_mktsegment AS dataset_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'student' WHEN 'MACHINERY' THEN 'finance' END AS report_type
FROM {customer}
"""

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def table_names(sql: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(sql)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run an input SQL on Spark with its tables bound to the parquet files."""
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in table_names(sql)})


#: An ordered string aggregate, written as the standard has it; DuckDB takes the order inside the call.
_WITHIN = re.compile(r"string_agg\((.*?), '\\n'\) WITHIN GROUP \((ORDER BY \w+)\)")


def duck(sql: str) -> str:
    """The same SQL for the DuckDB oracle (tables are views there)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), _WITHIN.sub(r"string_agg(\1, chr(10) \2)", sql))
