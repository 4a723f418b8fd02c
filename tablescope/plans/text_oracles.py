"""DuckDB formulations of the rendered texts (data summary, prompt, fallback, generated
report), written line by line in SQL and joined with ``string_agg ... ORDER BY``."""

from __future__ import annotations

from ..operators import render as R
from . import inputs as I


def lit(s: str) -> str:
    """SQL string literal (newlines as chr(10) so the statement stays one line per part)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(quoted) > 1 else quoted[0]


def _fmt(x: str) -> str:
    return f"coalesce(printf('%.2f', CAST({x} AS DOUBLE)), 'nan')"


def summary_sql(src: str, group: str | None, columns: list[str], numeric: list[tuple[int, str]],
                text: list[tuple[int, str]], detected: str, dataset_literal: str | None = None) -> str:
    """Lines of the data summary per dataset, then joined in order."""
    g = group or "ds"
    source = (f"(SELECT *, {lit(dataset_literal)} AS ds FROM {src} s0)" if group is None else src)
    grp = f" GROUP BY {g}"
    L = []
    L.append(f"SELECT DISTINCT {g} AS d, 0 AS sec, 0 AS pos, 0 AS sub, 'Data Overview:' AS line FROM {source} s")
    L.append(f"SELECT {g}, 0, 0, 1, '- Total records: ' || CAST(count(*) AS VARCHAR) FROM {source} s{grp}")
    L.append(f"SELECT DISTINCT {g}, 0, 0, 2, '- Total columns: {len(columns)}' FROM {source} s")
    L.append(f"SELECT DISTINCT {g}, 0, 0, 3, '- Detected type: {detected}' FROM {source} s")
    L.append(f"SELECT DISTINCT {g}, 0, 0, 4, '' FROM {source} s")
    L.append(f"SELECT DISTINCT {g}, 0, 0, 5, 'Columns:' FROM {source} s")
    for i, c in enumerate(columns):
        L.append(f"SELECT DISTINCT {g}, 1, {i + 1}, 0, {lit('- ' + c)} FROM {source} s")
    if numeric:
        L.append(f"SELECT DISTINCT {g}, 2, 0, 0, '' FROM {source} s")
        L.append(f"SELECT DISTINCT {g}, 2, 0, 1, 'Numerical Statistics:' FROM {source} s")
        for p, c in numeric:
            L.append(f"SELECT DISTINCT {g}, 3, {p}, 0, '' FROM {source} s")
            L.append(f"SELECT DISTINCT {g}, 3, {p}, 1, {lit(c + ':')} FROM {source} s")
            L.append(f"SELECT {g}, 3, {p}, 2, '  - Mean: ' || {_fmt(f'avg({c})')} FROM {source} s{grp}")
            L.append(f"SELECT {g}, 3, {p}, 3, '  - Median: ' || {_fmt(f'median(CAST({c} AS DOUBLE))')} "
                     f"FROM {source} s{grp}")
            L.append(f"SELECT {g}, 3, {p}, 4, '  - Range: ' || {_fmt(f'min({c})')} || ' - ' || "
                     f"{_fmt(f'max({c})')} FROM {source} s{grp}")
            L.append(f"SELECT {g}, 3, {p}, 5, '  - Std Dev: ' || {_fmt(f'stddev_samp(CAST({c} AS DOUBLE))')} "
                     f"FROM {source} s{grp}")
    if text:
        L.append(f"SELECT DISTINCT {g}, 4, 0, 0, '' FROM {source} s")
        L.append(f"SELECT DISTINCT {g}, 4, 0, 1, 'Categorical Data:' FROM {source} s")
        for p, c in text:
            L.append(f"SELECT DISTINCT {g}, 5, {p}, 0, '' FROM {source} s")
            L.append(f"SELECT DISTINCT {g}, 5, {p}, 1, {lit(c + ':')} FROM {source} s")
            L.append(f"SELECT {g}, 5, {p}, 2, '  - Unique values: ' || CAST(count(DISTINCT {c}) AS VARCHAR) "
                     f"FROM {source} s{grp}")
            top = (f"SELECT {g} AS tg, v, n, row_number() OVER (PARTITION BY {g} ORDER BY n DESC, v ASC) AS rn "
                   f"FROM (SELECT {g}, {c} AS v, count(*) AS n FROM {source} s WHERE {c} IS NOT NULL "
                   f"GROUP BY {g}, {c}) q")
            L.append(f"SELECT tg, 5, {p}, 3, '  - Most common: ' || v || ' (' || CAST(n AS VARCHAR) || ' times)' "
                     f"FROM ({top}) t WHERE rn = 1 AND v <> ''")
    lines = "\nUNION ALL\n".join(L)
    return (f"SELECT d AS dataset_id, string_agg(line, chr(10) ORDER BY sec, pos, sub) AS summary_text "
            f"FROM ({lines}) l GROUP BY d")


PART_SUMMARY = summary_sql(
    "part", None, ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    [(1, "p_partkey"), (5, "p_size"), (6, "p_retailprice")], [(2, "p_name"), (3, "p_brand"), (4, "p_type")],
    "unknown", dataset_literal="part")

SEGMENT_SUMMARY = summary_sql(
    "customer", "c_mktsegment", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"],
    [(1, "c_custkey"), (3, "c_nationkey"), (4, "c_acctbal")], [(2, "c_name")], "unknown")


def prompt_sql(summary: str, report_type: str) -> str:
    specs = " ".join(f"WHEN {report_type} = {lit(k)} THEN {lit(v)}" for k, v in R.PROMPT_SPECS.items())
    return (f"{lit(R.PROMPT_BASE)} || CASE {specs} ELSE {lit(R.PROMPT_SPEC_GENERAL)} END || "
            f"{lit(R.PROMPT_STYLE)} || {lit(R.PROMPT_DATA_HEADING)} || {summary} || "
            f"{lit(chr(10) + chr(10) + R.PROMPT_CLOSING)}")


def fallback_sql(summary: str) -> str:
    return (f"{lit(R.FALLBACK_HEADING + R.FALLBACK_LEAD)} || {summary} || "
            f"{lit(chr(10) + chr(10) + R.FALLBACK_NOTE)}")


O_SUMMARY_TEXT = PART_SUMMARY
O_SUMMARY_BY_SEGMENT = SEGMENT_SUMMARY
O_PROMPTS = (f"SELECT s.dataset_id, r.report_type, {prompt_sql('s.summary_text', 'r.report_type')} AS prompt "
             f"FROM ({SEGMENT_SUMMARY}) s JOIN ({I.duck(I.SEGMENT_REQUESTS)}) r ON s.dataset_id = r.dataset_id")
O_FALLBACK_TEXT = f"SELECT dataset_id, {fallback_sql('summary_text')} AS report_text FROM ({SEGMENT_SUMMARY}) s"


def _py(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


_USAGE = (f"{lit(R.USAGE_HEADING + chr(10))} || CASE WHEN g.prompt_tokens IS NULL THEN {lit(R.USAGE_MISSING)} "
          f"ELSE '- Prompt tokens: **' || {_py('g.prompt_tokens')} || '**' || chr(10) || "
          f"'- Output tokens: **' || {_py('g.output_tokens')} || '**' || chr(10) || "
          f"'- Total tokens: **' || {_py('g.total_tokens')} || '**' END")
O_GENERATED_OR_FALLBACK = (
    f"SELECT r.dataset_id, CASE WHEN g.text IS NOT NULL THEN g.text || {lit(R.USAGE_SEPARATOR)} || {_USAGE} "
    f"ELSE {fallback_sql('r.summary_text')} END AS report_text, g.text IS NOT NULL AS generated, "
    f"CAST(length(g.text) AS BIGINT) AS n_chars, "
    f"CAST(CASE WHEN g.text IS NOT NULL THEN g.prompt_tokens END AS BIGINT) AS prompt_tokens, "
    f"CAST(CASE WHEN g.text IS NOT NULL THEN g.output_tokens END AS BIGINT) AS output_tokens, "
    f"CAST(CASE WHEN g.text IS NOT NULL THEN g.total_tokens END AS BIGINT) AS total_tokens "
    f"FROM ({I.duck(I.CONVERSATION_REQUESTS)}) r LEFT JOIN ({I.duck(I.CONVERSATION_GENERATED)}) g "
    f"ON r.dataset_id = g.dataset_id")

TEXT_ORACLES = {
    "summary_text": O_SUMMARY_TEXT,
    "summary_by_segment": O_SUMMARY_BY_SEGMENT,
    "cells_summary": O_SUMMARY_BY_SEGMENT,
    "prompts": O_PROMPTS,
    "fallback_text": O_FALLBACK_TEXT,
    "generated_or_fallback": O_GENERATED_OR_FALLBACK,
}
