"""Sinks: tables as parquet (S7), reports as text files (S8), metadata as JSON (S9),
and a file listing of written reports (S10)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path

ROOT_PARTITION = "_root"


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A generated or cleaned table, as parquet."""
    df.write.mode(mode).parquet(path)
    return path


def _kind(documents: DataFrame):
    return F.when(F.col("report_kind") == "", F.lit(ROOT_PARTITION)).otherwise(F.col("report_kind")).alias("report_kind")


def write_reports(documents: DataFrame, path: str, mode: str = "append", one_file_per_report: bool = False) -> str:
    """Reports under ``report_kind=…/`` (root-level ones under ``report_kind=_root``). Saving appends,
    so a save never removes another report.

    By default rows (report_id, file_name, path, content) in parquet: millions of reports are a
    few files. ``one_file_per_report``: a text file under ``report_id=…/`` for each.
    """
    if one_file_per_report:
        documents.select(_kind(documents), "report_id", "content").write.mode(mode) \
            .partitionBy("report_kind", "report_id").text(path)
    else:
        documents.select(_kind(documents), "report_id", "file_name", "path", "content").write.mode(mode) \
            .partitionBy("report_kind").parquet(path)
    return path


def write_metadata(records: DataFrame, path: str, mode: str = "append", one_file_per_report: bool = False) -> str:
    """One indented JSON record per report: rows (report_id, metadata_json) in parquet, or a text file
    under ``report_id=…/`` for each. Appends, as ``write_reports`` does."""
    if one_file_per_report:
        records.select("report_id", F.col("metadata_json").alias("value")).write.mode(mode) \
            .partitionBy("report_id").text(path)
    else:
        records.select("report_id", "metadata_json").write.mode(mode).parquet(path)
    return path


# ---- repeatable saves ------------------------------------------------------------------------------------------
#
# ``root/saves/<save>/try=<uuid>/{reports,metadata}`` holds the rows of one attempt, ``root/commits/<save>`` names the
# attempt that counts. A save takes effect when its marker is written, in one small write after all rows are there; an attempt
# that dies before leaves nothing a reader sees, and a save that runs again replaces its own rows only.

def save_reports(reports: DataFrame, root: str, save_id: str) -> str:
    """S8 and S9 as one save that may be repeated: report rows (as ``write_reports``) and, where ``reports`` has
    ``metadata_json``, their metadata records. Running the save of one ``save_id`` again (a retry, a replayed micro-batch)
    replaces what it saved before; saves of other ids stay. Returns the folder of the attempt."""
    spark, root, name = reports.sparkSession, root.rstrip("/"), _save_name(save_id)
    folder = f"{root}/saves/{name}/try={uuid.uuid4().hex}"
    write_reports(reports, f"{folder}/reports")
    if "metadata_json" in reports.columns:
        write_metadata(reports, f"{folder}/metadata")
    fs, marker = hadoop_path(spark, f"{root}/commits/{name}")
    out = fs.create(marker, True)
    out.write(bytearray(folder.rsplit("/", 1)[1].encode()))
    out.close()
    _, own = hadoop_path(spark, f"{root}/saves/{name}")
    for entry in fs.listStatus(own):  # attempts that no longer count
        if entry.getPath().getName() != folder.rsplit("/", 1)[1]:
            fs.delete(entry.getPath(), True)
    return folder


def _save_name(save_id: str) -> str:
    """A file name for any id; different ids have different names, whatever the file system's rules on letters."""
    return "".join(c if c.isascii() and (c.islower() or c.isdigit()) else "".join(f"={b:02x}" for b in c.encode()) for c in save_id) or "="


def committed_saves(spark: SparkSession, root: str) -> list[str]:
    """The folders of the attempts that count, one for each save."""
    root = root.rstrip("/")
    fs, commits = hadoop_path(spark, f"{root}/commits")
    if not fs.exists(commits):
        return []
    names = sorted(e.getPath().getName() for e in fs.listStatus(commits) if not e.getPath().getName().startswith("."))
    found = []
    for name in names:
        _, marker = hadoop_path(spark, f"{root}/commits/{name}")
        stream = fs.open(marker)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        found.append(f"{root}/saves/{name}/{text}")
    return found


def saved_reports(spark: SparkSession, root: str) -> DataFrame:
    """(report_id, file_name, path, content, report_kind) of every committed save."""
    return _saved(spark, root, "reports", "report_id string, file_name string, path string, content string, report_kind string")


def saved_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(report_id, metadata_json) of every committed save."""
    return _saved(spark, root, "metadata", "report_id string, metadata_json string")


def _saved(spark: SparkSession, root: str, what: str, empty: str) -> DataFrame:
    folders = [f for f in (f"{a}/{what}" for a in committed_saves(spark, root)) if (lambda at: at[0].exists(at[1]))(hadoop_path(spark, f))]
    tables = [spark.read.option("basePath", f).parquet(f) for f in folders]
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], empty)


def list_saved_reports(spark: SparkSession, path: str, report_type: str | None = None) -> DataFrame:
    """S10 over saved rows: (report_id, path, report_kind), path descending; no content is read."""
    from ..operators.reports import list_reports
    saved = spark.read.parquet(path).select("report_id", "path", "report_kind")
    return list_reports(saved, report_type)


def list_report_files(spark: SparkSession, path: str, report_type: str | None = None) -> DataFrame:
    """S10 over one-file-per-report folders: (path, report_kind), path descending.

    Only file paths are selected, so file contents are never read.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.txt").load(path).select("path"))
    kind = F.regexp_extract("path", r"report_kind=([^/]+)/", 1)
    df = files.select("path", kind.alias("report_kind"))
    if report_type:
        low = report_type.lower()
        if "student" in low:
            df = df.where(F.col("report_kind") == "student_reports")
        elif "finance" in low:
            df = df.where(F.col("report_kind") == "finance_reports")
    return df.orderBy(F.col("path").desc())
