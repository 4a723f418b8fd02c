import datetime as dt
import os
import tempfile

from tablescope.streaming.reports import REPORT_SCHEMA, start_report_stream


def test_report_stream_processes_arriving_files(spark):
    src, out, ckpt = (tempfile.mkdtemp(prefix=p) for p in ("src-", "out-", "ckpt-"))
    rows = [(1, 1, "student_report", "Departemen Hukum " + "a" * 200, "f.xlsx", 1, 2, 3),
            (2, 1, "finance_report", "pendek", None, None, None, None)]
    spark.createDataFrame(rows, REPORT_SCHEMA).write.parquet(os.path.join(src, "part1"))
    depts = spark.createDataFrame([(1, "Teknik")], "dataset_id bigint, department string")
    q = start_report_stream(spark, os.path.join(src, "*"), out, name="t_reports", departments=depts,
                            ts=dt.datetime(2025, 1, 1), checkpoint_location=ckpt)
    q.awaitTermination(120)
    got = {r["report_id"]: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {1, 2}
    assert got[1]["report_kind"] == "student_reports" and not got[1]["is_valid"]
    assert got[1]["issues"] == ["Departemen 'Hukum' disebut dalam teks, tapi tidak ada di data"]
    assert got[2]["issues"] == ["Teks laporan terlalu pendek (<200 karakter)"]
    # A second file arrives; the restarted stream only picks up the new rows.
    spark.createDataFrame([(3, 2, "general", "b" * 250, None, 1, 1, 2)], REPORT_SCHEMA) \
        .write.parquet(os.path.join(src, "part2"))
    q = start_report_stream(spark, os.path.join(src, "*"), out, name="t_reports2", departments=depts,
                            ts=dt.datetime(2025, 1, 1), checkpoint_location=ckpt)
    q.awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert sorted(r["report_id"] for r in got) == [1, 2, 3]


def test_stream_progress_root_is_not_the_per_application_folder(spark):
    from tablescope.session import checkpoint_root, ensure_checkpoint_dir
    def plain(p):  # Spark qualifies local paths with a file: scheme
        return p[len("file:"):] if p.startswith("file:") else p

    app_dir = plain(ensure_checkpoint_dir(spark).rstrip("/"))
    root = plain(checkpoint_root(spark))
    assert app_dir.startswith(root + "/") and app_dir != root
