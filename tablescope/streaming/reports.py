"""Report texts arriving as files, checked and rendered as they come.

The same batch operators run on every micro-batch through ``foreachBatch``; each batch
writes under ``batch_id=<n>`` with overwrite, so a replayed batch (after a failure) rewrites
its own output instead of duplicating it. Department lists and totals are static tables
joined to each batch. The stream's progress lives under the cluster's checkpoint folder
(the configured root, not this application's subfolder, so a restart resumes it).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reports as RP
from ..operators import validate as V
from ..session import checkpoint, checkpoint_root, release

REPORT_SCHEMA = ("report_id bigint, dataset_id bigint, report_type string, report_text string, "
                 "source_file string, prompt_tokens bigint, output_tokens bigint, total_tokens bigint")


def check_batch(batch: DataFrame, departments: DataFrame | None, totals: DataFrame | None,
                ts: dt.datetime) -> DataFrame:
    """Validation + documents for one batch of report rows; rows are joined by a number of their own, so that
    null and repeated ids keep their own checks."""
    rows = checkpoint(batch.withColumn("_row", F.monotonically_increasing_id()))
    checked = V.validate_reports(rows, departments, totals, id_col="_row")
    return RP.report_documents(rows.join(checked, "_row"), ts, keep=("is_valid", "issues", "num_extracted"))


def start_report_stream(spark: SparkSession, source_dir: str, sink_dir: str, ts: dt.datetime, name: str = "reports",
                        departments: DataFrame | None = None, totals: DataFrame | None = None, schema: str = REPORT_SCHEMA,
                        available_now: bool = True, checkpoint_location: str | None = None) -> StreamingQuery:
    """Watch ``source_dir`` (parquet files of report rows); write documents as parquet. ``ts`` is the save time
    written into the documents: it is given, not read from a clock, so a replayed batch writes the same rows."""
    ckpt = checkpoint_location or f"{checkpoint_root(spark)}/streams/{name}"
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        written = checkpoint(batch)  # read once from the source, however many joins use it
        (check_batch(written, departments, totals, ts)
         .withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}"))
        release(written)

    writer = stream.writeStream.queryName(name).option("checkpointLocation", ckpt).foreachBatch(handle)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
