"""Session helpers: build a session for tests/bench, find the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tablescope") -> SparkSession:
    """Local/test session. On a cluster, use the session the platform hands you."""
    master = master or os.environ.get("TABLESCOPE_MASTER", "local[8]")
    cores = master[master.find("[") + 1:-1] if "[" in master else "8"
    parts = shuffle_partitions or (8 if cores in ("*", "") else int(cores))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.caseSensitive", "true")  # headers that differ only in case are two columns
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TABLESCOPE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local-mode session without one
    (tests, a laptop) gets a fresh scratch folder of our own; a cluster session without one
    is an error, because a machine-local folder would not survive losing that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        configured = tempfile.mkdtemp(prefix="tablescope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint_root(spark: SparkSession) -> str:
    """The configured shared folder itself, for state that must outlive this application (a
    stream's progress). ``getCheckpointDir`` is a fresh subfolder per application, so a
    restarted stream kept there would lose its progress and replay from batch 0."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return os.path.dirname(ensure_checkpoint_dir(spark).rstrip("/"))


def checkpoint(df):
    """Cut the lineage: write ``df`` as a parquet table in the cluster's checkpoint folder and
    read it back.

    One job computes and writes the rows once (an eager ``Dataset.checkpoint`` runs its last
    stage twice, once to count and once to write). The copy is columnar and compressed, so
    later reads prune columns and push filters down, and AQE plans joins from its real size.
    ``getCheckpointDir`` is already a folder of this application, on the shared storage the
    cluster names, so a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_end(spark, path)
    out = spark.read.parquet(path)
    out._written_at = path
    return out


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder for files that a job writes and reads back; deleted with the checkpoint tables."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _delete_at_end(spark, path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) in the store that holds ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Checkpoint tables are plain folders, which Spark's own checkpoint cleaner leaves alone: the file
    system deletes the folder that holds them when the application ends."""
    fs, folder = hadoop_path(spark, path.rsplit("/", 1)[0])
    fs.deleteOnExit(folder)


def release(df) -> None:
    """Delete the table that ``checkpoint`` wrote for ``df``; nothing may read it afterwards."""
    path = getattr(df, "_written_at", None)
    if path:
        fs, p = hadoop_path(df.sparkSession, path)
        fs.delete(p, True)


def release_all(spark: SparkSession) -> None:
    """Delete every checkpoint table of this application (for example once a job's results are saved)."""
    fs, p = hadoop_path(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables")
    fs.delete(p, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python tasks can import it
    wherever they run (Spark's own file server hands the archive out)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tablescope-code-"), "tablescope_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def scale_conf(input_bytes: int, executors: int, cores_per_executor: int,
               target_partition_bytes: int = 128 * 1024 ** 2) -> dict[str, str]:
    """Suggested settings for a cluster run over ``input_bytes`` of parquet.

    Scan splits of ~128 MB; enough initial shuffle partitions that each holds ~128 MB of the
    largest shuffle (about the input size for a profile's value counts) and at least two
    waves of tasks; AQE then coalesces small partitions and splits skewed ones.
    """
    slots = max(1, executors * cores_per_executor)
    parts = max(2 * slots, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
