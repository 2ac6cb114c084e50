"""Session construction and table loading shared by queries, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "cuesheet", **extra: str) -> SparkSession:
    """A single-JVM session with the settings that tests and the benchmark use."""
    conf = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark so that any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local-mode session without that setting gets a temporary folder; on a cluster a
    machine-local folder would not be visible to other executors, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_cuesheet_shared"):
        sc._cuesheet_shared = "file://" + tempfile.mkdtemp(prefix="cuesheet-")
    return sc._cuesheet_shared


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder below the shared one, which goes when the driver ends."""
    sc = spark.sparkContext
    base = f"{shared_dir(spark)}/cuesheet-{sc.applicationId}"
    if not hasattr(sc, "_cuesheet_folder"):
        folder = sc._jvm.org.apache.hadoop.fs.Path(base)
        fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        sc._cuesheet_folder = base
    return f"{base}/{name}-{uuid.uuid4().hex}"
