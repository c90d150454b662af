"""Session construction, table loading and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pagelore", cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with; on a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parents[1]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='pagelore-')}/pagelore", "zip", root, "pagelore"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of a data directory, pruned to `columns` if any are given."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only in a local session where that is unset, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="pagelore-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` as parquet into the shared folder and read it back.

    Unlike a local checkpoint the copy does not live on an executor, and unlike a checkpoint of rows it is columnar,
    so later steps prune columns and Spark knows its size when it chooses join strategies.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagelore-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
