"""Session settings and the folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "websift", memory: str = "8g") -> SparkSession:
    """A session for tests and benches. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the cluster; with a local master a local one where none is set. RuntimeError on a cluster without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "/tmp/websift-shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_written() -> None:
    """Deletes the tables that materialise wrote, at the end of the driver; results read from them must be written by then."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors.

    by: a column of few values, each of which gets a folder of its own, so that a filter on it reads no other.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/websift-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
