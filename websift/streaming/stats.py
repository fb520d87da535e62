"""State statistics over a growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from websift.schema import STATE_LOG, state_name


def state_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a state log as a stream."""
    return spark.readStream.schema(STATE_LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def counts(log: DataFrame) -> DataFrame:
    """Records of each state type; for a stream, with the output mode 'complete'."""
    return log.groupBy("state_type").agg(F.count("*").alias("n")).withColumn("name", state_name(F.col("state_type")))


def windowed(log: DataFrame, window: str = "30 seconds", late: str = "1 hour") -> DataFrame:
    """Records of each type and window of state_time; rows later than the watermark are dropped. A record delivered twice (same seq) counts once."""
    deduped = log.withWatermark("state_time", late).dropDuplicates(["seq", "state_time"])
    return deduped.groupBy(F.window("state_time", window), "state_type").agg(F.count("*").alias("n"))


def follow_current(log: DataFrame, table: str, checkpoint: str, interval: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Keeps a folder of current states: each batch merges the last record of its keys with the states before and writes a new version.

    A version is a folder of its own by the number of its batch, so a batch that is run again writes the same one; the two latest are kept.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*STATE_LOG.names)
        if number > 0:
            rows = rows.unionByName(spark.read.schema(STATE_LOG).parquet(f"{table}/version={number - 1}"))
        last = rows.groupBy("url_key").agg(F.max_by(F.struct(*STATE_LOG.names), "seq").alias("x")).select("x.*")
        # Tombstones stay, so that an older record that comes late does not bring a key back.
        last.write.mode("overwrite").parquet(f"{table}/version={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/version={number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    writer = log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest version that follow_current has finished, without tombstones."""
    at = spark._jvm.org.apache.hadoop.fs.Path(table)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath() for f in system.listStatus(at) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    newest = max(done, key=lambda p: int(p.getName().partition("=")[2]))
    return spark.read.schema(STATE_LOG).parquet(newest.toString()).where("state_type <> 0")


def start_statistics(log: DataFrame, table: str, checkpoint: str, interval: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Keeps a table of the counts current; once: takes what is there and ends."""
    writer = counts(log).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
