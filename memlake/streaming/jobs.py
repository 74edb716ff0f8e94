"""Structured Streaming jobs: windows, duplicates, sessions, quarantine; each runs on what is available and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.shared import shared_folder
from memlake.sources.tables import load


def event_stream(spark: SparkSession, root: str, schema: T.StructType, name: str = "events") -> DataFrame:
    """A stream of the files of one table; timestamps in UTC."""
    files = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 8).parquet(root)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stream of one table below root, a file or a folder of files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    files = spark.readStream.schema(load(spark, root, name).schema).option("maxFilesPerTrigger", 8)
    return files.parquet(path.toString()) if folder else files.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def run_available(stream: DataFrame, mode: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run a stream over all that is available now into the shared folder and return what it wrote, after `then`.

    Append output is written by the file sink; complete and update output batch by batch, the last batch of a
    key winning.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    if mode == "append":
        done = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    else:
        write = lambda batch, n: batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        done = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    if done.exception():
        raise done.exception()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])
    return then(spark.read.schema(schema).parquet(f"{folder}/out"))


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame, key: list[str], late: str = "2 days") -> DataFrame:
    """At-least-once delivery made exactly-once, with state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def cleared_waits(events: DataFrame, asked: str, cleared: str, within: str = "1 day", late: str = "2 days") -> DataFrame:
    """Requests and the signals that clear them: a join of two streams within an interval, so that state is bounded."""
    left = events.where(F.col("event_type") == asked).withWatermark("ts", late).select(F.col("event_id").alias("asked_id"), "user_id", F.col("ts").alias("asked_at"))
    right = events.where(F.col("event_type") == cleared).withWatermark("ts", late).select(F.col("event_id").alias("cleared_id"), F.col("user_id").alias("__user"), F.col("ts").alias("cleared_at"))
    return left.join(right, F.expr(f"user_id = __user and cleared_at > asked_at and cleared_at <= asked_at + interval {within}")).select("asked_id", "cleared_id", "user_id")
