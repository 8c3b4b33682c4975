"""Incremental jobs: file streams that stop when they have caught up, so that a run resumes where the last one ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events and values by hour and type; the same for a table and a stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    by = rows.groupBy(F.window(ts, "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Sessions of users, parted by a gap."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    by = rows.groupBy(F.session_window(ts, gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_stream(spark: SparkSession, path: str, schema, out: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Hourly counts of a growing folder, appended once an hour is over by the watermark."""
    rows = file_stream(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total").writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(out)


def incremental(spark: SparkSession, path: str, schema, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run ``work`` on the files that are new since the last run. A batch writes its own folder, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return file_stream(spark, path, schema).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def upserted(spark: SparkSession, path: str, key: tuple[str, ...], order: str) -> DataFrame:
    """The latest row of each key over the batches of ``incremental``."""
    rows = spark.read.parquet(path)
    w = Window.partitionBy(*key).orderBy(F.desc("batch"), F.desc(order))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "batch")
