"""Global positions without a global task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.operators.stored import fresh_dir, store


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``pos``, its place from 1 in the order of the columns. Rows are range-sorted once and stored, so that no lost executor can deal them
    anew; counts by partition, a row for each, give the offsets."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    ranged = store(ranged, fresh_dir(spark, "positions"))
    local = F.col("at") - F.shiftleft(F.col("part").cast("long"), 33) + 1
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").withColumn("pos", F.col("before") + local).drop("part", "at", "before")  # a row for each partition
