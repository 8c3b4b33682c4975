"""Pages of a long list at any depth: rows stored in order, and an index of how many rows each file has.

The rows are range-sorted once and stored in a folder for each range, with their place in it. The index has a row for each range, so a page reads the one
or two ranges that it lies in, and of these the row groups with its places; the total comes from the index. Nothing is skipped row by row.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PLACE = (1 << 33) - 1


class PagedList:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        self.rows = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/rows")
        known = spark.read.parquet(f"{path}/index").orderBy("part").collect()  # a row for each range
        self.parts, sizes = [r.part for r in known], [r.n for r in known]
        self.before, self.total = [0, *accumulate(sizes)][: len(sizes)], sum(sizes)

    @classmethod
    def write(cls, df: DataFrame, path: str, *order: str | Column, ranges: int | None = None) -> PagedList:
        """Store the rows in the order of columns that tell all rows apart; in so many ranges, else as adaptive execution sizes them."""
        placed = df.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(PLACE)})
        placed.write.partitionBy("part").parquet(f"{path}/rows")
        spark = df.sparkSession
        spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/index")
        return cls(spark, path, placed.schema)  # without rows there is nothing to read a schema from

    def between(self, first: int, last: int) -> DataFrame:
        """Rows ``first`` to ``last`` (without it), from 0, with ``pos`` from 1."""
        first, last = max(0, first), min(last, self.total)
        if first >= last:
            return self.rows.limit(0).withColumn("pos", F.lit(0).cast("long")).drop("part", "place")
        a, b = bisect_right(self.before, first) - 1, bisect_right(self.before, last - 1)
        reads = []
        for k in range(a, b):
            own = self.rows.where((F.col("part") == self.parts[k]) & (F.col("place") >= first - self.before[k]) & (F.col("place") < last - self.before[k]))
            reads.append(own.withColumn("pos", F.col("place") + self.before[k] + 1))
        return reduce(DataFrame.unionAll, reads).drop("part", "place")

    def page(self, number: int, size: int) -> DataFrame:
        """A page, from 1, with the number of rows in all."""
        return self.between((number - 1) * size, number * size).withColumn("total", F.lit(self.total).cast("long"))

    def first_rows(self, size: int) -> DataFrame:
        """page and the first row of each page of ``size`` rows."""
        spark = self.rows.sparkSession
        before = spark.createDataFrame(list(zip(self.parts, self.before)), "part INT, before BIGINT")
        pos = self.rows.join(F.broadcast(before), "part").withColumn("pos", F.col("place") + F.col("before"))  # a row for each range
        return pos.where(F.col("pos") % size == 0).withColumn("page", (F.col("pos") / size).cast("long") + 1).drop("part", "place", "before", "pos")
