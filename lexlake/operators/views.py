"""Aggregates that are kept up to date by changes: inserts and retractions, versions with an atomic pointer, a cursor and a time budget.

A view holds, for its key and detail columns, how often each combination stands in the table (``n``). Counts, counts of different values, sums, smallest and
largest values all follow from that, after retractions too. Rows are dealt to buckets by key; a change rewrites the buckets that it touches, in a new folder, and
leaves all others where they are. Then a pointer file, numbered and written under a temporary name first, says where each bucket is and which increment was the last. A
reader takes the pointer with the highest number, so it never sees half of a change; a run that is killed leaves folders that no pointer names, and the
next run does that increment again. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lexlake.operators.stored import tasks_of


@dataclass(frozen=True)
class Version:
    number: int = 0
    cursor: int | None = None
    folders: dict[str, str] = field(default_factory=dict)


class View:
    """``columns``: the key columns, whose first parts give the bucket, then the details, as a DDL schema."""

    def __init__(self, spark: SparkSession, root: str, columns: str, key: int = 1, buckets: int = 32):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schema = StructType.fromDDL(columns)
        self.columns, self.key = self.schema.names, self.schema.names[:key]
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions -----------------------------------------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        at = self.path(f"{self.root}/pointers")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        known = self.numbers()
        if number is None and not known:
            return Version()
        text = self.spark.read.text(f"{self.root}/pointers/{known[-1] if number is None else number:012d}.json", wholetext=True).first()[0]
        return Version(**json.loads(text))

    def point(self, to: Version) -> None:
        """Make a version the current one: the file appears whole or not at all."""
        final, draft = self.path(f"{self.root}/pointers/{to.number:012d}.json"), self.path(f"{self.root}/pointers/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(vars(to)).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {to.number} of {self.root} exists: another writer was faster")

    def vacuum(self, keep: int = 2) -> None:
        """Delete old pointers, and folders that no kept pointer names. Not while another run writes."""
        known = self.numbers()
        for number in known[:-keep]:
            self.fs.delete(self.path(f"{self.root}/pointers/{number:012d}.json"), False)
        used = {f.split("/")[-3] for n in known[-keep:] for f in self.version(n).folders.values()}
        data = self.path(f"{self.root}/data")
        for s in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if s.getPath().getName() not in used:
                self.fs.delete(s.getPath(), True)

    # --- rows ---------------------------------------------------------------------------------------------------------------

    def stored(self, folders: Iterable[str]) -> DataFrame:
        whole, paths = StructType([*self.schema.fields]).add("n", LongType()), sorted(folders)
        return self.spark.read.schema(whole).parquet(*paths) if paths else self.spark.createDataFrame([], whole)

    def rows(self) -> DataFrame:
        """The columns of the view, and n."""
        return self.stored(self.version().folders.values())

    def apply(self, change: DataFrame, cursor: int) -> Version:
        """Take in a change (the columns of the view, and ``change``: 1 for a row that came, -1 for one that went). An increment that was taken in is not taken
        in again. A row that goes more often than it came is an error."""
        now = self.version()
        if now.cursor is not None and cursor <= now.cursor:
            return now
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        delta = change.groupBy(*self.columns).agg(F.sum("change").cast("long").alias("n")).where("n <> 0").withColumn("bucket", bucket)
        folder = f"{self.root}/data/{now.number + 1:012d}-{uuid.uuid4().hex}"
        delta.write.parquet(f"{folder}/change")
        delta = self.spark.read.schema(delta.schema).parquet(f"{folder}/change")
        touched = sorted(r.bucket for r in delta.select("bucket").distinct().collect())  # at most ``buckets``
        old = self.stored(now.folders[str(b)] for b in touched if str(b) in now.folders).withColumn("bucket", bucket)
        n = F.when(F.col("n") < 0, F.raise_error(F.lit("a row goes that never came"))).otherwise(F.col("n"))
        both = old.unionByName(delta).repartition(tasks_of(old, delta), *self.columns)  # a combination stands once in either
        merged = both.groupBy("bucket", *self.columns).agg(F.sum("n").alias("n")).where("n <> 0").withColumn("n", n.cast("long"))
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/rows")
        kept = {b: f for b, f in now.folders.items() if int(b) not in touched}
        fresh = {str(b): f"{folder}/rows/bucket={b}" for b in touched if self.fs.exists(self.path(f"{folder}/rows/bucket={b}"))}
        after = Version(now.number + 1, cursor, kept | fresh)
        self.point(after)
        return after

    def run(self, increments: Iterable[tuple[int, Callable[[], DataFrame]]], seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> bool:
        """Take in increments (cursor, a function that gives the change) in the order of their cursors, after the stored one, until they end or the time is
        over; whether they ended. At least one is taken in, so that runs that are too short get on."""
        began, done = clock(), self.version().cursor
        first = True
        for cursor, change in increments:
            if done is not None and cursor <= done:
                continue
            if not first and seconds is not None and clock() - began >= seconds:
                return False
            self.apply(change(), cursor)
            first = False
        return True

    def follow(self, stream: DataFrame, to_change: Callable[[DataFrame], DataFrame], checkpoint: str):
        """Take in a stream: the number of a batch is its cursor, so a batch that runs again changes nothing."""
        return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: self.apply(to_change(batch), number) and None).start()


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns the rows of one table into those of another: a change for each different row."""
    columns = after.columns
    both = after.select(*columns, F.lit(1).alias("change")).unionByName(before.select(*columns, F.lit(-1).alias("change")))
    return both.groupBy(*columns).agg(F.sum("change").alias("change")).where("change <> 0")


def counted(rows: DataFrame, by: tuple[str, ...], count: str = "n", distinct: dict[str, str] | None = None, least: dict[str, str] | None = None, most: dict[str, str] | None = None) -> DataFrame:
    """Aggregates of a view's rows: rows in all as ``count``, different values, smallest and largest values (name -> column)."""
    out = [F.sum("n").alias(count), *[F.count_distinct(c).alias(a) for a, c in (distinct or {}).items()], *[F.min(c).alias(a) for a, c in (least or {}).items()], *[F.max(c).alias(a) for a, c in (most or {}).items()]]
    if distinct:  # each combination stands once, so no task gets more than its share
        rows = rows.repartition(tasks_of(rows), *[c for c in rows.columns if c != "n"])
    return rows.groupBy(*by).agg(*out)

