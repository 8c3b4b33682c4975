"""Results of a round, kept in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a table that one task takes where the table is dealt by a key: with the table the tasks grow in number, not in memory.
ROWS_AT_ONCE = 500_000


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; under a temporary one only in local mode, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or f"file://{os.path.join(tempfile.gettempdir(), 'lexlake-shared')}"
    if ":" not in base.split("/")[0]:  # of Hadoop's default file system, as for Spark itself
        at = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"{base}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored result that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once and read back: lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_of(*tables: DataFrame) -> int:
    """The tasks that stored tables are dealt to; their rows are counted by Parquet's footers."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-sum(t.count() for t in tables) // ROWS_AT_ONCE))
