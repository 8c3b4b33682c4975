"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SHIPPED_BYTES = 64 << 20
#: Tasks that read files back, at most; each takes every so-manieth file.
MOST_READERS = 8_192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset, a temporary one, in local mode only.
    A path without a scheme is one of Hadoop's default file system, as for Spark itself."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'lexlake-shared')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if ":" not in base.split("/")[0]:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder (to ``path``, if given) and read it back: lineage ends there and nothing upstream runs twice."""
    path = path or fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a URI and the path in it; works in any task."""
    return pafs.FileSystem.from_uri(uri)


def file_bytes(spark: SparkSession, path: str):
    """Broadcast a small model or vocabulary file; its size is checked, so that what is shipped stays bounded."""
    if (size := os.path.getsize(path)) > MAX_SHIPPED_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_SHIPPED_BYTES} are sent to the executors")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def text_of(col: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def n_blocks(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def one_task_each(files: DataFrame, number: str, count: int) -> DataFrame:
    """Rows with numbers from 0 to ``count`` - 1, each in a task of its own (in turn beyond MOST_READERS); adaptive execution leaves them so."""
    tasks = max(1, min(count, MOST_READERS))
    return files.repartitionById(tasks, F.pmod(F.col(number), F.lit(tasks)).cast("int"))
