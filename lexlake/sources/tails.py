"""The last lines of large logs: only the ends of the files are read, in blocks, by tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block, and of a line at the first guess.
BLOCK, LINE = 16 << 20, 512


def own_lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin from ``start`` to ``end`` (without it)."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        f.seek(max(0, start - 1))
        data = f.read(end - max(0, start - 1))
        while data and not data.endswith(b"\n"):  # the last line goes on
            more = f.read(1 << 16)
            if not more:
                break
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
    if start:  # the byte before tells whether a line begins here
        cut = data.find(b"\n")
        data = data[cut + 1 :] if cut >= 0 else b""
    if data:
        yield from data.removesuffix(b"\n").split(b"\n")


def tail(spark: SparkSession, paths: list[str], n: int = 50_000, block: int = BLOCK, line: int = LINE) -> DataFrame:
    """value: the last ``n`` lines of the files, one after another in the given order; fewer, if they have fewer. A file that is not there is an error.

    The ends that should hold n lines are cut into blocks and counted; if they hold too few, four times as much is read."""
    files = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        uri = status.getPath().toString()
        files.append((uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri, status.getLen()))
    take, everything = max(1, n) * line, sum(size for _, size in files)
    while True:
        left, blocks = take, []
        for path, size in reversed(files):
            lowest = max(0, size - left)
            ends = [(path, s, min(s + block, size)) for s in range(lowest, size, block)]
            blocks = ends + blocks
            left -= size - lowest
            if left <= 0:
                break
        if not blocks:
            return spark.createDataFrame([], "value STRING")
        table = spark.createDataFrame([(k, *b) for k, b in enumerate(blocks)], "number INT, path STRING, low BIGINT, high BIGINT").repartitionByRange(len(blocks), "number")

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                yield pa.RecordBatch.from_pydict({"number": pa.array([r["number"] for r in rows], pa.int32()), "n": pa.array([sum(1 for _ in own_lines(r["path"], r["low"], r["high"])) for r in rows], pa.int64())})

        counts = {r.number: r.n for r in table.mapInArrow(count, "number int, n bigint").collect()}  # a row for each block
        if sum(counts.values()) >= n or take >= everything:
            break
        take *= 4
    sizes = [counts.get(k, 0) for k in range(len(blocks))]
    skip = max(0, sum(sizes) - n)
    before = [0, *accumulate(sizes)]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lines = list(own_lines(r["path"], r["low"], r["high"]))[max(0, skip - before[r["number"]]) :]
                yield pa.RecordBatch.from_pydict({"value": pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())})

    return table.where(F.col("number").isin([k for k in range(len(blocks)) if before[k + 1] > skip])).mapInArrow(read, "value string")
