"""What the two vector searches share: usable rows, classes of equal vectors, packs of vectors, and the best of each query.

Equal vectors become one class that keeps its ``keep`` smallest ids: with the query's own id removed, no more than the
first k of a class can be among k results, so nothing is lost and a vector that a third of all rows hold is searched
once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: Callable[[Column], Column], zero: bool, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and vec of the rows that take part: no null id, no null or empty vector, no null or non-finite component."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    if not zero:
        kept = kept.where(F.exists(v, lambda x: x != 0))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), vector(v).alias("vec"))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """vec, ids: one row per different vector with its ``keep`` smallest ids, ascending. Row limits act before the shuffle."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.groupBy("vec", "vec_id").agg(F.lit(1).alias("one")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def packs(df: DataFrame, key: dict[str, str], values: dict[str, str], most: int, least: str | None = None) -> DataFrame:
    """One row for each run of equal keys, of at most ``most`` rows, with the values of each column one after another in a binary.

    ``df`` is sorted by the key within its partitions; ``key`` and ``values`` give the Spark and the numpy type of each column (binary
    values are "raw"). ``least``: a column of doubles whose smallest value in the pack stands beside it as "least"."""
    names = [*key, *values]
    kinds = pa.schema([*(pa.field(n, {"long": pa.int64(), "int": pa.int32()}[t]) for n, t in key.items()), *(pa.field(n, pa.binary()) for n in values), *[pa.field("least", pa.float64())] * bool(least)])

    def made(at: tuple, held: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(values, zip(*held)))
        out = {n: b"".join(columns[n]) if t == "raw" else np.asarray(columns[n], t).tobytes() for n, t in values.items()}
        return pa.RecordBatch.from_pylist([dict(zip(key, at)) | out | ({"least": min(columns[least])} if least else {})], schema=kinds)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for row in rows:
                if held and (row[: len(key)] != at or len(held) >= most):
                    yield made(at, held)
                    held = []
                at = row[: len(key)]
                held.append(row[len(key) :])
        if held:
            yield made(at, held)

    return df.select(*names).mapInArrow(pack, ", ".join([*(f"{n} {t}" for n, t in key.items()), *(f"{n} binary" for n in values), *["least double"] * bool(least)]))


def rows_by(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of packs, one in memory at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}


def matrix(raw: bytes, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype).reshape(-1, width)


def best_per_query(found: DataFrame, k: int, nearest_first: bool) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query, ties to smaller vec_id."""
    order = F.asc("score") if nearest_first else F.desc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
