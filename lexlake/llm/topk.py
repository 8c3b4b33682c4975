"""Exact top-k inner products by norm-bucketed retrieval.

Vectors of integers are range-dealt by length into buckets, longest first. The scores of a query against the first
bucket of its vector length give a lower bound of its k-th best score, and with it the least length that a product needs.
Queries are packed with others of a like need, and a pack is dealt only to the buckets that reach it. In a bucket the bound,
divided by the query's length and the bucket's greatest length, is a local cosine threshold: where it is high, the sorted
lists of the query's largest coordinates leave the vectors in the feasible range (coordinate pruning); else a scan ends
where lengths get too short (length pruning). What is left is verified by integer products, so the result is exact.

Each component is floor(scale * x), x in double precision, an exact integer of any size that a double holds. Products are
summed as doubles where every sum stays below 2^53, else as 64-bit integers below 2^63, else as Python's integers. A
score among the results that is no 64-bit integer raises an error. Vectors that are null or hold null or non-finite
components (or whose scaled components are not finite) take no part, nor do empty vectors and rows with a null id.
Vectors meet vectors of the same length only. Equal scores go to the smaller vec_id. Rows that repeat count once; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_blocks
from .vectors import best_per_query, classes, matrix, packs, rows_by, usable

#: Buckets whose number and length are broadcast, at most (some 40 MB); buckets get larger beyond.
MOST_BUCKETS = 1_000_000
SLACK = 1 - 1e-9  # lengths are rounded, scores are not


def scores_of(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact products of integers held as doubles: int64 where they fit for certain, else objects."""
    largest = len(query) * float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0))
    if largest < 2**53:
        return (vectors @ query).astype(np.int64)
    if largest < 2**62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.array([sum(map(lambda a, b: a * b, v, q)) for q in [whole(query).tolist()] for v in whole(vectors).tolist()], object)


def top_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k greatest (score, id) of classes with these rows of ids (-1 where there is none), without the query's own id."""
    if len(scores) > k + 1:
        order = np.argsort(scores, kind="stable")
        at = np.flatnonzero(scores >= scores[order[-(k + 1)]])
        scores, ids = scores[at], ids[at]
    found = sorted(((-int(s), int(i)) for s, row in zip(scores, ids) for i in row if i not in (-1, own)))[:k]
    if any(not -(2**63) <= -s < 2**63 for s, _ in found):
        raise ValueError(f"a score of query {own} is no 64-bit integer")
    return [(-s, i) for s, i in found]


class Bucket:
    """A block of vectors, longest first, with the sorted list of each coordinate of the directions."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        norms = np.sqrt((vectors**2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.vectors, self.ids, self.norms = vectors[order], ids[order], norms[order]
        self.directions = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.directions[:, f], kind="stable")
            self.lists[f] = order, self.directions[order, f]
        return self.lists[f]

    def candidates(self, query: np.ndarray, need: float, high: float = 0.7, focus: int = 4) -> np.ndarray:
        """Rows that may reach a score of ``need`` times the query's length."""
        everything, length = np.arange(len(self.norms)), float(np.sqrt((query**2).sum()))
        if not need > 0 or length == 0:
            return everything
        if self.norms[0] < need:
            return everything[:0]
        local = min(1.0, need / self.norms[0])
        if local < high or not np.isfinite(length):  # length pruning
            return everything[: np.searchsorted(-self.norms, -need, side="right")]
        q = query / length
        hits = np.zeros(len(self.norms), np.int16)
        chosen = np.argsort(-np.abs(q), kind="stable")[:focus]
        for f in chosen:
            # a direction with cosine of at least `local` has its coordinate f within this range
            reach = np.sqrt(max(0.0, 1 - local**2) * max(0.0, 1 - q[f] ** 2)) + 1e-9
            low, top = (q[f] * local - reach if q[f] > -local else -1.0), (q[f] * local + reach if q[f] < local else 1.0)
            order, values = self.by_coordinate(int(f))
            hits[order[np.searchsorted(values, low - 1e-9, side="left") : np.searchsorted(values, top + 1e-9, side="right")]] += 1
        kept = np.flatnonzero(hits == len(chosen))
        return kept[self.norms[kept] >= need]


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) as doubles; from 2^53 on every double is an integer, and Spark's floor would end at 2^63."""
    whole = lambda y: F.when(F.abs(y) >= float(2**53), y).otherwise(F.floor(y).cast("double"))
    return F.transform(vector, lambda x: whole(x.cast("double") * scale))


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query in each bucket; rows of one bucket come one after another, so it is built once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, bucket = None, None
        for row in rows_by(batches):
            dim, at = row["dim"], (row["bucket"], row["dim"], row["ids"])
            if built != at:
                built, bucket = at, Bucket(matrix(row["vectors"], "<f8", dim), matrix(row["ids"], "<i8", k + 1))
            out = []
            for q, query, need in zip(np.frombuffer(row["q_ids"], "<i8"), matrix(row["q_vectors"], "<f8", dim), np.frombuffer(row["q_needs"], "<f8")):
                near = bucket.candidates(query, need)
                out += [(int(q), i, s) for s, i in top_of(scores_of(bucket.vectors[near], query), bucket.ids[near], q, k)] if len(near) else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def largest(df: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block_rows: int = 8_192, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest products with each vector whose vec_id is divisible by ``every``."""
    spark = df.sparkSession
    rows = usable(df, lambda v: scaled(v, scale), zero=True).where(~F.exists("vec", lambda x: F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    rows = materialize(spark, rows.select("vec_id", "vec", F.size("vec").alias("dim"), length.alias("length")), "vectors")
    index = materialize(spark, classes(rows, k + 1).select("vec", "ids", F.size("vec").alias("dim"), length.alias("length")), "vector-classes")

    n = index.count()
    block_rows = max(block_rows, -(-n // MOST_BUCKETS))
    ranged = index.repartitionByRange(n_blocks(n, block_rows), F.desc("length"), F.element_at("ids", 1)).withColumn("bucket", F.spark_partition_id().cast("long"))
    # ids beyond a class's own are -1
    padded = F.concat("ids", F.array_repeat(F.lit(-1).cast("long"), F.lit(k + 1) - F.size("ids")))
    ready = materialize(spark, ranged.select("bucket", "dim", padded.alias("ids"), F.col("vec").alias("vectors"), "length").sortWithinPartitions("bucket", "dim"), "ranged-vectors")
    held = materialize(spark, packs(ready.repartition("bucket", "dim").sortWithinPartitions("bucket", "dim"), {"bucket": "long", "dim": "int"}, {"ids": "<i8", "vectors": "<f8"}, 2 * block_rows), "vector-buckets")
    reach = ready.groupBy("bucket", "dim").agg(F.max("length").alias("longest"))
    reach = materialize(spark, reach.withColumn("first", F.row_number().over(Window.partitionBy("dim").orderBy("bucket")) == 1), "bucket-lengths")

    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"])
    n_queries = n_blocks(asked.count(), query_rows)

    def dealt(queries: DataFrame, first: bool) -> DataFrame:
        """Packs of queries (vec_id, vec, dim, need) beside each bucket that they have to look into."""
        own = queries.select("dim", F.col("vec_id").alias("q_ids"), F.col("vec").alias("q_vectors"), F.col("need").alias("q_needs")).repartitionByRange(n_queries, "dim", F.asc("q_needs"), "q_ids").sortWithinPartitions("dim", "q_needs", "q_ids")
        packed = packs(own, {"dim": "int"}, {"q_ids": "<i8", "q_vectors": "<f8", "q_needs": "<f8"}, query_rows, "q_needs")
        slim = F.broadcast(reach.where(F.col("first") == F.lit(first)).select(F.col("dim").alias("d"), "bucket", "longest"))
        pairs = packed.join(slim, (F.col("dim") == F.col("d")) & (F.col("longest") >= F.col("least"))).drop("d", "longest", "least")
        return pairs.join(held, ["bucket", "dim"])

    none = F.lit(float("-inf"))
    start = materialize(spark, searched(dealt(asked.withColumn("need", none), True), k), "first-scores")
    kth = start.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    need = F.when((F.col("bound") > 0) & (F.col("length") > 0), F.col("bound") / F.col("length") * SLACK)
    bounded = asked.join(kth, "vec_id", "left").withColumn("need", F.coalesce(need, none))
    return best_per_query(start.unionByName(searched(dealt(bounded, False), k)), k, nearest_first=False)
