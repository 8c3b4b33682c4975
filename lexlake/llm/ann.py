"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of a bounded sample (``SAMPLE`` vectors of each length, by hash; ``n_pivots`` of them, spread out by
farthest-first choice). Every vector is represented by its ``prefix`` nearest pivots in order. Pivot inverted files hold, for
each pivot, the vectors that have it among their first ``posted`` pivots, with their prefixes. A query looks into the
files of its first ``asked`` pivots only. There it ranks by the footrule distance of the prefixes (a pivot outside a
prefix counts as place ``prefix``); a vector that it meets in several files counts in the first of them. The ``per_list`` best
of each list go on, and of those the best of each query are ranked by the exact Euclidean distance in double precision: ``budget`` of them or,
where that is more, ``share`` of all vectors; all that go on, with ``budget`` None.

Files are cut into lists of at most about ``list_rows`` vectors, so what goes on is a fixed share of what a query meets and recall does not fall as a table
grows. The queries of a pivot are cut into packs; a pack and a list are a unit of work, so a pivot that a third of all vectors are close to is spread
over many tasks. A query that found fewer than k vectors looks into all files. The same steps are taken at every size.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null id.
Vectors are compared with vectors of the same length only. Equal distances go to the smaller vec_id. Rows that repeat
count once; a table without usable vectors, or without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_SHIPPED_BYTES, materialize, n_blocks
from .vectors import best_per_query, classes, matrix, packs, rows_by, usable

SAMPLE = 4_000


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first from the first row; fewer than ``n`` from a small sample, but 32 if there are so many."""
    n = min(n, max(32, len(sample) // 8), len(sample))
    chosen, away = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < n:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the ``prefix`` nearest pivots of each vector, nearest first."""
    d = (vectors**2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots**2).sum(1)
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def pivots_of(index: DataFrame, n_pivots: int) -> dict[int, np.ndarray]:
    """The pivots of each vector length."""
    sizes = index.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    drawn = F.pmod(F.xxhash64("vec", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    near = index.join(sizes, "dim").where(drawn < F.lit(2.0 * SAMPLE) / F.col("n")).withColumn("drawn", drawn)
    few = near.withColumn("rn", F.row_number().over(Window.partitionBy("dim").orderBy("drawn", F.element_at("ids", 1)))).where(F.col("rn") <= SAMPLE)
    sample: dict[int, list] = {}
    for r in few.select("dim", "rn", "vec").orderBy("dim", "rn").collect():
        sample.setdefault(r.dim, []).append(r.vec)
    out = {dim: choose_pivots(np.asarray(v), n_pivots) for dim, v in sample.items()}
    if sum(p.nbytes for p in out.values()) > MAX_SHIPPED_BYTES:
        raise ValueError("too many pivots to broadcast: vectors of very many lengths")
    return out


def with_prefixes(rows: DataFrame, pivots, prefix: int, places: int) -> DataFrame:
    """id, dim, perm (places of 16 bits), lists (the first ``places`` pivots) of rows (id, vec)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            by_dim: dict[int, list] = {}
            for i, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_dim.setdefault(len(vec), []).append((i, vec))
            for dim, own in by_dim.items():
                perms = permutations(np.asarray([v for _, v in own]), pivots.value[dim], prefix)
                out += [(i, dim, p.tobytes(), p[:places].tolist()) for (i, _), p in zip(own, perms)]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["id", "dim", "perm", "lists"])

    return rows.select("id", "vec").mapInArrow(run, "id long, dim int, perm binary, lists array<int>")


def by_footrule(pairs: DataFrame, n_pivots: dict[int, int], prefix: int, posted: int, most: int) -> DataFrame:
    """query_id, id, away: the ``most`` vectors of a list that are nearest to each query of a pack by footrule, up to what is the
    same for all vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_by(batches):
            n = n_pivots[row["dim"]]
            width = min(prefix, n)
            ids, perms = np.frombuffer(row["ids"], "<i8"), matrix(row["perms"], "<i2", width)
            own, first = np.arange(width, dtype=np.int16), perms[:, :posted]
            queries, found, scores = [], [], []
            for q, perm in zip(np.frombuffer(row["q_ids"], "<i8"), matrix(row["q_perms"], "<i2", width)):
                place = np.full(n, width, np.int16)
                place[perm] = own
                here = np.flatnonzero(place[first].min(axis=1) == place[row["pivot"]])  # met in an earlier file otherwise
                met = place[perms[here]]
                # in both: |place - its place|; in one only: up to the end of the prefix
                away = (np.abs(met - own).astype(np.int32) - (width - met)).sum(axis=1)
                if len(here) > most:
                    best = np.lexsort((ids[here], away))[:most]
                    here, away = here[best], away[best]
                queries.append(np.full(len(here), q))
                found.append(ids[here])
                scores.append(away)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in ((queries, "i8"), (found, "i8"), (scores, "i4"))], names=["query_id", "id", "away"])

    return pairs.mapInArrow(run, "query_id long, id long, away int")


def nearest(
    df: DataFrame, every: int = 100, k: int = 10, n_pivots: int = 512, prefix: int = 128, posted: int = 8, asked: int = 48, per_list: int = 32, budget: int | None = 1_000, share: float = 0.01, list_rows: int = 1_024, query_rows: int = 256
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found to each vector whose vec_id is divisible by ``every``."""
    spark = df.sparkSession
    rows = materialize(spark, usable(df, lambda v: F.transform(v, lambda x: x.cast("double")), zero=False), "vectors")
    index = materialize(spark, classes(rows, k + 1).select(F.element_at("ids", 1).alias("id"), "ids", "vec", F.size("vec").alias("dim")), "vector-classes")
    pivots = pivots_of(index, n_pivots)
    most = None if budget is None else max(budget, round(share * index.count()))
    shipped, n_of = spark.sparkContext.broadcast(pivots), {dim: len(p) for dim, p in pivots.items()}

    posts = materialize(spark, with_prefixes(index, shipped, prefix, posted), "prefixes").select("id", "dim", "perm", F.explode("lists").alias("pivot"))
    sizes = posts.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("lists"))
    sizes = materialize(spark, sizes, "file-sizes")  # a row for each pivot
    key = {"dim": "int", "pivot": "int", "list": "int"}
    cut = posts.join(F.broadcast(sizes), ["dim", "pivot"]).withColumn("list", F.pmod(F.xxhash64("id"), F.col("lists")).cast("int"))
    files = packs(cut.select(*key, F.col("id").alias("ids"), F.col("perm").alias("perms")).repartition(*key).sortWithinPartitions(*key), key, {"ids": "<i8", "perms": "raw"}, 2 * list_rows)
    files = materialize(spark, files, "inverted-files")

    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"]).select(F.col("vec_id").alias("id"), "vec")
    queries = materialize(spark, queries, "queries")

    def found(own: DataFrame, places: int) -> DataFrame:
        """query_id, vec_id, score of the vectors within the budget of each query."""
        looks = with_prefixes(own, shipped, max(prefix, places), places)
        looks = looks.select("dim", F.explode("lists").alias("pivot"), F.col("id").alias("q_ids"), F.substring("perm", 1, 2 * prefix).alias("q_perms"))
        packed = packs(looks.repartition("dim", "pivot").sortWithinPartitions("dim", "pivot"), {"dim": "int", "pivot": "int"}, {"q_ids": "<i8", "q_perms": "raw"}, query_rows)
        pairs = packed.join(F.broadcast(sizes), ["dim", "pivot"]).withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).drop("lists").join(files, list(key))
        order = Window.partitionBy("query_id").orderBy("away", "id")
        met = by_footrule(pairs, n_of, prefix, posted, max(per_list, k + 1))
        if places > prefix:  # beyond the prefix no file is the first
            met = met.distinct()
        near = met if most is None else met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
        both = near.join(index.select("id", "ids", "vec"), "id").join(own.select(F.col("id").alias("query_id"), F.col("vec").alias("own")), "query_id")
        distance = F.sqrt(F.aggregate(F.zip_with("vec", "own", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
        rows = both.select("query_id", distance.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        return best_per_query(rows, k, nearest_first=True)

    out = materialize(spark, found(queries, asked), "nearest")
    wide = [dim for dim, n in n_of.items() if n > asked]
    full = out.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = queries.where(F.size("vec").isin(wide)).join(full, "id", "left_anti") if wide else queries.limit(0)
    if short.isEmpty():
        return out
    short = materialize(spark, short, "short-queries")
    return out.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(found(short, n_pivots))
