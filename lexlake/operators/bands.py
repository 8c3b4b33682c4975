"""The most similar items of every item within some days on either side: a band join of vectors.

Dates are cut into buckets as wide as the band, so an item's partners are in its own bucket or in one beside it, and buckets are equi-joined: no cross join
and no range condition on whole tables. A bucket of a group is cut into chunks of at most some ROWS items by hash, and pairs of chunks are the units of work; in a unit, products of whole
chunks are taken as matrices and only the best k of each item leave it. So a bucket that holds a third of all items costs many units, never a large one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions import scalars as S
from lexlake.operators.stored import fresh_dir, store

#: Items of a chunk, about.
ROWS = 512


def chunks(items: DataFrame, days: int, rows: int) -> DataFrame:
    """grp, bucket, chunk, ids, dates, vectors: items (id, grp, day, vec), packed. Items without a date stand in a bucket of their own."""
    placed = items.withColumn("bucket", F.floor(F.unix_date("day") / max(1, days)).cast("long"))
    sizes = placed.groupBy(F.col("grp").alias("g"), F.col("bucket").alias("b")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("chunks"))
    dealt = placed.join(sizes, F.col("grp").eqNullSafe(F.col("g")) & F.col("bucket").eqNullSafe(F.col("b"))).select("grp", "bucket", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.struct("id", F.unix_date("day").alias("day"), "vec").alias("x"))
    packed = dealt.groupBy("grp", "bucket", "chunk").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return packed.select("grp", "bucket", "chunk", F.col("x.id").alias("ids"), F.col("x.day").alias("days"), F.flatten("x.vec").alias("vectors"), F.size(F.get("x.vec", F.lit(0))).alias("dim"))


def best_of_units(units: DataFrame, k: int, days: int, digits: int) -> DataFrame:
    """source_id, id, distance: the k nearest of each item of the first chunk in the second, in order of (rounded distance, id)."""

    def side(batch: pa.RecordBatch, n: int, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, days_, vectors = (batch.column(f"{c}{s}")[n].values for c in ("ids", "days", "vectors"))
        v = vectors.to_numpy().reshape(len(ids), -1)
        return ids.to_numpy(), days_.to_numpy(zero_copy_only=False).astype(float), v / np.maximum(np.sqrt((v**2).sum(1)), 1e-300)[:, None]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                (ids, when, v), (others, then, w) = side(batch, n, ""), side(batch, n, "_y")
                distance = np.round(1 - v @ w.T, digits) + 0.0
                apart = np.abs(when[:, None] - then[None])  # without a date: nan, and then any item will do
                distance[(ids[:, None] == others[None]) | (apart > days) | (np.isnan(then)[None] & ~np.isnan(when)[:, None])] = np.inf
                order = np.lexsort((np.broadcast_to(others, distance.shape), distance), axis=1)[:, :k]
                near = np.take_along_axis(distance, order, 1)
                at = np.isfinite(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], near.shape)[at]), pa.array(others[order][at]), pa.array(near[at])], names=["source_id", "id", "distance"])

    return units.mapInArrow(run, "source_id long, id long, distance double")


def similar_in_band(items: DataFrame, k: int = 5, days: int = 3 * 365, key: str = "id", vector: str = "embedding", date: str = "release_date", group: str | None = None, digits: int = 6, rows: int = ROWS) -> DataFrame:
    """source_id, pos, id, distance, similarity_pct: for each item the k items with the smallest cosine distance, of its group, at most ``days`` before or after it.

    An item without a date has partners of any date, and is none itself for one with a date. Items without a vector, with an empty one or a key of null take no part; a vector of zeros
    is at distance 1 from all. Vectors of different lengths do not meet."""
    spark, usable = items.sparkSession, F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    own = items.where(usable).select(F.col(key).cast("long").alias("id"), F.struct(F.size(vector).alias("dim"), (F.col(group) if group else F.lit(0)).alias("g")).alias("grp"), F.col(date).cast("date").alias("day"), F.transform(vector, lambda x: x.cast("double")).alias("vec"))
    packed = store(chunks(own, days, rows), fresh_dir(spark, "date-bands"))
    dated = packed.where("bucket IS NOT NULL")
    near = dated.withColumn("beside", F.explode(F.array(*[F.col("bucket") + s for s in (-1, 0, 1)])))
    y = packed.select(F.col("grp").alias("grp_y"), F.col("bucket").alias("bucket_y"), F.col("ids").alias("ids_y"), F.col("days").alias("days_y"), F.col("vectors").alias("vectors_y"))
    same = F.col("grp") == F.col("grp_y")
    columns = ["ids", "days", "vectors", "ids_y", "days_y", "vectors_y"]
    units = near.join(y, same & (F.col("beside") == F.col("bucket_y"))).select(*columns).unionByName(packed.where("bucket IS NULL").join(y, same).select(*columns))
    best = best_of_units(units, k, days, digits)
    pos = F.row_number().over(Window.partitionBy("source_id").orderBy("distance", "id"))
    return best.withColumn("pos", pos).where(F.col("pos") <= k).select("source_id", "pos", "id", "distance", S.similarity_percent(F.col("distance")).alias("similarity_pct"))
