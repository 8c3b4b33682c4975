"""Vector codes by product quantisation in whole numbers.

Each component x becomes floor(scale * x); a vector is cut into equal consecutive parts, and each part is replaced by the
index of the nearest entry of its position's codebook. Vectors are stored once as columnar blocks: one row of numbers per
dimension, in the narrowest type that holds them exactly. In each round an RDD treeAggregate goes over the blocks: distances
accumulate dimension by dimension, np.add.at adds the parts to a tensor of sums and one of counts, and these tensors, whose size
is that of the codebooks, merge through a reduction tree. Nothing but the tensors comes to the driver, and blocks are read from
the shared folder each round, so a lost executor costs its tasks only.

Entries start as the parts of the smallest vec_ids; a round assigns each part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replaces each entry by floor(sum / count) of its parts; entries that no part chose stay. Sums and
distances are 64-bit integers where they fit for certain, else Python's integers; an error that is no 64-bit integer raises an
error.

Vectors that are null or hold null or non-finite components take no part, nor do empty ones and those whose length is no
multiple of the number of parts. Each length of vectors has codebooks of its own (so the number of different lengths is taken to be
small). Rows with a null vec_id are coded, but never start an entry; where no vector of a length has an id, there is no codebook and there are no rows. Rows that repeat are coded and counted as often as they
stand there; where rows share a vec_id, the smallest of their vectors starts the entry. With fewer ids than entries the codebooks are as
much smaller. Null labels are one group. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Components of a block, at most.
BLOCK = 1 << 18
#: Labels whose sums are broadcast (some 24 MB), at most; beyond, they are joined in SALTS parts.
MOST_LABELS, SALTS = 1_000_000, 32

Books = dict[int, np.ndarray]
Sums = dict[int, tuple[np.ndarray, np.ndarray]]


def narrowest(values: np.ndarray) -> tuple[str, bytes]:
    """The type and bytes of whole numbers held as doubles."""
    top = np.abs(values).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind, np.ascontiguousarray(values.astype(kind)).tobytes()


def columns_of(dim: int, kind: str, data: bytes) -> np.ndarray:
    """A block as whole numbers, one row per dimension: int64 where sums of squared differences fit, else Python's integers."""
    x = np.frombuffer(data, kind).reshape(dim, -1)
    if 4 * dim * float(np.abs(x.astype("<f8")).max(initial=0)) ** 2 < 2**62:
        return x.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(x.astype("<f8"))


def same_type(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (columns.astype(object), books.astype(object)) if object in (columns.dtype, books.dtype) else (columns, books)


def assigned(columns: np.ndarray, books: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each vector's part, and its squared distance."""
    width = books.shape[2]
    distance = np.zeros((books.shape[1], columns.shape[1]), columns.dtype)
    for k in range(width):
        gap = columns[part * width + k][None, :] - books[part, :, k][:, None]
        distance += gap * gap
    nearest = distance.argmin(axis=0)  # the first of equal ones
    return nearest, distance[nearest, np.arange(len(nearest))]


def added(sums: Sums, block: tuple[int, str, bytes], books: Books) -> Sums:
    """The sums with a block's parts added to the entries that they are nearest to."""
    dim, kind, data = block
    columns, own = same_type(columns_of(dim, kind, data), books[dim])
    parts, entries, width = own.shape
    total, count = sums.get(dim) or (np.zeros(own.shape, columns.dtype), np.zeros((parts, entries), np.int64))
    if total.dtype != columns.dtype:
        total = total.astype(object)
    for part in range(parts):
        nearest, _ = assigned(columns, own, part)
        np.add.at(total[part], nearest, columns[part * width : (part + 1) * width].T)
        np.add.at(count[part], nearest, 1)
    return sums | {dim: (total, count)}


def merged(a: Sums, b: Sums) -> Sums:
    return a | {dim: (a[dim][0] + total, a[dim][1] + count) if dim in a else (total, count) for dim, (total, count) in b.items()}


def moved(books: Books, sums: Sums) -> Books:
    """Entries replaced by the rounded-down means of their parts."""
    out = dict(books)
    for dim, (total, count) in sums.items():
        old, mean = same_type(books[dim], total)
        out[dim] = np.where(count[..., None] > 0, mean // np.maximum(count, 1)[..., None], old)
    return out


def blocks_of(rows: DataFrame) -> DataFrame:
    """dim, kind, data, ids, labels: rows (vec_id, label, dim, vec) packed by their length."""
    label = rows.schema["label"].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                step = max(1, BLOCK // int(dim))
                for s in range(0, mine.num_rows, step):
                    cut = mine.slice(s, step)
                    kind, data = narrowest(cut.column(3).flatten().to_numpy().reshape(-1, dim).T)
                    lists = [pa.ListArray.from_arrays(pa.array([0, cut.num_rows], pa.int32()), pa.concat_arrays([cut.column(k)])) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([kind]), pa.array([data], pa.binary()), *lists], names=["dim", "kind", "data", "ids", "labels"])

    return rows.select("vec_id", "label", "dim", "vec").mapInArrow(pack, f"dim int, kind string, data binary, ids array<bigint>, labels array<{label}>")


def first_entries(rows: DataFrame, blocks: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors of the smallest ids; None where there is no id."""
    ids = [r[0] for r in blocks.where(F.col("dim") == dim).select(F.explode("ids").alias("id")).where("id IS NOT NULL").distinct().orderBy("id").limit(entries).collect()]
    if not ids:
        return None
    found = rows.where((F.col("dim") == dim) & F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id").collect()
    whole = np.array([r.vec for r in found])
    return columns_of(dim, "<f8", np.ascontiguousarray(whole.T).tobytes()).T.reshape(len(ids), parts, dim // parts).transpose(1, 0, 2)


def coded(blocks: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, dim, code, error of each vector."""
    label = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, kind, data = (batch.column(c)[k].as_py() for c in range(3))
                columns, own = same_type(columns_of(dim, kind, data), books[dim])
                found = [assigned(columns, own, part) for part in range(own.shape[0])]
                error = sum(d for _, d in found)
                if max(error.tolist(), default=0) >= 2**63:
                    raise ValueError("an error is no 64-bit integer")
                codes = [row.tobytes() for row in np.stack([c for c, _ in found], axis=1).astype(np.uint8)]
                ids, labels = batch.column(3)[k].values, batch.column(4)[k].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([dim] * len(ids), pa.int32()), pa.array(codes, pa.binary()), pa.array([int(e) for e in error], pa.int64())], names=["vec_id", "label", "dim", "code", "error"])

    return blocks.select("dim", "kind", "data", "ids", "labels").mapInArrow(run, f"vec_id long, label {label}, dim int, code binary, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def label_sums(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the sum of ``error`` over equal labels."""
    spark = rows.sparkSession
    totals = materialize(spark, rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of"))
    if totals.count() <= MOST_LABELS:
        return rows.join(F.broadcast(totals), same).drop("of")
    salted = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("part"))).drop("of", "salt", "part")


def encode(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, depth: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of each row of ``df``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of a part is one byte")
    spark, v = df.sparkSession, F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & ~bad)
    whole = lambda y: F.when(F.abs(y) >= float(2**53), y).otherwise(F.floor(y).cast("double"))
    rows = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.size(v).alias("dim"), F.transform(v, lambda x: whole(x.cast("double") * scale)).alias("vec"))
    rows = rows.where(~F.exists("vec", lambda x: F.abs(x) == float("inf")))
    blocks = materialize(spark, blocks_of(rows), "part-blocks")

    books: Books = {}
    for dim in sorted(r.dim for r in blocks.select("dim").distinct().collect()):
        own = first_entries(rows, blocks, dim, parts, entries)
        if own is not None:
            books[dim] = own
    blocks = blocks.where(F.col("dim").isin(list(books)))
    data = blocks.select("dim", "kind", "data").rdd.map(tuple)
    for _ in range(rounds if books else 0):
        shipped = spark.sparkContext.broadcast(books)
        sums = data.treeAggregate({}, lambda a, block, now=shipped: added(a, block, now.value), merged, depth)
        books = moved(books, sums)
        shipped.unpersist()
    done = materialize(spark, coded(blocks, books), "part-codes")
    name = F.lit(None).cast("string")
    for dim, own in books.items():
        name = F.when(F.col("dim") == dim, digest(own)).otherwise(name)
    return label_sums(done).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", name.alias("codebooks_sha256"))
