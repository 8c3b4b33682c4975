"""Hard negatives: for each anchor and each of its positives, the most similar vectors of other labels in a window below the positive.

Vectors of whole numbers are dealt to k-means clusters (centroids from a bounded sample; every vector is indexed) and stored as
inverted lists, in blocks that carry their radius (largest distance from the centroid) and their range of labels. For a query q, no
product with a vector of a block lies outside q.c - |q| r to q.c + |q| r (Cauchy-Schwarz). Clusters are visited in the order of that upper
bound, in a few waves: those first in the order, then more, then the rest. A block is skipped where its bounds miss the query's window or its
labels cannot serve, and a query stops where the next upper bound falls strictly below its k-th score (equal bounds go on, since ties
go to the smaller vec_id). Inside a task the same rule holds with the scores found so far. What is visited is verified by exact integer products, so the
result is that of a full search.

The same search runs twice: positives are the first ``positives`` other rows of the anchor's label, without a window; then each anchor and
positive is a query over other labels whose window is from ``low``/100 of the positive's score up to it (a window is empty below a score of 0).

Each component is floor(scale * x), an exact integer of any size that a double holds; products are 64-bit integers where they fit for certain, else
Python's integers, and a score among the results that is no 64-bit integer raises an error. Rows with a null label or vec_id, a null or empty vector or a null
or non-finite component (also after scaling) take no part. Vectors meet vectors of the same length only. Rows that repeat count once; rows that share a vec_id
but differ are rows of their own, each an anchor, but never each other's positive or negative. Equal vectors of a label are one entry that keeps
its smallest ids: no more of them can be among the results, so nothing is lost. Equal scores go to the smaller vec_id. An empty table, and a table
of one label, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_blocks
from .topk import scaled

#: Vectors of each length that centroids are fitted on, at most.
SAMPLE = 8_192
#: Centroids of a length, at most, and the numbers that they may hold together (32 MB are shipped).
MOST_CLUSTERS, CENTROID_NUMBERS = 4_096, 1 << 22
#: Blocks whose bounds are shipped (some 10 MB), at most; blocks get larger beyond. Blocks that are compared with a pack at a time.
MOST_BLOCKS, SLICE = 250_000, 1_024
#: In place of an id where an entry has fewer.
NONE = -(2**63)
#: Queries whose best a task holds before it hands them on.
HELD = 50_000
SLACK = 1e-9

Centroids = dict[int, np.ndarray]


def products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer products of integers held as doubles, one row a query."""
    largest = vectors.shape[1] * float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0))
    if largest < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    if largest < 2**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(queries) @ whole(vectors).T


def fitted(sample: np.ndarray, clusters: int, steps: int = 8) -> np.ndarray:
    """Centroids by Lloyd's steps, from rows that are spread over the sample."""
    kept = np.unique(sample, axis=0)
    centroids = kept[np.linspace(0, len(kept) - 1, min(clusters, len(kept))).astype(int)]
    for _ in range(steps):
        near = nearest_centroid(sample, centroids)[0]
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and the distance from it."""
    near = np.argmin((centroids**2).sum(1) - 2 * (vectors @ centroids.T), axis=1)
    return near, np.sqrt(((vectors - centroids[near]) ** 2).sum(1))


def centroids_of(classes: DataFrame) -> Centroids:
    """Centroids of each length of vectors, from a sample by hash; their number grows with the square root of the number of vectors."""
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    out: Centroids = {}
    for dim, n in sizes.items():
        share = min(1.0, 2 * SAMPLE / n)
        hashed = F.pmod(F.xxhash64("vec", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
        rows = classes.where((F.col("dim") == dim) & (hashed < share)).select("vec").orderBy(F.xxhash64("vec", F.lit(7))).limit(SAMPLE).collect()
        sample = np.array([r.vec for r in rows], float)
        most = max(1, min(MOST_CLUSTERS, CENTROID_NUMBERS // dim, round(n**0.5 / 2)))
        out[dim] = fitted(sample, most) if len(sample) else np.zeros((1, dim))
    return out


def dealt_to_clusters(classes: DataFrame, centroids: Centroids) -> DataFrame:
    """``classes`` (dim, label, ids, vec) with cluster and away, the distance from its centroid."""
    schema = classes.select("dim", "label", "ids", "vec").schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                near, away = nearest_centroid(mine.column(3).flatten().to_numpy().reshape(-1, dim), centroids[int(dim)])
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(near, pa.int32()), pa.array(away, pa.float64())], names=[*mine.schema.names, "cluster", "away"])

    return classes.select(*schema.names).mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in schema), "cluster int", "away double"]))


def inverted_lists(placed: DataFrame, n: int, rows: int) -> DataFrame:
    """dim, cluster, radius, low_label, high_label, labels, ids, vectors: blocks of the lists, at most ``rows`` vectors each, in the order of labels."""
    kinds = pa.schema([("dim", pa.int32()), ("cluster", pa.int32()), ("radius", pa.float64()), ("low_label", pa.int64()), ("high_label", pa.int64()), ("labels", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def made(at: tuple[int, int], held: list[tuple]) -> pa.RecordBatch:
        labels, ids, away, vectors = zip(*held)
        row = {"dim": at[0], "cluster": at[1], "radius": max(away), "low_label": labels[0], "high_label": labels[-1]}
        return pa.RecordBatch.from_pylist([row | {"labels": np.asarray(labels, "<i8").tobytes(), "ids": np.asarray(ids, "<i8").tobytes(), "vectors": np.asarray(vectors, "<f8").tobytes()}], schema=kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for dim, cluster, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((dim, cluster) != at or len(held) >= rows):
                    yield made(at, held)
                    held = []
                at = dim, cluster
                held.append(tuple(row))
        if held:
            yield made(at, held)

    order = ["dim", "cluster", "label", F.element_at("ids", 1), "away"]
    ranged = placed.repartitionByRange(n_blocks(n, rows), *order).sortWithinPartitions(*order)
    return ranged.select("dim", "cluster", "label", "ids", "away", "vec").mapInArrow(run, "dim int, cluster int, radius double, low_label long, high_label long, labels binary, ids binary, vectors binary")


class Best:
    """The k best (score, id) of each query that a task has seen."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def kth(self, query: int) -> float:
        own = self.found.get(query, ())
        return own[-1][0] if len(own) == self.k else float("-inf")

    def add(self, query: int, scores: Iterable, ids: np.ndarray, anchor: int) -> None:
        new = [(int(s), int(i)) for s, row in zip(scores, ids) for i in row if i not in (NONE, anchor)]
        if new:
            self.found[query] = sorted({*self.found.get(query, ()), *new}, key=lambda x: (-x[0], x[1]))[: self.k]

    def rows(self) -> pa.RecordBatch:
        out = [(q, i, s) for q, best in self.found.items() for s, i in best]
        if any(not -(2**63) <= s < 2**63 for _, _, s in out):
            raise ValueError("a score is no 64-bit integer")
        self.found = {}
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, names=["query", "vec_id", "score"])


def in_window(scores: np.ndarray, low: int | None, high: int | None, k: int) -> np.ndarray:
    """Places of the k greatest scores from low to high, and of all that equal the last of them."""
    inside = np.flatnonzero((scores >= low) & (scores <= high)) if high is not None else np.arange(len(scores))
    if len(inside) > k:
        own = scores[inside]
        least = sorted(own.tolist(), reverse=True)[k - 1] if own.dtype == object else np.partition(own, len(own) - k)[len(own) - k]
        inside = inside[own >= least]
    return inside


def visited(pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """query, vec_id, score: the k best of each query among the blocks that a task sees."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(c)[n].as_py() for c, name in enumerate(batch.schema.names)}
                dim, labels = row["dim"], np.frombuffer(row["labels"], "<i8")
                ids, vectors = np.frombuffer(row["ids"], "<i8").reshape(len(labels), -1), np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
                keys, bounds = row["queries"], row["bounds"]
                live = [j for j in range(len(keys)) if bounds[j] >= best.kth(keys[j])]
                if not live:
                    continue
                anchors, owner = np.unique(np.array([row["places"][j] for j in live]), return_inverse=True)
                scores = products(vectors, np.frombuffer(row["q_vectors"], "<f8").reshape(-1, dim)[anchors])
                for j, own in zip(live, owner):
                    others = ((ids != NONE) & (ids != row["anchors"][j])).any(axis=1)
                    fits = np.flatnonzero(((labels == row["q_labels"][j]) == same) & others)
                    near = fits[in_window(scores[own][fits], row["lows"][j], row["highs"][j], k)]
                    best.add(keys[j], scores[own][near], ids[near], row["anchors"][j])
                if len(best.found) >= HELD:
                    yield best.rows()
        yield best.rows()

    return pairs.mapInArrow(run, "query long, vec_id long, score long")


PACK = ("queries", "places", "q_labels", "lows", "highs", "anchors")


def packed(queries: DataFrame) -> DataFrame:
    """dim, pack, the columns of PACK and q_vectors: the queries of a pack in one row, each different vector once."""
    kinds = pa.schema([("dim", pa.int32()), ("pack", pa.int64()), *((n, pa.list_(pa.int64())) for n in PACK), ("q_vectors", pa.binary())])

    def made(at: tuple[int, int], held: list[tuple]) -> pa.RecordBatch:
        query, label, low, high, anchor, vec = zip(*held)
        vectors, places = np.unique(np.array(vec, float), axis=0, return_inverse=True)
        row = dict(zip(PACK, (query, places.ravel().tolist(), label, low, high, anchor)))
        return pa.RecordBatch.from_pylist([{"dim": at[0], "pack": at[1], "q_vectors": vectors.astype("<f8").tobytes()} | row], schema=kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for dim, pack, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (dim, pack) != at:
                    yield made(at, held)
                    held = []
                at = dim, pack
                held.append(tuple(row))
        if held:
            yield made(at, held)

    rows = queries.repartition("dim", "pack").sortWithinPartitions("dim", "pack").select("dim", "pack", "query", "label", "low", "high", "anchor", "vec")
    return rows.mapInArrow(run, "dim int, pack long, " + ", ".join(f"{n} array<bigint>" for n in PACK) + ", q_vectors binary")


def planned(packs: DataFrame, directory, start: int, end: int | None, same: bool) -> DataFrame:
    """The visits of a wave: block, pack, and those queries of the pack that look into the block, with their upper bounds.

    ``packs`` has the map kths (query, k-th score). ``directory``: broadcast, for each length the blocks (block, cluster, radius, low label, high label) and the
    centroids. Clusters are ranked by each query's upper bound; the wave has the ranks from ``start`` to ``end``."""
    kinds = pa.schema([("block", pa.int64()), ("pack", pa.int64()), ("bounds", pa.list_(pa.float64())), *((n, pa.list_(pa.int64())) for n in PACK)])
    number = lambda values, missing: np.array([missing if x is None else float(x) for x in values])[:, None]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(c)[n].as_py() for c, name in enumerate(batch.schema.names)}
                (block, cluster, radius, low_label, high_label), c = directory.value[row["dim"]]
                q = np.frombuffer(row["q_vectors"], "<f8").reshape(-1, row["dim"])[row["places"]]
                length, inner, kths = np.sqrt((q**2).sum(1))[:, None], q @ c.T, dict(row["kths"] or ())
                slack = SLACK * (1 + length * (1 + np.sqrt((c**2).sum(1)))[None])
                widest = np.zeros(len(c))
                np.maximum.at(widest, cluster, radius)
                rank = np.argsort(np.argsort(-(inner + length * widest), axis=1, kind="stable"), axis=1)
                label, kth = np.array(row["q_labels"])[:, None], number(map(kths.get, row["queries"]), float("-inf"))
                low, high = number(row["lows"], float("-inf")), number(row["highs"], float("inf"))
                for s in range(0, len(block), SLICE):
                    at = slice(s, s + SLICE)
                    own, reach = cluster[at], length * radius[at][None] * (1 + SLACK)
                    upper, lower = inner[:, own] + reach + slack[:, own], inner[:, own] - reach - slack[:, own]
                    lo, hi = low_label[at][None], high_label[at][None]
                    go = (rank[:, own] >= start) & (rank[:, own] < (end or len(c))) & ((lo <= label) & (label <= hi) if same else (lo != label) | (hi != label))
                    go &= (upper >= kth) & (upper >= low) & (lower <= high)
                    for b in np.flatnonzero(go.any(axis=0)):
                        of = np.flatnonzero(go[:, b]).tolist()
                        yield pa.RecordBatch.from_pylist([{"block": int(block[s + b]), "pack": row["pack"], "bounds": upper[of, b].tolist()} | {name: [row[name][j] for j in of] for name in PACK}], schema=kinds)

    return packs.mapInArrow(run, "block long, pack long, bounds array<double>, " + ", ".join(f"{n} array<bigint>" for n in PACK))


class Index:
    """The stored inverted lists of a table of classes (dim, label, ids, vec)."""

    def __init__(self, classes: DataFrame, block_rows: int):
        spark, n = classes.sparkSession, classes.count()
        centroids = centroids_of(classes)
        lists = inverted_lists(dealt_to_clusters(classes, centroids), n, max(block_rows, -(-n // MOST_BLOCKS)))
        self.lists = materialize(spark, lists.withColumn("block", F.monotonically_increasing_id()), "inverted-lists")
        known = self.lists.select("dim", "block", "cluster", "radius", "low_label", "high_label").orderBy("block").toPandas()
        self.directory = spark.sparkContext.broadcast({int(dim): (tuple(own[c].to_numpy() for c in known.columns[1:]), centroids[int(dim)]) for dim, own in known.groupby("dim")})

    def search(self, queries: DataFrame, k: int, same: bool, waves: tuple[int, ...], pack_rows: int) -> DataFrame:
        """query, rank, vec_id, score: the k best of each of ``queries`` (query, anchor, dim, label, vec, low, high) among the rows of its label (or of all others)."""
        spark = queries.sparkSession
        n = n_blocks(queries.count(), pack_rows)
        packs = materialize(spark, packed(queries.withColumn("pack", F.pmod(F.xxhash64("dim", "anchor", "vec"), F.lit(n)))), "query-packs")
        of = packs.select(F.explode("queries").alias("query"), "pack")
        rank, found, start = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")), None, 0
        for end in (*waves, None):
            now = packs.withColumn("kths", F.lit(None).cast("map<bigint,bigint>"))
            if found is not None:
                kth = found.withColumn("r", rank).where(F.col("r") == k).join(of, "query")
                now = packs.join(kth.groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("query", "score"))).alias("kths")), "pack", "left")
            visits = planned(now.select("dim", "pack", "kths", *PACK, "q_vectors"), self.directory, start, end, same)
            pairs = visits.join(packs.select("pack", "dim", "q_vectors"), "pack").join(self.lists.select("block", "labels", "ids", "vectors"), "block")
            new = visited(pairs, k, same)
            found, start = materialize(spark, new if found is None else found.unionByName(new), "best-so-far"), end
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def mine(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, block_rows: int = 1_024, waves: tuple[int, ...] = (4, 32), pack_rows: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of each row of ``df`` whose vec_id is divisible by ``every``."""
    spark, v = df.sparkSession, F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    rows = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.size(v).alias("dim"), scaled(v, scale).alias("vec")).where(~F.exists("vec", lambda x: F.abs(x) == float("inf")))
    rows = materialize(spark, rows, "labelled-vectors")
    keep = max(positives, negatives) + 1
    w = Window.partitionBy("label", "vec").orderBy("vec_id")
    few = rows.groupBy("dim", "label", "vec", "vec_id").agg(F.lit(1).alias("one")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    ids = F.sort_array(F.collect_list("vec_id"))
    classes = few.groupBy("dim", "label", "vec").agg(F.concat(ids, F.array_repeat(F.lit(NONE), F.lit(keep) - F.size(ids))).alias("ids"))
    index = Index(materialize(spark, classes, "labelled-classes"), block_rows)

    number = F.monotonically_increasing_id().alias("query")
    none = F.lit(None).cast("long")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "vec"]).select(number, F.col("vec_id").alias("anchor"), "dim", "label", "vec", none.alias("low"), none.alias("high"))
    asked = materialize(spark, asked, "anchors")
    near = index.search(asked, positives, True, waves, pack_rows).where("score >= 0")
    least = F.ceil(F.col("score").cast("decimal(20,0)") * low / 100).cast("long")
    pairs = near.select("query", F.col("vec_id").alias("positive_id"), "score").join(asked.drop("low", "high"), "query")
    pairs = materialize(spark, pairs.select(number, "anchor", "dim", "label", "vec", "positive_id", least.alias("low"), F.col("score").alias("high")), "positives")
    found = index.search(pairs, negatives, False, waves, pack_rows)
    named = pairs.select("query", F.col("anchor").alias("anchor_id"), "positive_id", F.col("high").alias("positive_score"))
    return found.join(named, "query").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
