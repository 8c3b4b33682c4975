"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts become sets of ``n`` consecutive words (lower case, letters and digits; a shorter text is one shingle). Texts with
equal sets are one class. Each class has a label of minimum hashes in each tree of the forest, a byte per hash; a tree is
a prefix trie of these labels. Classes that share a prefix of the shortest length that can be needed (``shortest_prefix``)
come together, sorted by their labels, and each is linked to others by the longest prefix that does. Of these links those count
whose labels agree often enough. Starting from whole labels, the matched prefix is then shortened, one byte at a time, until the
links that it leaves out are fewer than the target recall allows; classes that stay connected are a group of candidates. In a
group, all pairs are verified on the whole shingle sets. Nodes and groups of any size are cut into chunks, pairs of chunks are
the units of work, and what leaves a unit is a row for each member (its number of links and its root), never a row for each
pair. Links form groups by connected components.

A word is a run of letters and digits: text in scripts without spaces has few words, and near copies in it are found only where
whole runs are equal.

Rows with a null doc_id or without a word (null, empty, punctuation) have no links and are a class of their own
(class_id is their doc_id). Rows that repeat count as copies. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import discard, fresh_dir, materialize, text_of

TREES, LABEL = 32, 8
#: Most members of a trie node, and of a group of candidates, in one chunk.
NODE, GROUP = 256, 128
#: Parts of a trie node when its members look for its size.
SALTS = 16
WORD = re.compile(r"[^\W_]+")
CACHED_WORDS = 300_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted set of hashed word n-grams."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = mixed(total) + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(total))


def forest_labels(grams: np.ndarray, size: int = TREES * LABEL) -> bytes:
    """A byte of each of ``size`` minimum hashes."""
    rng = np.random.default_rng(20_240_101)
    a, b = rng.integers(0, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, size, np.uint64)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 256):
        np.minimum(least, (grams[k : k + 256, None] * a + b).min(axis=0), out=least)
    return (mixed(least) & np.uint64(255)).astype(np.uint8).tobytes()


def shortest_prefix(threshold: float, recall: float, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    return next((d for d in range(label, 1, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def matched_prefix(links: DataFrame, threshold: float, recall: float, shortest: int) -> int:
    """The longest prefix that keeps ``recall`` of the links (depth, agree) whose labels say that they reach the threshold."""
    seen = {r.depth: r.n for r in links.where(F.col("agree") >= threshold * TREES * LABEL).groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
    every, kept = sum(seen.values()), 0
    for depth in range(LABEL, shortest, -1):
        kept += seen.get(depth, 0)
        if kept >= recall * every:
            return depth
    return shortest


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, set_key (null without words), n_grams, label of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = WordHashes(), {}
        for batch in batches:
            keys, sizes, labels = [], [], []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                row = recent.get((h, len(text)))
                if row is None:
                    grams = shingles(text, n, hashes)
                    row = (xxhash.xxh128_digest(grams.tobytes()), len(grams), forest_labels(grams)) if len(grams) else (None, 0, None)
                    if len(recent) >= 5_000:
                        recent.clear()
                    recent[h, len(text)] = row
                for have, x in zip((keys, sizes, labels), row):
                    have.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(labels, pa.binary())], names=["doc_id", "text_hash", "set_key", "n_grams", "label"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, set_key binary, n_grams int, label binary")


def nodes(classes: DataFrame, depth: int) -> DataFrame:
    """tree, prefix, set_key, label, chunk_a, chunk_b: the members of trie nodes with two classes or more, dealt to pairs of chunks. A node of up to
    NODE members is one chunk, so that most rows stay single; a larger one is cut, and each pair of its chunks is a unit of work.
    A node's size goes to its members in SALTS parts, so that no task reads a large node whole."""
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("label", t * LABEL + 1, F.lit(depth)))
    rows = classes.select("set_key", F.posexplode(prefixes).alias("tree", "prefix"))
    crowded = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = rows.withColumn("salt", F.pmod(F.xxhash64("set_key", F.lit(5)), F.lit(SALTS)).cast("int")).join(crowded, ["tree", "prefix", "salt"]).drop("salt")
    return dealt(kept.join(classes.select("set_key", "label"), "set_key"), F.col("size"), NODE)


def dealt(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """Each row to the pairs of chunks that its chunk is part of."""
    chunks = F.ceil(size / most).cast("int")
    own = rows.withColumns({"chunks": chunks, "own": F.pmod(F.xxhash64("set_key", F.lit(3)), chunks).cast("int")})
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"chunk_a": F.least("own", "other"), "chunk_b": F.greatest("own", "other")}).drop("other", "chunks")


def groups_of(batches: Iterable[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches; a run may go on over batches. Several small runs come in one table, each whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(batch.schema.get_field_index(k)) for k in key]
        last = [c[batch.num_rows - 1] for c in ids]
        cut = batch.num_rows
        while cut and all(c[cut - 1] == v for c, v in zip(ids, last)):
            cut -= 1
        if held:
            tail = [held[-1].column(held[-1].schema.get_field_index(k))[held[-1].num_rows - 1] for k in key]
            if cut or any(c[0] != v for c, v in zip(ids, tail)):
                if cut:
                    first = 0
                    while first < cut and all(c[first] == v for c, v in zip(ids, tail)):
                        first += 1
                    if first:
                        held.append(batch.slice(0, first))
                    yield pa.Table.from_batches(held)
                    if cut > first:
                        yield pa.Table.from_batches([batch.slice(first, cut - first)])
                else:
                    yield pa.Table.from_batches(held)
                held = [batch.slice(cut)]
                continue
            held.append(batch)
            continue
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def runs(table: pa.Table, key: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """(start, stop) of each run of equal keys."""
    columns = [table[k].to_pylist() for k in key]
    rows = list(zip(*columns))
    start = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k] != rows[start]:
            yield start, k
            start = k


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric boolean matrix is connected to."""
    n = len(linked)
    root = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, root[None, :], n).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def agreement(labels: np.ndarray) -> np.ndarray:
    """In how many bytes each pair of labels agrees; 0 with itself."""
    out = np.zeros((len(labels), len(labels)), np.int16)
    for k in range(len(labels) - 1):
        out[k, k + 1 :] = (labels[k + 1 :] == labels[k]).sum(axis=1)
    return out + out.T


def common_prefix(labels: np.ndarray) -> np.ndarray:
    """Bytes that each pair of labels of one tree shares from the start."""
    return np.cumprod(labels[:, None] == labels[None], axis=2, dtype=np.int8).sum(axis=2)


def label_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def least_agreement(threshold: float, hashes: int = TREES * LABEL) -> int:
    """Five standard deviations below the share of equal bytes at the threshold."""
    return int(hashes * (threshold - 5 * (threshold * (1 - threshold) / hashes) ** 0.5))


def candidate_links(members: DataFrame, threshold: float, shortest: int) -> DataFrame:
    """a, b, depth, agree: links that connect the classes of a node whose labels agree enough, each by the longest prefix that
    connects it, no more of them than members."""
    least, key = least_agreement(threshold), ("tree", "prefix", "chunk_a", "chunk_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, key):
            keys, labels = table["set_key"].to_pylist(), label_matrix(table["label"])
            own = labels.reshape(len(labels), TREES, LABEL)[np.arange(len(labels)), table["tree"].to_numpy()]
            spans, out = list(runs(table, key)), []
            twos = np.array([s for s, e in spans if e - s == 2], int)
            if len(twos):
                agree, depth = (labels[twos] == labels[twos + 1]).sum(axis=1), np.cumprod(own[twos] == own[twos + 1], axis=1).sum(axis=1)
                out += [(keys[s], keys[s + 1], d, a) for s, d, a in zip(twos.tolist(), depth.tolist(), agree.tolist()) if a >= least]
            for s, e in spans:
                if e - s <= 2:
                    continue
                agree, shared, before = agreement(labels[s:e]), common_prefix(own[s:e]), np.arange(e - s)
                for depth in range(LABEL, shortest - 1, -1):
                    linked = (agree >= least) & (shared >= depth)
                    now = roots(linked)
                    for k in np.flatnonzero((now != before) & (before == np.arange(e - s))).tolist():
                        out.append((keys[s + k], keys[s + now[k]], depth, int(np.where(linked[k], agree[k], 0).max()) or least))
                    before = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int32(), pa.int32()))], names=["a", "b", "depth", "agree"])

    own = members.withColumn("own", F.substring("label", F.col("tree") * LABEL + 1, F.lit(LABEL)))
    ordered = own.repartition(*key).sortWithinPartitions(*key, "own").select(*key, "set_key", "label")  # a sorted trie in each unit
    found = ordered.mapInArrow(run, "a binary, b binary, depth int, agree int")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("depth").alias("depth"), F.max("agree").alias("agree"))


def shingle_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """set_key, grams (sorted hashes) of the classes in ``members``, each set once, from the text of the class's representative."""

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = shingles(text, n, hashes).tobytes()
                if xxhash.xxh128_digest(g) == k:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.binary()), pa.array([g], pa.binary())], names=["set_key", "grams"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    own = members.select("set_key", "rep", "text_hash").distinct()
    made = texts.join(own, ["rep", "text_hash"]).dropDuplicates(["set_key", "rep", "text_hash"]).select("set_key", "text").mapInArrow(grams, "set_key binary, grams binary")
    return made.dropDuplicates(["set_key"])


def verified(sets: DataFrame, members: DataFrame, threshold: float, pairs: bool = False) -> DataFrame:
    """Exact links inside the groups of candidates (root, set_key, label, copies, chunk_a, chunk_b, own), from the sets of their classes.

    By member and pair of chunks: key, root (of its links there), near (documents of other sets that it is linked to). Each pair of classes meets in one pair of
    chunks. With ``pairs``: a row for each link instead."""
    key, least = ("root", "chunk_a", "chunk_b"), least_agreement(threshold)

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, key):
            labels, sets, keys = label_matrix(table["label"]), [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()], table["set_key"].to_pylist()
            owns, copies, chunk_a, chunk_b = (table[c].to_pylist() for c in ("own", "copies", "chunk_a", "chunk_b"))
            out: list[tuple] = []
            for s, e in runs(table, key):
                at = sorted(range(s, e), key=lambda k: keys[k])
                near = agreement(labels[at]) >= least
                linked = np.zeros_like(near)
                for i, j in zip(*np.nonzero(np.triu(near))):
                    x, y = sets[at[i]], sets[at[j]]
                    if chunk_a[s] != chunk_b[s] and owns[at[i]] == owns[at[j]] or min(len(x), len(y)) < threshold * max(len(x), len(y)):
                        continue  # of one chunk: they meet where that chunk meets itself
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if common >= threshold * (len(x) + len(y) - common):
                        linked[i, j] = linked[j, i] = True
                        if pairs:
                            out.append((keys[at[i]], keys[at[j]], common / (len(x) + len(y) - common)))
                if not pairs and linked.any():
                    weight = linked @ np.array([copies[k] for k in at])
                    out += [(keys[at[i]], keys[at[r]], int(weight[i])) for i, r in enumerate(roots(linked)) if weight[i]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.float64() if pairs else pa.int64()))], names=["a", "b", "jaccard"] if pairs else ["key", "root", "near"])

    rows = members.join(sets, "set_key").select("set_key", "root", "chunk_a", "chunk_b", "own", "copies", "label", "grams")
    ordered = rows.repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(verify, "a binary, b binary, jaccard double" if pairs else "key binary, root binary, near long")


def components(spark, links: DataFrame) -> DataFrame:
    """key, root: the smallest key that each key of ``links`` (a, b) is connected to, by alternating large and small stars.

    The least neighbours are stored before the join that meets hubs, so that both of its sides are read from a shuffle and adaptive execution
    can split a hub that many rows name. Tables that a later round replaces are deleted."""
    stored: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        stored.append(fresh_dir(spark, name))
        return materialize(spark, df, name, stored[-1])

    edges, before = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before, old = tuple(now), stored[:]
        both = edges.union(edges.select("v", "u"))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # the larger end of an edge is no hub: after the large stars it has few neighbours
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        edges = kept(small, "stars")
        for path in old:
            discard(spark, path)
            stored.remove(path)


class Join:
    """The join of a table of documents with itself: ``rows``, ``classes``, ``members`` of the groups of candidates and their ``found`` links, each stored once."""

    def __init__(self, docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999):
        spark = docs.sparkSession
        self.threshold = threshold
        self.rows = materialize(spark, sketches(docs, n), "sketches")
        usable = self.rows.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
        first = F.min(F.struct("doc_id", "text_hash"))
        classes = usable.groupBy("set_key").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"))  # equal sets have equal labels
        self.classes = materialize(spark, classes.select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "copies", "label"), "classes")
        shortest = shortest_prefix(threshold, recall)
        links = materialize(spark, candidate_links(nodes(self.classes, shortest), threshold, shortest), "candidate-links")
        self.depth = matched_prefix(links, threshold, recall, shortest)
        groups = materialize(spark, components(spark, links.where(F.col("depth") >= self.depth)), "candidate-groups")
        sizes = materialize(spark, groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
        grouped = groups.join(sizes, "root").withColumnRenamed("key", "set_key").join(self.classes, "set_key")
        self.members = materialize(spark, dealt(grouped, F.col("size"), GROUP), "candidate-members")
        self.sets = materialize(spark, shingle_sets(docs, self.members, n), "shingle-sets")
        self.found = materialize(spark, verified(self.sets, self.members, threshold), "links")

    def link_pairs(self) -> DataFrame:
        """doc_a, doc_b, jaccard between the representatives of classes with different sets."""
        name = lambda s: self.classes.select(F.col("set_key").alias(s), F.col("rep").alias(f"doc_{s}"))
        return verified(self.sets, self.members, self.threshold, pairs=True).join(name("a"), "a").join(name("b"), "b").select("doc_a", "doc_b", "jaccard")

    def linked(self) -> DataFrame:
        """doc_id, text_hash, class_id (smallest doc_id of the group), set_id (smallest doc_id with an equal set), n_links."""
        near = self.found.groupBy("key").agg(F.sum("near").alias("near"), F.min("root").alias("root"), F.count(F.lit(1)).alias("parts"))
        # a class with links in one pair of chunks has its group's root there; only groups that were cut are joined across their chunks
        cut = near.where("parts > 1").limit(1).count()
        if cut:
            joined = components(self.rows.sparkSession, self.found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
            near = near.drop("root").join(joined, "key", "left")
        own = self.classes.select(F.col("set_key").alias("key"), "rep", "copies").join(near, "key", "left")
        own = own.withColumns({"root": F.coalesce("root", "key"), "n_links": F.col("copies") - 1 + F.coalesce("near", F.lit(0))})
        own = materialize(self.rows.sparkSession, own, "class-roots")
        names = materialize(self.rows.sparkSession, own.groupBy("root").agg(F.min("rep").alias("class_id")), "group-names")
        named = own.join(names, "root").select(F.col("key").alias("set_key"), "class_id", F.col("rep").alias("set_id"), "n_links")
        rows = self.rows.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
        return rows.select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, set_id, n_links of each row of ``docs`` (doc_id, text)."""
    return Join(docs, **options).linked().drop("text_hash")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when each group keeps the row of its smallest doc_id (one row of it)."""
    members = Join(docs, **options).linked()
    alone = members.where(F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("class_id")) & (F.col("n_links") == 0)))
    first = members.where((F.col("doc_id") == F.col("class_id")) & (F.col("n_links") > 0)).groupBy("class_id").agg(F.min("text_hash").alias("text_hash"))
    stays = alone.select("doc_id", "text_hash", F.lit(False).alias("once")).distinct().unionByName(first.select(F.col("class_id").alias("doc_id"), "text_hash", F.lit(True).alias("once")))
    key = [F.col("doc_id").cast("long").alias("#doc_id"), F.xxhash64(text_of()).alias("#text_hash")]
    kept = docs.select("*", *key).join(stays.select(F.col("doc_id").alias("#d"), F.col("text_hash").alias("#t"), F.col("once").alias("#once")), F.col("#doc_id").eqNullSafe(F.col("#d")) & (F.col("#text_hash") == F.col("#t")))
    ties = F.xxhash64(*[c for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)])
    rank = F.row_number().over(Window.partitionBy("#doc_id", "#text_hash").orderBy(ties))
    once = kept.where("`#once`").withColumn("#rank", rank).where(F.col("#rank") == 1)
    return kept.where("not `#once`").select(*docs.columns).unionByName(once.select(*docs.columns))
