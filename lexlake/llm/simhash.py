"""SimHash near duplicates by a Gray-order hierarchical index.

A text's letters A-Z are lower-cased; its words are runs of bytes that are no ASCII white space, its shingles three consecutive words
joined by a space, repeats included (a shorter text is one shingle). A shingle's hash is XXH64 of its UTF-8 bytes with seed 42; a bit of
the fingerprint is 1 where more than half of the hashes have it. A text without words has fingerprint zero, linked like any other.
Texts of any length are read in windows.

Fingerprints that differ in at most ``reach`` bits agree in one of ``reach`` + 1 equal parts of their bits. Each part is a mask of the upper
nodes: a different fingerprint stands once under each mask, in the node of its bits there. Under a mask fingerprints are sorted by their rank in
Gray order, the masked part leading, so that a node is a run of the order, and runs of near ranks share further bits. Runs are cut into leaves, and each node above
keeps the bits that all below it have (``ones``) and those that any has (``any``). The differences of two nodes accumulate in the
bits that one has and the other never has: beyond ``reach``, the two groups are pruned whole. Nodes of one leaf are
searched where they were sorted; of larger ones, pairs of leaves are found by a level of upper nodes that Spark joins, and each pair is a unit of
work. What leaves a unit is a link for each member (to the first of its group there), never a row for each pair. Links form components.

Rows with a null doc_id take part and are returned; a component's id is the smallest doc_id in it (null, if it has none). Null
texts have no words. Rows that repeat are returned as often as they stand there. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_blocks
from .ngram_join import components

SEED = 42
#: Bytes of a text that are read at a time; hashes that are counted at a time.
WINDOW, HASHES = 1 << 20, 1 << 14
#: Fingerprints of a leaf, at most; children of a node in the search of a leaf; leaves of an upper node; rows of a sorted partition.
LEAF, FAN, UPPER, SORTED = 1_024, 8, 64, 200_000
#: Runs up to this length are compared directly.
SMALL = 32
SPACE = re.compile(rb"[\x20\x09-\x0D]")
U = np.uint64


def words_in_windows(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; no word is cut."""
    at = 0
    while at < len(data):
        cut = SPACE.search(data, at + WINDOW)
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def fingerprint(data: bytes, n: int = 3) -> int:
    """The fingerprint of a text, as a signed 64-bit integer."""
    ones, total, carried, whole = np.zeros(64, np.int64), 0, [], True

    def count(shingles: list[bytes]) -> None:
        nonlocal total
        for s in range(0, len(shingles), HASHES):
            h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles[s : s + HASHES]), U, len(shingles[s : s + HASHES]))
            ones.__iadd__(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64))
            total += len(h)

    for words in words_in_windows(data):
        words = carried + words
        if len(words) >= n:
            count([b" ".join(x) for x in zip(*(words[k:] for k in range(n)))])
            whole = False
        carried = words[-(n - 1) :] if n > 1 else []
    if whole and carried:
        count([b" ".join(carried)])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fingerprint (a long) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x, n) for x in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def under_masks(codes: DataFrame, reach: int) -> DataFrame:
    """mask, rank: each code (fingerprint) under each mask, by its Gray rank with the masked part leading."""
    width = 64 // (reach + 1)
    turned = [gray_rank(F.shiftleft("fingerprint", k * width).bitwiseOR(F.shiftrightunsigned("fingerprint", 64 - k * width)) if k else F.col("fingerprint")) for k in range(reach + 1)]
    return codes.select(F.posexplode(F.array(*turned)).alias("mask", "rank"))


def turned_code(rank: np.ndarray) -> np.ndarray:
    r = rank.view(U)
    return r ^ (r >> U(1))


def turned_back(code: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    by = np.asarray(by, U)
    return np.where(by == 0, code, (code >> by) | (code << ((U(64) - by) & U(63)))).view(np.int64)


def near_pairs(x: np.ndarray, y: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i in x and j in y (both in Gray order) of the codes that differ in at most ``reach`` bits.

    Nodes of FAN children are built over both; pairs of nodes go down together, and a pair ends where its differences exceed ``reach``."""
    levels = []
    for codes in (x, y):
        ones, some, own = codes, codes, [(codes, codes)]
        while len(ones) > 1:
            at = np.arange(0, len(ones), FAN)
            ones, some = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)
            own.append((ones, some))
        levels.append(own)
    i = j = np.zeros(1, np.int64)
    for depth in range(max(map(len, levels)) - 1, -1, -1):
        (a1, a2), (b1, b2) = (own[min(depth, len(own) - 1)] for own in levels)
        apart = np.bitwise_count((a1[i] & ~b2[j]) | (b1[j] & ~a2[i]))
        i, j = i[apart <= reach], j[apart <= reach]
        if depth:
            for own, first in zip(levels, (True, False)):
                if depth < len(own):
                    below = len(own[depth - 1][0])
                    at = (i if first else j)[:, None] * FAN + np.arange(FAN)
                    keep = at < below
                    other = np.repeat((j if first else i)[:, None], FAN, axis=1)[keep]
                    i, j = (at[keep], other) if first else (other, at[keep])
    return i, j


def firsts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected to by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        for end in (root[i], root[j], i, j):
            np.minimum.at(root, end, least)
        root = root[root]
        if (root == before).all():
            return root


def linked(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link for each code that is connected to an earlier one."""
    root = firsts(len(codes), i, j)
    at = np.flatnonzero(root != np.arange(len(codes)))
    return codes[at], codes[root[at]]


def searched(sorted_codes: DataFrame, reach: int) -> DataFrame:
    """Two kinds of rows from each sorted partition: links (a, b) inside nodes of one leaf, and the leaves (mask, part, leaf, ones, some, codes) of nodes that
    are larger or reach a border of the partition."""
    width = 64 // (reach + 1)
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int32()), ("part", pa.int64()), ("leaf", pa.int64()), ("ones", pa.int64()), ("some", pa.int64()), ("codes", pa.binary())])

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), f.type) for f in list(kinds)[2:])], schema=kinds)

    def leaves(mask: int, part: int, codes: np.ndarray, number: int) -> pa.RecordBatch:
        rows = []
        for k, s in enumerate(range(0, len(codes), LEAF)):
            own = codes[s : s + LEAF]
            ones, some = (int(f.reduce(own).view(np.int64)) for f in (np.bitwise_and, np.bitwise_or))
            rows.append({"mask": mask, "part": part, "leaf": number + k, "ones": ones, "some": some, "codes": own.astype("<u8").tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema=kinds)

    def inside(mask: np.ndarray, code: np.ndarray, node: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole nodes; ``node`` numbers the runs."""
        size = np.diff(np.append(start, len(code)))
        small = np.repeat(size <= SMALL, size)
        own, of, turn = code[small], node[small], mask[small] * width
        i, j = [], []
        for step in range(1, min(SMALL, int(size[size <= SMALL].max(initial=1)))):
            near = np.flatnonzero((of[step:] == of[:-step]) & (np.bitwise_count(own[step:] ^ own[:-step]) <= reach))
            i.append(near)
            j.append(near + step)
        if i and sum(map(len, i)):
            yield links(*linked(turned_back(own, turn), np.concatenate(i), np.concatenate(j)))
        for k in np.flatnonzero(size > SMALL):
            own = code[start[k] : start[k] + size[k]]
            i, j = near_pairs(own, own, reach)
            a, b = linked(turned_back(own, mask[start[k]] * width), i, j)
            if len(a):
                yield links(a, b)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not columns:
            return
        mask, code = (np.concatenate(c) for c in zip(*columns))
        mask, code = mask.astype(np.int64), turned_code(code)
        part = (code >> U(64 - width)).view(np.int64)
        start = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])))
        size, number = np.diff(np.append(start, len(code))), 0
        handed = (size > LEAF) | np.isin(np.arange(len(size)), (0, len(size) - 1))  # the other end of a run at a border may be in another partition
        for k in np.flatnonzero(handed):
            s = start[k]
            yield (out := leaves(int(mask[s]), int(part[s]), code[s : s + size[k]], number))
            number += out.num_rows
        kept = np.repeat(~handed, size)
        node = np.repeat(np.arange(len(size)), size)[kept]
        if len(node):
            yield from inside(mask[kept], code[kept], node, np.flatnonzero(np.append(True, node[1:] != node[:-1])))

    found = sorted_codes.mapInArrow(run, "a long, b long, mask int, part long, leaf long, ones long, some long, codes binary")
    return found.withColumn("leaf", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("leaf"))


def near_nodes(x: DataFrame, y: DataFrame, on: list[str], name: str, reach: int) -> DataFrame:
    """Pairs of nodes (``name`` and ``name``_y, the former no later) whose differences do not exceed ``reach``."""
    other = y.select(*on, *[F.col(c).alias(f"{c}_y") for c in (name, "ones", "some")])
    apart = lambda a, b: F.col(f"ones{a}").bitwiseAND(F.bitwise_not(F.col(f"some{b}")))
    near = F.bit_count(apart("", "_y").bitwiseOR(apart("_y", ""))) <= reach
    return x.join(other, on).where((F.col(name) <= F.col(f"{name}_y")) & near)


def across_leaves(leaves: DataFrame, reach: int) -> DataFrame:
    """Links (a, b) of nodes of several leaves: pairs of upper nodes, then of leaves, then of their codes."""
    width = 64 // (reach + 1)
    slim = leaves.select("mask", "part", "leaf", "ones", "some", F.shiftright("leaf", UPPER.bit_length() - 1).alias("upper"))
    upper = slim.groupBy("mask", "part", "upper").agg(F.bit_and("ones").alias("ones"), F.bit_or("some").alias("some"))
    pairs = near_nodes(upper, upper, ["mask", "part"], "upper", reach).select("mask", "part", "upper", "upper_y")
    first = pairs.join(slim, ["mask", "part", "upper"]).drop("upper").withColumnRenamed("upper_y", "upper")
    units = near_nodes(first, slim, ["mask", "part", "upper"], "leaf", reach).select("mask", "leaf", "leaf_y")
    units = units.join(leaves.select("leaf", "codes"), "leaf").join(leaves.select(F.col("leaf").alias("leaf_y"), F.col("codes").alias("codes_y")), "leaf_y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mask, x, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                i, j = near_pairs(x, y, reach)
                a, b = linked(turned_back(np.concatenate([x, y]), mask * width), i, j + len(x)) if len(i) else (i, j)
                same = a == b  # of a leaf with itself
                if not same.all():
                    yield pa.RecordBatch.from_arrays([pa.array(a[~same], pa.int64()), pa.array(b[~same], pa.int64())], names=["a", "b"])

    return units.select("mask", "codes", "codes_y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, reach: int = 3, n: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs`` (doc_id, text)."""
    if not 0 <= reach < 32:
        raise ValueError("a mask needs two bits or more")
    spark = docs.sparkSession
    rows = materialize(spark, fingerprints(docs, n), "fingerprints")
    codes = materialize(spark, rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "different-fingerprints")
    parts = n_blocks(codes.count() * (reach + 1), SORTED)
    ordered = under_masks(codes, reach).repartitionByRange(parts, "mask", "rank").sortWithinPartitions("mask", "rank")
    found = materialize(spark, searched(ordered, reach), "gray-leaves")
    links = found.where("a IS NOT NULL").select("a", "b").union(across_leaves(found.where("codes IS NOT NULL"), reach))
    joined = components(spark, materialize(spark, links.distinct(), "fingerprint-links"))
    own = codes.join(joined.select(F.col("key").alias("fingerprint"), "root"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    own = materialize(spark, own, "fingerprint-roots")
    names = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fingerprint", "component_id")
    return rows.join(names, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
