"""Best-fit packing of documents into fixed-length sequences, improved by a swap-based local search.

Documents longer than a sequence are cut into full pieces (the first may be shorter); every other document is one
piece. Pieces are dealt at random into shards of bounded size, each a fair sample of all lengths. In a shard, pieces go
best-fit, longest first, into bins; then the search takes bins that are not full, emptiest first, and moves pieces out,
exchanges one piece for one shorter, or two for one, wherever that raises the sum of squared fills, until bins are
empty and go. It ends when no bin can be spared or improved; ``steps_per_item`` bounds its effort.

A null text is the empty text (its end id alone). Repeated rows are packed each. A null doc_id stays null. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_bytes, materialize, n_blocks, text_of
from .tokens import as_bytes, encoder

SHARD_PIECES = 50_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than ``capacity``."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with the ids (little-endian unsigned 32-bit) if asked for."""
    data = file_bytes(docs.sparkSession, tokenizer)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(data.value), as_bytes([end_id])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(encode(text) + end, "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + length].tobytes()
                    rows.append((doc_id, k, start, length, zlib.crc32(raw)) + ((raw,) if with_ids else ()))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(made, schema)


class Bins:
    """Bins of one shard: the bin of each item, the items of each bin, and the room in each bin."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = np.asarray(sizes, np.int64).reshape(-1), capacity
        self.items: list[list[int]] = []
        self.bin_of = np.full(len(self.sizes), -1)
        self.room = np.empty(0, np.int64)

    def best_fit(self) -> None:
        """Longest first, each item into the bin with the least room that takes it."""
        free: list[int] = []
        with_room: dict[int, list[int]] = defaultdict(list)
        rooms: list[int] = []  # the different rooms, ascending
        for item in np.argsort(-self.sizes, kind="stable").tolist():
            size, k = int(self.sizes[item]), bisect_left(rooms, int(self.sizes[item]))
            if k < len(rooms):
                b = with_room[rooms[k]].pop()
                if not with_room[rooms[k]]:
                    rooms.pop(k)
            else:
                b = len(self.items)
                self.items.append([])
                free.append(self.capacity)
            self.items[b].append(item)
            self.bin_of[item] = b
            free[b] -= size
            if free[b]:
                if not with_room[free[b]]:
                    insort(rooms, free[b])
                with_room[free[b]].append(b)
        self.room = np.asarray(free, np.int64)

    def put(self, item: int, b: int) -> None:
        a = self.bin_of[item]
        self.items[a].remove(item)
        self.items[b].append(item)
        self.bin_of[item] = b
        self.room[a] += self.sizes[item]
        self.room[b] -= self.sizes[item]

    def improve(self, b: int) -> bool:
        """One step that takes load off bin ``b`` into a bin at least as full, which raises the sum of squared fills: a move, else the
        exchange of one or two items for one shorter that takes most. All items of all bins are looked at."""
        others = (self.room > 0) & (self.room <= self.room[b])
        others[b] = False
        at = np.flatnonzero(others)
        if not len(at):
            return False
        mine = sorted(self.items[b], key=lambda i: (-self.sizes[i], i))
        by_room = at[np.argsort(self.room[at], kind="stable")]
        fits = np.searchsorted(self.room[by_room], self.sizes[mine])
        for item, k in zip(mine, fits):
            if k < len(by_room):
                self.put(item, int(by_room[k]))
                return True
        own = self.sizes[mine]
        first, second = np.triu_indices(len(mine), 1)
        loads = np.concatenate([own, own[first] + own[second]])  # one for one, two for one
        order = np.argsort(loads, kind="stable")
        theirs = np.flatnonzero(others[self.bin_of])
        size = self.sizes[theirs]
        k = np.searchsorted(loads[order], size + self.room[self.bin_of[theirs]], side="right") - 1  # the largest load that fits in place of an item
        gain = np.where(k >= 0, loads[order][k] - size, 0)
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= 0:
            return False
        load, c, item = int(order[k[best]]), int(self.bin_of[theirs[best]]), int(theirs[best])
        out = [mine[load]] if load < len(mine) else [mine[first[load - len(mine)]], mine[second[load - len(mine)]]]
        self.put(item, b)
        for i in out:
            self.put(i, c)
        return True

    def search(self, most_steps: int) -> None:
        """Empties the emptiest bins until there are as few as the items can be in, no bin can be improved, or ``most_steps`` are done.
        Each step raises the sum of squared fills, so it ends in any case."""
        least, stuck = -(-int(self.sizes.sum()) // self.capacity), np.zeros(len(self.room), bool)
        for _ in range(most_steps):
            partial = (self.room > 0) & (self.room < self.capacity) & ~stuck
            if int((self.room < self.capacity).sum()) <= least or not partial.any():
                return
            b = int(np.where(partial, self.room, -1).argmax())
            if not self.improve(b):
                stuck[b] = True
            elif not self.items[b]:
                stuck[:] = False


def pack_sizes(sizes: list[int], capacity: int, steps_per_item: int = 4) -> list[list[int]]:
    """Items of each bin. The steps bound the effort of the search only; every item is packed."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.search(steps_per_item * len(sizes) + 100)
    return [b for b in bins.items if b]


def pack(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to stored ``pieces``."""
    shards = n_blocks(pieces.count(), shard_pieces)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long")).repartition(shards, "shard")

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes, shard = group["length"].to_pylist(), group["shard"][0].as_py()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, items in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = (shard << 32) + k, at
                at += sizes[i]
        return group.drop_columns("shard").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("shard").applyInArrow(packed, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for) of each piece of ``docs``."""
    return pack(materialize(docs.sparkSession, tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity, shard_pieces)
