"""Token ids in bit-plane files.

Documents are range-sorted by doc_id, encoded once, and written as fixed-size blocks of ids. A block is transposed into
bit planes (or byte planes), each plane is compressed with zstandard, and planes above the block's largest id are left
out. The end of a file holds the chunk index (offset and compressed size of each plane) and the document index.

File: ``BPS1``, planes one after another, a zstandard frame of JSON with the index, its length as 8 bytes
little-endian, ``BPS1``. A file appears under its final name only when whole; a task that runs again writes the same
bytes under the same name.

A null text is the empty text (only the end id). Rows with the same doc_id are all written, ordered by a hash of the text,
so that one id, or null, can go on over several files; a null doc_id sorts first and stays null. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_bytes, fresh_dir, materialize, one_task_each, open_fs, text_of
from .tokens import as_bytes, encoder

MAGIC = b"BPS1"
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long, n_bytes long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first, up to the highest that holds a one."""
    width = 1 if kind == "bit" else 8
    n = -(-max(1, int(ids.max()).bit_length()) // width)
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range(n)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(n)]


def from_planes(planes: list[bytes], size: int, kind: str) -> np.ndarray:
    as_bytes = np.zeros((size, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            as_bytes[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((size, 32), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=size, bitorder="little")
        as_bytes = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(as_bytes).view("<u4").ravel()


class PlaneFile:
    """Writes one file; holds one block of ids at a time."""

    def __init__(self, uri: str, block: int, kind: str):
        self.fs, self.path = open_fs(uri)
        self.block, self.kind, self.uri = block, kind, uri
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path.rpartition('/')[0]}/.tmp-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.at, self.held, self.n_held, self.chunks = len(MAGIC), [], 0, []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.pack = zstandard.ZstdCompressor(level=3)

    def _block(self, ids: np.ndarray) -> None:
        sizes = []
        for plane in to_planes(ids, self.kind):
            packed = self.pack.compress(plane)
            self.out.write(packed)
            sizes.append(len(packed))
        self.chunks.append([self.at, len(ids), sizes])
        self.at += sum(sizes)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._block(flat[k : k + self.block])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def close(self) -> dict:
        if self.n_held:
            self._block(np.concatenate(self.held))
        index = {"kind": self.kind, "block": self.block, "chunks": self.chunks, "doc_ids": self.doc_ids, "lengths": self.lengths}
        packed = self.pack.compress(json.dumps(index).encode())
        self.out.write(packed + len(packed).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return {"file": self.uri, "n_docs": len(self.lengths), "n_tokens": sum(self.lengths), "n_bytes": self.at + len(packed) + 8 + len(MAGIC)}


def read_index(f, size: int) -> dict:
    f.seek(size - 12)
    tail = f.read(12)
    if tail[8:] != MAGIC:
        raise ValueError("not a bit-plane file, or cut off")
    n = int.from_bytes(tail[:8], "little")
    f.seek(size - 12 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(f.read(n)))


def read_blocks(f, index: dict) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    for at, size, sizes in index["chunks"]:
        f.seek(at)
        yield from_planes([unpack.decompress(f.read(n)) for n in sizes], size, index["kind"])


def documents_of(uri: str) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """(doc_id, start in the file, its ids in pieces) for each document of a file, a block in memory at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        index = read_index(f, f.size())
        blocks, left, start = read_blocks(f, index), np.empty(0, np.uint32), 0
        for doc_id, length in zip(index["doc_ids"], index["lengths"]):
            parts, need = [], length
            while need:
                if not len(left):
                    left = next(blocks)
                parts.append(left[:need])
                left = left[len(parts[-1]) :]
                need -= len(parts[-1])
            yield doc_id, start, parts
            start += length


def write_tokens(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = 2, block: int = 65_536, kind: str = "bit", file_tokens: int = 64_000_000) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``out_dir``; returns the manifest, a row per file in order."""
    spark = docs.sparkSession
    data = file_bytes(spark, tokenizer)

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, part, file, rows = encoder(data.value), as_bytes([end_id]), TaskContext.get().partitionId(), None, []

        def done() -> None:
            rows.append({"part": part, "seq": len(rows), **file.close()})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file is None:
                    file = PlaneFile(f"{out_dir}/part-{part:06d}-{len(rows):04d}.bps", block, kind)
                    tokens = 0
                ids = np.frombuffer(encode(text) + end, "<u4")
                file.add(doc_id, ids)
                tokens += len(ids)
                if tokens >= file_tokens:
                    done()
                    file = None
        if file is not None:
            done()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return materialize(spark, ordered.mapInArrow(written, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone. One row per file sets the offsets."""
    order = Window.orderBy("part", "seq")
    base = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "seq", "file", "n_tokens").withColumns({"base": base, "number": F.row_number().over(order) - 1})

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, start, parts in documents_of(file):
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    rows.append((doc_id, base + start, sum(map(len, parts)), crc))
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    spread = one_task_each(files, "number", manifest.count())
    return spread.select("file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_binary(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write below the shared folder and read back."""
    return read_tokens(write_tokens(docs, tokenizer, fresh_dir(docs.sparkSession, "token-binary"), **options))
