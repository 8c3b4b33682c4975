"""Deterministic sharded WARC writer and reader.

Records are range-dealt by (page_id, digest) into shards of about ``shard_bytes``. The borders follow from sums of bytes over the
table in that order, so the same table always makes the same shards, and neither far ids nor an id or null that many rows
hold make a large one. A task sorts one shard, regenerates headers and digests, and rolls to the next file when the
compressed size passes ``file_bytes``. A file begins with a warcinfo record; every record is a gzip member of its own. A file is
written under a temporary name and renamed when whole; the manifest (JSON lines: file, records, bytes, SHA-256) is written
by Spark beside its final name and renamed last. A task that runs again writes the same bytes under the same names.

Equal payloads of at least ``least`` bytes: the record with the smallest page_id is the response, the others are
revisits that refer to it. A null page is the empty payload. Rows that repeat a page_id are written each, ordered
by digest and url; of those that share the smallest page_id and the payload, the first stays the response (such rows stand in
one shard). Rows with a null page_id are written as responses of their own, before the others. An empty table makes no files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, materialize, one_task_each, open_fs

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of WARC 1.1
MANIFEST = "shard int, seq int, file string, n_records long, n_bytes long, sha256 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, file_offset long"
#: Shards get larger than ``shard_bytes`` where there would be more of them.
MOST_SHARDS = 100_000
LOWEST = -(2**63)


def place() -> list[Column]:
    """A row's place in the order of shards: its id, null first, and the first 48 bits of its digest."""
    return [F.coalesce("page_id", F.lit(LOWEST)).alias("at_id"), F.conv(F.substring("digest", 1, 12), 16, 10).cast("long").alias("at_digest")]


def payload_rows(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def with_roles(rows: DataFrame, slim: DataFrame, least: int = 100) -> DataFrame:
    """Rows to write (is_role 0) and, for payloads that occur more than once, rows (is_role 1) with the page_id and url of the
    response. Roles are found on digests alone; payloads are shuffled once, with the roles beside them."""
    known = slim.where((F.col("n") >= least) & F.col("page_id").isNotNull())
    first = known.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    roles = known.select("page_id", "digest").distinct().join(first, "digest").select("page_id", F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first", F.lit(1).alias("is_role"))
    return rows.withColumns({"first": F.lit(None).cast("struct<page_id:bigint,url:string>"), "is_role": F.lit(0)}).unionByName(roles)


def shard_borders(slim: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """The place of the first row of each shard after the first; one row for each of at most MOST_SHARDS shards is collected."""
    spark = slim.sparkSession
    size = (F.col("n") + 300).alias("n")  # with its headers
    ordered = slim.select(*place(), size).repartitionByRange("at_id", "at_digest", "n").withColumn("part", F.spark_partition_id())
    ordered = materialize(spark, ordered, "places")
    parts = ordered.groupBy("part").agg(F.sum("n").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0)))
    total = parts.agg(F.sum("all")).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("at_id", "at_digest", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shard = F.floor((F.col("before") + F.col("inside")) / shard_bytes)
    firsts = ordered.withColumn("inside", inside).join(parts, "part").groupBy(shard.alias("shard")).agg(F.min(F.struct("at_id", "at_digest")).alias("first"))
    return sorted({tuple(r["first"]) for r in firsts.where("shard > 0").collect()})


def shard_of(borders: list[tuple[int, int]]) -> Column:
    """How many borders are at or below a row's place, by halving."""
    if not borders:
        return F.lit(0)
    ids, digests = (F.expr(f"cast(split('{','.join(str(b[k]) for b in borders)}', ',') as array<bigint>)") for k in (0, 1))
    steps = F.lit([1 << k for k in reversed(range(len(borders).bit_length()))])
    at_id, at_digest = place()

    def step(at: Column, size: Column) -> Column:
        i, d = F.get(ids, at + size - 1), F.get(digests, at + size - 1)
        return F.when((i < at_id) | ((i == at_id) & (d <= at_digest)), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def record_id(page_id: int | None, url: str, digest: str, extra: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url} {digest} {extra}')}>"


def labelled_digest(raw: bytes) -> str:
    return "sha256:" + base64.b32encode(raw).decode()


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, first: dict | None, date: str, extra: str = "") -> bytes:
    """A WARC/1.1 record; for revisits the block is the HTTP header alone, and ``first`` is the page_id and url of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = lambda name, url: [f"{name}: {' '.join(url.split())}"] if url.strip() else []
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest, extra)}", f"WARC-Date: {date}", *target("WARC-Target-URI", url)]
    lines += [f"WARC-Payload-Digest: {labelled_digest(bytes.fromhex(digest))}", f"WARC-Block-Digest: {labelled_digest(hashlib.sha256(block).digest())}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first['page_id'], first['url'], digest)}", *target("WARC-Refers-To-Target-URI", first["url"]), f"WARC-Refers-To-Date: {date}", f"X-Page-Refers-To: {first['page_id']}"]
    lines += [f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Page-URL: {json.dumps(url)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str, date: str) -> bytes:
    block = b"software: lexlake\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name, '')}", f"WARC-Date: {date}", f"WARC-Filename: {name}", f"WARC-Block-Digest: {labelled_digest(hashlib.sha256(block).digest())}"]
    return "\r\n".join([*lines, "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member without a time in its header."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class ShardFile:
    def __init__(self, uri: str, date: str):
        self.fs, self.path = open_fs(uri)
        self.uri, self.n, self.size, self.sha = uri, -1, 0, hashlib.sha256()  # warcinfo is not counted
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path.rpartition('/')[0]}/.tmp-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.add(warcinfo(uri.rpartition("/")[2], date))

    def add(self, raw: bytes) -> None:
        packed = member(raw)
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.n += 1

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return {"file": self.uri, "n_records": self.n, "n_bytes": self.size, "sha256": self.sha.hexdigest()}


def write_warc(pages: DataFrame, out_dir: str, least: int = 100, shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``out_dir``; returns the manifest, which is committed there last."""
    spark = pages.sparkSession
    rows = payload_rows(pages)
    slim = materialize(spark, rows.select("page_id", "url", "digest", F.length("payload").cast("long").alias("n")), "digests")
    borders = shard_borders(slim, shard_bytes)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, shard, seq, done, seen, last, role, answered = None, None, 0, [], 0, None, None, False

        def finish() -> None:
            done.append({"shard": shard, "seq": seq, **file.close()})

        for batch in batches:
            for number, page_id, url, payload, digest, first, is_role in zip(*(c.to_pylist() for c in batch.columns)):
                if is_role:
                    role, answered = (page_id, digest, first), False
                    continue
                if file is not None and (number != shard or file.size >= file_bytes):
                    finish()
                    file, seq = None, seq + 1 if number == shard else 0
                if file is None:
                    shard = number
                    file = ShardFile(f"{out_dir}/shard-{number:06d}-{seq:04d}.warc.gz", date)
                response = None
                if role and role[:2] == (page_id, digest) and page_id is not None:
                    response = role[2] if page_id > role[2]["page_id"] or answered else None
                    answered = True
                seen = seen + 1 if last == (page_id, url, digest) else 0
                last = (page_id, url, digest)
                file.add(record("response" if response is None else "revisit", page_id, url, payload, digest, response, date, str(seen or "")))
        if file is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    dealt = with_roles(rows, slim, least).withColumn("shard", shard_of(borders).cast("int")).select("shard", "page_id", "url", "payload", "digest", "first", "is_role")
    ordered = one_task_each(dealt, "shard", len(borders) + 1).sortWithinPartitions("shard", "page_id", "digest", F.desc("is_role"), "url")
    manifest = materialize(spark, ordered.mapInArrow(write, MANIFEST), "warc-manifest")
    commit(manifest, out_dir)
    return manifest


def commit(manifest: DataFrame, out_dir: str) -> None:
    """The folder "manifest": JSON lines, one per file, in order; a reader takes only the files that it names."""
    manifest.orderBy("shard", "seq").write.json(f"{out_dir}/.tmp-manifest")
    fs, path = open_fs(out_dir)
    fs.move(f"{path}/.tmp-manifest", f"{path}/manifest")


def members(f) -> Iterator[tuple[int, bytes]]:
    """(offset, record) for each gzip member of a file, a chunk in memory at a time."""
    unpack, parts, start, at = zlib.decompressobj(31), [], 0, 0
    while chunk := f.read(1 << 20):
        while chunk:
            parts.append(unpack.decompress(chunk))
            used = len(chunk) - len(unpack.unused_data)
            at += used
            if not unpack.eof:
                break
            yield start, b"".join(parts)
            chunk, parts, start, unpack = unpack.unused_data, [], at, zlib.decompressobj(31)
    if any(parts):
        raise ValueError("the file ends within a record")


def parse(raw: bytes) -> dict:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in io.BytesIO(http) if x.startswith(b"Content-Length:")).split(b":")[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha256:")).hex()
    if "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode() != fields["WARC-Block-Digest"]:
        raise ValueError("a block differs from its digest")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"].strip() else None, "url": json.loads(fields["X-Page-URL"]), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": int(fields["X-Page-Refers-To"]) if "X-Page-Refers-To" in fields else None, "payload": payload,
    }


def read_warc(manifest: DataFrame) -> DataFrame:
    """A row per record of the manifest's files, from the archives alone; digests are checked."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("file_offset", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    for at, raw in members(f):
                        if raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n"):
                            continue
                        row = parse(raw)
                        del row["payload"]
                        rows.append(row | {"file": uri.rpartition("/")[2], "file_offset": at})
                        if len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    numbered = manifest.select("file", (F.row_number().over(Window.orderBy("shard", "seq")) - 1).alias("number"))  # a row for each file
    return one_task_each(numbered, "number", manifest.count()).select("file").mapInArrow(read, READ)


def archive(pages: DataFrame, least: int = 100, **options) -> DataFrame:
    """Write below the shared folder and read back."""
    return read_warc(write_warc(pages, fresh_dir(pages.sparkSession, "warc"), least, **options))
