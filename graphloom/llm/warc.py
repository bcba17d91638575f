"""Deterministic sharded WARC files: a writer and a reader.

Records are sorted by id and payload.  Shards are ranges in that order that are cut
at exact quantiles of the payload bytes, so they depend on the rows alone and not on
partitions or executors, and ids far apart or close together make no difference;
within a shard a new file begins once the compressed size passes the limit.  A file is
written under a temporary name and renamed when it is whole, so a task that runs
again, or twice, leaves the same file.  The job's output is the manifest, one row
for each file with its size, digest and range of ids, which Spark's own commit
publishes after the last file; readers only open files that a manifest names.

Each record is one gzip member.  Headers, dates, record ids and digests are made
from the row, never copied.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, scratch_path
from .batches import in_arrow, pieces

#: Raw payload bytes that a shard aims at: of SPREAD shards, but in these bounds; compressed bytes after which a file is rolled.
SPREAD, SHARD_BYTES, FILE_BYTES = 4_096, (8_000_000, 1_000_000_000), 1_000_000_000
#: Compressed bytes that a task reads, of whole files, and how many are read at a time.
READ_BYTES, CHUNK = 128_000_000, 1 << 18
#: Shards at most, whose first keys are sent to all tasks, 16 bytes each; more bytes make larger shards.
SHARDS, FAN = 65_536, 256
#: Keys of copied payloads that are broadcast, of about 100 bytes each; more are joined by a shuffle.
COPIES_SENT = 100_000
DATE = "1970-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of the URL namespace, RFC 4122
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'page:{page}')}>"


def uri(url: str | None, page: object) -> str:
    """The url without characters that would end a header line; a urn for a null one."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url) if url else f"urn:page:{page}"


def record(page: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> bytes:
    """One WARC record, as a gzip member without a time stamp."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    named = lambda x: "" if x is None else str(x)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri(url, page)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Page-ID: {named(page)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page: {named(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
        z.write(("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n")
    return out.getvalue()


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") and "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Roller:
    """The files of one shard, one after another."""

    def __init__(self, folder: str, limit: int):
        self.fs, self.folder = filesystem(folder)
        self.limit, self.shard, self.number, self.out = limit, None, 0, None
        self.done: list[dict] = []

    def start(self, shard: int) -> None:
        self.finish()
        self.shard, self.number = shard, 0

    def write(self, page: object, data: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.name = f"part-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.digest = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256()
            self.first, self.size, self.records = page, 0, 0
        self.out.write(data)
        self.digest.update(data)
        self.last, self.size, self.records = page, self.size + len(data), self.records + 1
        if self.size >= self.limit:
            self.finish()
            self.number += 1

    def finish(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append({"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.digest.hexdigest(), "first_id": self.first, "last_id": self.last})
            self.out = None


MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"


KEY = "array<struct<i:bigint,k:bigint>>"


def keyed(pages: DataFrame) -> DataFrame:
    """``pages`` with i and k, by which records are ordered: the id, a null first, and a hash of the payload."""
    return pages.withColumns({"i": F.coalesce("page_id", F.lit(-(1 << 63))), "k": F.xxhash64("payload")})


def shards(sized: DataFrame, target: int | None) -> list[tuple[int, int]]:
    """The first (i, k) of each shard but the first, in order; of (i, k, n), n being a payload's bytes.

    Equal keys are summed, dealt by range, summed in their range and shifted by the
    ranges before, one number for each task.
    """
    spark = sized.sparkSession
    cells = sized.groupBy("i", "k").agg(F.sum("n").alias("n"))
    dealt = cut(cells.repartitionByRange("i", "k").withColumn("p", F.spark_partition_id()))
    before, total = [], 0
    for r in dealt.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():
        before.append((r["p"], total))
        total += r["n"]
    if target is None:
        target = min(max(total // SPREAD, SHARD_BYTES[0]), SHARD_BYTES[1])
    target = max(target, -(-total // SHARDS), 1)
    shift = F.broadcast(spark.createDataFrame(before, "p int, start long"))
    own = F.sum("n").over(Window.partitionBy("p").orderBy("i", "k"))
    placed = dealt.withColumn("own", own).join(shift, "p").select("i", "k", F.floor((F.col("own") + F.col("start") - F.col("n")) / target).alias("s"))
    firsts = placed.groupBy("s").agg(F.min(F.struct("i", "k")).alias("f")).orderBy("s").collect()  # SHARDS + 1 at most
    return [(r["f"]["i"], r["f"]["k"]) for r in firsts][1:]


def in_shards(records: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``records``, which are ``keyed``, with the number of their shard: a search in the first keys, FAN at a time."""
    shown = lambda part: json.dumps([{"i": i, "k": k} for i, k in part])
    groups = [bounds[a : a + FAN] for a in range(0, len(bounds), FAN)] or [[]]
    upto = lambda keys: F.size(F.filter(keys, lambda x: x <= F.struct("i", "k")))
    coarse = F.from_json(F.lit(shown([g[0] for g in groups[1:]])), KEY)
    fine = records.sparkSession.createDataFrame([(g, g * FAN, shown(part)) for g, part in enumerate(groups)], "__g int, __base int, __keys string")
    fine = F.broadcast(fine.withColumn("__keys", F.from_json("__keys", KEY)))
    return records.withColumn("__group", upto(coarse)).join(fine, F.col("__group") == F.col("__g")).withColumn("shard", F.col("__base") + upto(F.col("__keys"))).drop("__group", "__g", "__base", "__keys")


def write(pages: DataFrame, folder: str, shard_bytes: int | None = None, file_bytes: int = FILE_BYTES, at_least: int = 0) -> DataFrame:
    """Write a record for each row (page_id, url, html) below ``folder``; returns the manifest.

    A null html is an empty payload.  Of rows with equal payloads of ``at_least``
    bytes, the one with the largest page_id is a response and the others revisit
    it; among repeated rows with that id the first is the response.  Shorter
    payloads are all responses.  Rows with a null id come first in the first
    shard, and are revisits where another row has the payload and an id.
    ``folder`` must be new and shared by all executors.
    """
    own = keyed(pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("key", F.sha2("payload", 256)))
    sized = cut(own.select("page_id", "i", "k", "key", F.length("payload").cast("long").alias("n")))
    latest = sized.where(F.col("n") >= at_least).groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    latest = cut(latest.where("copies > 1 and refers_to is not null").select("key", "refers_to"))
    bounds = shards(sized, shard_bytes)
    small = latest.count() <= COPIES_SENT
    located = in_shards(own.join(F.broadcast(latest) if small else latest, "key", "left").drop("key"), bounds)
    ordered = located.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "i", "k", "url").drop("i", "k")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, seen = Roller(folder, file_bytes), None
        for whole in batches:
            for batch in pieces(whole, "payload"):
                for r in batch.to_pylist():
                    if r["shard"] != roller.shard:
                        roller.start(r["shard"])
                    revisit = r["refers_to"] is not None
                    if revisit and r["refers_to"] == r["page_id"]:
                        mark = (r["page_id"], hashlib.sha256(r["payload"]).digest())
                        revisit, seen = mark == seen, mark
                    roller.write(r["page_id"], record(r["page_id"], r["url"], r["payload"], r["refers_to"], revisit))
        roller.finish()
        if roller.done:
            yield pa.RecordBatch.from_pylist(roller.done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    in_arrow(ordered, work, MANIFEST).write.parquet(f"{folder}/_manifest")
    return manifest(pages.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


class Hashed:
    """A stream, with the size and the digest of what has been read of it."""

    def __init__(self, stream):
        self.stream, self.size, self.hash = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.hash.update(data)
        return data


def records_of(stream, name: str) -> Iterator[dict]:
    """The parsed records of a file; one that can't be read isn't what was written."""
    try:
        for raw in members(stream):
            yield parse(raw) | {"__size": len(raw)}
    except (zlib.error, ValueError, KeyError) as e:
        raise ValueError(f"{name} isn't the file that the manifest names") from e


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after another; no more than one is held."""
    left, z, out = b"", None, []
    while left or (left := stream.read(CHUNK)):
        if z is None:
            z, out = zlib.decompressobj(31), []
        out.append(z.decompress(left))
        left = b""
        if z.eof:
            yield b"".join(out)
            left, z = z.unused_data, None
    if z is not None:
        raise ValueError("the file ends within a record")


def parse(raw: bytes) -> dict:
    """Headers, page id, payload and its length of one record; digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(named["Content-Length"])]
    if lines[0] != "WARC/1.1" or named["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("the record is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rpartition("Content-Length: ")[2])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = named["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("the payload is damaged")
    number = lambda k: int(named[k]) if named.get(k) else None
    return {"page_id": number("Page-ID"), "url": named["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("Refers-To-Page")}


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the files that the manifest of ``folder`` names.

    A task reads about READ_BYTES of whole files, a record at a time.  A file whose
    size or digest isn't the manifest's raises.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        for batch in batches:
            for name, size, digest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held, used = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as f:
                    stream = Hashed(f)
                    for row in records_of(stream, name):
                        used += row.pop("__size")
                        if not payloads:
                            row["payload"] = None
                        held.append(row)
                        if used > 4_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema=RECORD)
                            held, used = [], 0
                if stream.size != size or stream.hash.hexdigest() != digest:
                    raise ValueError(f"{name} isn't the file that the manifest names")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=RECORD)

    named = manifest(spark, folder).select("file", "bytes", "sha256")
    sums = named.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(sums["files"], max(spark.sparkContext.defaultParallelism * 4, -(-sums["bytes"] // READ_BYTES))))
    return in_arrow(named.repartition(tasks), work, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: of the archives, read back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write(pages, folder)
    return read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
