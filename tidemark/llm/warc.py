"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, manifests."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import new_folder, pick, written

#: Payload bytes a shard should hold, shards at most, compressed bytes after which a file is closed.
SHARD_BYTES, MOST_SHARDS, ROLL_BYTES = 64 << 20, 65_536, 32 << 20
SAMPLE_PER_SHARD = 64
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, part int, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def id_of(name: str) -> int | None:
    text = name.strip("<>").rpartition(":")[2]
    return None if text == "null" else int(text)


def record(kind: str, name: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own; the same input gives the same bytes."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *headers]
    head += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def header_text(url: str) -> str:
    """A URL as a header value: control characters and what is not ASCII percent-encoded, so it can be undone."""
    return "".join(c if "!" <= c <= "~" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response with the payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [] if url is None else [("WARC-Target-URI", header_text(url))]
    headers += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", name_of(page_id), date, headers, http + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    return record("revisit", name_of(page_id), date, headers, http)


def shard_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by binary search in a literal array; null keys are in shard 0."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    mid = lambda acc: F.floor((acc["low"] + acc["high"]) / 2).cast("int")

    def step(acc: Column, _: Column) -> Column:
        right = (acc["low"] < acc["high"]) & (F.get(array, mid(acc)) <= F.coalesce(key, F.lit(-(2**63))))
        low = F.when(right, mid(acc) + 1).otherwise(acc["low"])
        high = F.when(right | (acc["low"] >= acc["high"]), acc["high"]).otherwise(mid(acc))
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step)["low"]


def shard_bounds(rows: DataFrame, shard_bytes: int, most: int) -> list[int]:
    """Ids that divide the rows into shards of about equal count, from a sample that the ids alone decide.

    The sample has about SAMPLE_PER_SHARD ids a shard, so its size is bounded by the number of shards.
    """
    total, count = rows.agg(F.sum("payload_bytes"), F.count("page_id")).first()
    shards = min(most, -(-(total or 0) // shard_bytes), count)
    if shards <= 1:
        return []
    every = max(1, count // (shards * SAMPLE_PER_SHARD))
    sample = rows.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("page_id").where("page_id is not null")
    ids = np.sort(sample.toPandas()["page_id"].to_numpy())
    return np.unique(ids[[len(ids) * k // shards for k in range(1, shards)]]).tolist() if len(ids) else []


class Files:
    """Writes members to files of a shard, closes a file once it is large, and commits it by a rename."""

    def __init__(self, folder: str, shard: int, roll: int, date: str):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.date, self.part, self.out = shard, roll, date, 0, None

    def add(self, member: bytes) -> None:
        if self.out is None:
            task = TaskContext.get()
            self.temporary = f"{self.folder}/.{self.shard}-{self.part}-{task.taskAttemptId() if task else 0}-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.digest = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
            self._put(record("warcinfo", f"<urn:file:{self.shard}:{self.part}>", self.date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        name = f"part-{self.shard:05d}-{self.part:05d}.warc.gz"
        self.fs.move(self.temporary, f"{self.folder}/{name}")
        row = (name, self.shard, self.part, self.records, self.size, self.digest.hexdigest())
        self.part, self.out = self.part + 1, None
        return row


def write_archives(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE,
    most_shards: int = MOST_SHARDS,
) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) and returns the manifest of the files.

    Rows are cut into ranges of page_id and sorted in them, so the same rows give the same bytes however often
    a task runs. Equal payloads (null counts as empty) are one response, that with the smallest page_id (null
    counts as largest), and revisits; of repeated rows the first is the response. The payloads are moved once:
    what a digest refers to travels beside them as narrow rows, for payloads that occur twice or more. A task
    streams its shard; rows that share a page_id stay in one shard. No rows: no files. Other columns are ignored.
    """
    html = F.coalesce("html", F.lit(""))
    key = F.unhex(F.sha2(html.cast("binary"), 256))
    pages = pick(pages, page_id="page_id", url="url", html="html")
    narrow = written(pages.select("page_id", key.alias("key"), F.octet_length(html).cast("long").alias("payload_bytes")), "digests")
    bounds = shard_bounds(narrow, shard_bytes, most_shards)
    first = narrow.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1").select("key", "first"), "repeated")
    known = narrow.join(first, "key").select("page_id", "key", "first").distinct()
    rows = pages.select("page_id", key.alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", html.alias("html"))
    rows = rows.unionByName(known.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    rows = rows.repartitionById(len(bounds) + 1, shard_of(F.col("page_id"), bounds).cast("int"))
    rows = rows.sortWithinPartitions("page_id", "key", "kind", "url")
    if folder.startswith(("file:", "/")):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        files, note, before = None, None, None
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["page_id"].astype("Int64")]
            firsts = [None if pd.isna(x) else int(x) for x in batch["first"].astype("Int64")]
            for page_id, digest, kind, first, url, html in zip(ids, batch["key"], batch["kind"], firsts, batch["url"], batch["html"], strict=True):
                if kind == 0:
                    note = (page_id, digest, first)
                    continue
                files = files or Files(folder, TaskContext.get().partitionId(), roll_bytes, date)
                target = None
                if note and note[:2] == (page_id, digest) and (note[2] != page_id or before == (page_id, digest)):
                    target = name_of(note[2])
                before = (page_id, digest)
                files.add(page_record(page_id, None if pd.isna(url) else url, html.encode(), target, date))
                if files.size >= roll_bytes:
                    done.append(files.close())
        if files and (last := files.close()):
            done.append(last)
        yield pd.DataFrame(done, columns=["file", "shard", "part", "records", "bytes", "sha256"])

    return written(rows.mapInPandas(run, MANIFEST), "manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    unpacker, out, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(chunk)):
        out.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(out)
            unpacker, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the archive ends inside a record")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"{headers['WARC-Record-ID']}: the block digest differs")
    return headers, block


def page_of(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of a response or revisit."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload differs from its digest")
    refers_to = id_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    url = headers.get("WARC-Target-URI")
    return id_of(headers["WARC-Record-ID"]), url and unquote(url), size, digest, kind, refers_to


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files that the manifest names, each file streamed by one task; digests are verified."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["file"]:
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        headers, block = parsed(data)
                        if headers["WARC-Type"] != "warcinfo":
                            rows.append(page_of(headers, block))
                        if len(rows) >= 10_000:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files).mapInPandas(run, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
