"""WARC archives and a two-level capture index.

Pages become gzip-member records in archive files. A capture's key is its
URL with the host reversed, so captures of a domain sort together, and its id.
Sorted keys are cut into shards, and a shard's lines into compressed blocks;
behind the blocks each shard file holds a sparse directory of their first keys.
A lookup finds the shard among the shards' first keys, binary-searches the
directory, reads that one block by its range, binary-searches its lines, and
then reads the record's range of the archive.

Files are written and read through pyarrow.fs, in the shared folder only. A
task's files bear its attempt's number and count once the task's rows have been
committed, so repeated and lost tasks leave no trace in the index.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit
from uuid import UUID

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom.llm.common import new_path, slices, stage, tune

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4
#: An archive file is closed beyond this size.
ARCHIVE_BYTES = 256 << 20
#: Records are read back in tasks of about READ_BYTES of compressed records,
#: dealt out in runs of RUN_BYTES of a file; lines are sorted and looked up in
#: tasks of about SHARD_LINES. Smaller inputs keep all cores busy as long as a
#: task has a LEAST_SHARE of that.
READ_BYTES = 32 << 20
RUN_BYTES = 256 << 10
SHARD_LINES = 1 << 19
LEAST_SHARE = 1 / 32
#: Lines in a compressed index block.
BLOCK_LINES = 1024
#: Begins the URN of a record whose page has no id.
NO_PAGE = "urn:x-no-page:"
_MASK = (1 << 64) - 1


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, url: str | None = None) -> str:
    """A URN with half of the payload's digest above the page's id; without an id, of the digests of payload and URL."""
    if page_id is None:
        return f"<{NO_PAGE}{digest}:{digest_of((url or '').encode())}>"
    high = int.from_bytes(base64.b32decode(digest)[:8], "big")
    return f"<urn:uuid:{UUID(int=high << 64 | page_id & _MASK)}>"


def page_of(urn: str) -> int | None:
    """The page id in a record's URN."""
    if urn.strip("<>").startswith(NO_PAGE):
        return None
    low = UUID(urn.strip("<>").removeprefix("urn:uuid:")).int & _MASK
    return low - (1 << 64) if low >> 63 else low


def clean_uri(url: str | None) -> str:
    return quote(url or "urn:page:unknown", safe="%/:?#[]@!$&'()*+,;=~-._")


def surt(url: str | None) -> str:
    """The URL as a sort key: reversed host, port, path and query, no scheme or fragment."""
    if not url:
        return ")/"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:  # a host or port that is none
        return ")/" + quote(url, safe="%/:?#@!$&'()*+,;=~-._")
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return quote(f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""), safe="%/:?@!$&'()*+,;=~-._")


def line_key(url: str | None, page_id: int | None) -> str:
    """Key and id, so that lines sort as text by both, also for negative ids; a null id is "-", before all others."""
    if page_id is None:
        return f"{surt(url)} -"
    return f"{surt(url)} {page_id + (1 << 63):020d}"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """One uncompressed record: a response, or a revisit that leaves the payload out."""
    digest = digest or digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest, url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {DATE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """Headers and block of an uncompressed record; ValueError if cut off."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) < size:
        raise ValueError("the record's block is cut off")
    return Record(headers, block)


def payload_of(record: Record) -> tuple[int, bytes]:
    """The full payload's size by the HTTP header, and what of it is in the record."""
    head, _, body = record.block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return int(size[1]) if size else len(body), body


def member(data: bytes) -> bytes:
    """One gzip member, the same bytes for the same data."""
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + squeeze.compress(data) + squeeze.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _tasks(spark: SparkSession, amount: int, each: int) -> int:
    """How many tasks an amount of work is dealt to: its pointers alone say nothing of it."""
    return max(1, -(-amount // each), min(spark.sparkContext.defaultParallelism, int(amount // (each * LEAST_SHARE))))


def _attempt(kind: str) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}"


_CAPTURE = "line_key string, page_id long, file string, offset long, length long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, number = None, "", 0, 0
        for batch in batches:
            for part, texts in slices(batch, "html"):
                rows = []
                for page, url, first, payload in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("refers_to").to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
                    data = member(build_record(page, url, payload, first))
                    if out is None:
                        name, at = f"{_attempt('pages')}-{number:04d}.warc.gz", 0
                        out, number = fs.open_output_stream(f"{root}/{name}", compression=None), number + 1
                    out.write(data)
                    rows.append((line_key(url, page), page, name, at, len(data)))
                    at += len(data)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["line_key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def duplicates(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of pages whose payload a smaller page_id has too."""
    digests = pages.select("page_id", _sha1().alias("sha1"), F.octet_length(_html()).alias("n")).where(F.col("n") >= least_bytes)
    first = digests.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    first = stage(first, "firsts")  # so that Spark can split the join at a payload that very many pages share
    return digests.join(first, "sha1").where("page_id > refers_to").select("page_id", "sha1", "refers_to").distinct()


def _html() -> Column:
    return F.coalesce("html", F.lit(""))


def _sha1() -> Column:
    return F.sha1(_html().cast("binary"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as records; (line_key, page_id, file, offset, length).

    Of pages with equal payloads of at least `least_bytes` bytes, the one with
    the smallest id is a response and the others revisit it; all else are
    responses. Null html is an empty payload, a null url has an empty key. A
    row with a null page_id is a response, and null when it is read back.
    """
    tune(pages.sparkSession)
    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    refs = stage(duplicates(ready, least_bytes), "revisits")
    marked = ready.withColumn("sha1", _sha1()).join(refs, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")
    return stage(marked.mapInArrow(_write(folder), _CAPTURE), "captures")


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, f"{_attempt('captures')}.idx", 0
        lines: list[bytes] = []
        directory: list[tuple[str, int, int]] = []

        def flush() -> None:
            nonlocal at
            block = zlib.compress(b"\n".join(lines), 6)
            out.write(block)
            directory.append((lines[0].partition(b"\t")[0].decode(), at, len(block)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for key, *where in zip(*(batch.column(c).to_pylist() for c in ("line_key", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(f"{key}\t{json.dumps(where)}".encode())
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            footer = zlib.compress(json.dumps(directory).encode())
            out.write(footer + struct.pack("<Q", len(footer)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([len(directory)], pa.int64())], ["shard", "first_key", "blocks"])

    return run


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into shard files; (shard, first_key, blocks), a row each."""
    spark = tune(captures.sparkSession)
    ordered = captures.repartitionByRange(_tasks(spark, captures.count(), SHARD_LINES), "line_key").sortWithinPartitions("line_key", "file", "offset")
    return stage(ordered.mapInArrow(_index(folder), "shard string, first_key string, blocks long"), "shards")


class Shard:
    """A shard file opened for lookups; holds its directory and one block."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        (n,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
        self.firsts = [x[0].encode() for x in self.directory]
        self.at, self.lines, self.keys = -1, [], []

    def block(self, k: int) -> None:
        if k != self.at:
            _, offset, length = self.directory[k]
            self.lines = zlib.decompress(self.file.read_at(length, offset)).split(b"\n")
            self.keys = [x.partition(b"\t")[0] for x in self.lines]
            self.at = k

    def find(self, key: bytes) -> list[list]:
        """[page_id, file, offset, length] of every line with this key."""
        out = []
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)  # equal keys may start in the block before
        while k < len(self.firsts) and self.firsts[k] <= key:
            self.block(k)
            a, b = bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)
            out += [json.loads(x.partition(b"\t")[2]) for x in self.lines[a:b]]
            k += 1
        return out


def lookup(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """The captures of keys (line_key), each distinct key looked up once.

    The shards' first keys, one for each index file, go to every task.
    """
    spark = tune(keys.sparkSession)
    rows = shards.select("first_key", "shard", "blocks").collect()
    known = sorted((r["first_key"].encode(), r["shard"]) for r in rows)
    firsts, names = [k for k, _ in known], [n for _, n in known]
    tasks = _tasks(spark, BLOCK_LINES * sum(r["blocks"] for r in rows), SHARD_LINES)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column("line_key").to_pylist():
                b = key.encode()
                k = bisect.bisect_left(firsts, b)
                for s in range(max(0, k - 1), len(firsts)):
                    if firsts[s] > b:
                        break
                    rows.append((key, names[s]))
            columns = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["line_key", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        name, shard = None, None
        for batch in batches:
            rows = []
            for key, at in zip(batch.column("line_key").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                if at != name:
                    name, shard = at, Shard(fs, f"{root}/{at}")
                rows += [(key, *x) for x in shard.find(key.encode())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["line_key", "page_id", "file", "offset", "length"])

    placed = keys.select("line_key").distinct().mapInArrow(place, "line_key string, shard string")
    return placed.repartitionByRange(tasks, "shard", "line_key").sortWithinPartitions("shard", "line_key").mapInArrow(search, _CAPTURE)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of captures.

    Records are read by their ranges, in the order of the archive. A response's
    payload is digested again and must match what the record says. The captures
    are read twice, first for the sum of their lengths, so they should be staged.
    """
    spark = tune(captures.sparkSession)
    total = captures.agg(F.sum("length").alias("n")).first()["n"] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for at, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if at != name:
                    name, file = at, fs.open_input_file(f"{root}/{at}")
                record = parse_record(zlib.decompress(file.read_at(length, offset), 31))
                kind, digest = record.headers["warc-type"], record.headers["warc-payload-digest"].removeprefix("sha1:")
                size, payload = payload_of(record)
                if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                    raise ValueError(f"the record at {offset} of {at} doesn't match its digest")
                first = page_of(record.headers["warc-refers-to"]) if kind == "revisit" else None
                rows.append((page_of(record.headers["warc-record-id"]), size, digest, kind, first, record.headers["warc-target-uri"]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    run_of = F.floor(F.col("offset") / RUN_BYTES)
    ordered = captures.select("file", "offset", "length").repartition(_tasks(spark, total, READ_BYTES), "file", run_of).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def line_keys(pages: DataFrame) -> DataFrame:
    """(line_key) of pages (page_id, url)."""
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True)], pa.string())], ["line_key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "line_key string")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages and their index, look every page up and read its record.

    Null html is an empty payload and a null url an empty key; a row with a
    null page_id comes back with it, once for each such row. Very long payloads
    are records like any other. Of equal payloads under one page_id each is
    looked up once and read as often as it was written. No pages give no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    shards = write_index(write_archives(pages, folder, least_bytes), folder)
    found = stage(lookup(line_keys(pages), shards, folder), "found")
    return read_records(found, folder)
