"""WARC archives with a two-level capture index.

Pages become WARC records (one gzip member each) in files that tasks write as they go; of
pages with equal payloads one is the response, the others are revisits of it. The captures'
keys (reversed host, path, page id) are range-partitioned and sorted; a shard of the index is
a run of compressed blocks of key lines, followed by a sparse directory with the first key of
each block. A lookup binary-searches the shards' first keys (one for each shard), then the
shard's directory, reads and searches one block, and then reads the record's bytes.
"""
from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm.common import arrow_batches, open_fs, shared_path, stored

BLOCK_LINES = 1000            # captures in a compressed block of the index
FILE_BYTES = 1 << 30          # an archive file is closed beyond this size
TASK_CAPTURES = 2048          # captures that one task reads back
OPEN_FILES = 32
KEPT_BYTES = 16 << 20         # payloads of responses that a task keeps for their revisits
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = ("key string, page_id long, file string, offset long, length long")


def safe_url(url: str | None) -> str:
    """The URL without white space, control and non-ASCII characters (percent-encoded)."""
    return quote(url or "", safe="%!#$&'()*+,/:;=?@[]~-._")


def url_key(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``; scheme, port 80 or 443, user and
    fragment do not count. An URL that cannot be split is its own path without host."""
    url = safe_url(url)
    try:
        parts = urlsplit(url if "://" in url else "//" + url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")/" + url
    host = ",".join(reversed(host.split(".")))
    port = f":{port}" if port not in (None, 80, 443) else ""
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sort key of a capture: its URL's key, then the page id in order (none first)."""
    return f"{url_key(url)}\t" + ("-" if page_id is None else f"{page_id + (1 << 63):020d}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to=None, refers_url=None, revisit: bool = False,
                 date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record as a gzip member; a revisit holds the HTTP header only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {safe_url(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
            "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>",
                 f"WARC-Refers-To-Target-URI: {safe_url(refers_url)}"]
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """Headers (lower-cased names) and payload of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    block = rest[:int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _page_of(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "None" else int(name)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages as WARC files under ``path`` (default: a new shared folder).

    Returns the stored captures (key, page_id, file, offset, length). Of pages with equal
    payloads of at least ``min_bytes`` bytes the largest id is the response (all rows with that
    id and payload are), the others revisit it. File names are unique to the attempt that
    wrote them and only the captures name them, so repeated tasks leave no wrong data.

    Defined results: null html is an empty payload; a null id is the smallest; a null URL is
    an empty one; repeated rows have a record each; an empty table has no captures.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "archives")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        html.alias("html"), F.sha1(html).alias("digest"),
                        F.octet_length(html).alias("size"))
    # stored, so that a payload of very many pages can be split in the join
    first = stored(rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(
        F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1).drop("n"), "payloads")
    rows = rows.join(first, ["digest", "size"], "left").select(
        "id", "url", "html", F.col("first.id").alias("to"), F.col("first.url").alias("to_url"),
        (F.col("first").isNotNull() & ~F.col("first.id").eqNullSafe(F.col("id"))).alias("revisit"))

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        part, fs, folder, out, file, at = TaskContext.get().partitionId(), None, None, None, None, 0
        for b in arrow_batches(batches):
            captures = []
            for page, url, html, to, to_url, revisit in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs, folder = open_fs(path)
                    fs.create_dir(folder, recursive=True)
                    file, at = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{folder}/{file}", compression=None)
                data = record_bytes(page, url, html.encode("utf-8", "surrogatepass"), to, to_url, revisit)
                out.write(data)
                captures.append((capture_key(url, page), page, f"{path}/{file}", at, len(data)))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*captures), (pa.string(), pa.int64(), pa.string(),
                                                                pa.int64(), pa.int64()))],
                names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(write, _CAPTURE), "captures")


def build_index(captures: DataFrame, path: str | None = None) -> DataFrame:
    """Write the index shards and return the stored list of them: (part, file, first, blocks,
    captures), ``first`` being the shard's smallest key. As many rows as tasks."""
    path = path or shared_path(captures.sparkSession, "capture-index")

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        part, out, file, at, total, lines, directory = TaskContext.get().partitionId(), None, None, 0, 0, [], []

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([lines[0].split(" ", 1)[0] + " ", at, len(data)])
            out.write(data)
            at += len(data)
            lines.clear()

        for b in batches:
            for key, page, where, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs, folder = open_fs(path)
                    fs.create_dir(folder, recursive=True)
                    file = f"index-{part:06d}-{uuid.uuid4().hex}.idx"
                    out = fs.open_output_stream(f"{folder}/{file}", compression=None)
                lines.append(f"{key} " + json.dumps([page, where, offset, length]))
                total += 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data + len(data).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [f"{path}/{file}"], "first": [directory[0][0]],
                 "blocks": [len(directory)], "captures": [total]})

    rows = captures.repartitionByRange("key").sortWithinPartitions("key").select(
        "key", "page_id", "file", "offset", "length")
    return stored(rows.mapInArrow(write, "part long, file string, first string, blocks long, captures long"),
                  "index-shards")


class _Files:
    """Range reads over a bounded number of open files."""

    def __init__(self):
        self.open = OrderedDict()

    def get(self, path: str):
        if path not in self.open:
            fs, p = open_fs(path)
            self.open[path] = fs.open_input_file(p)
            if len(self.open) > OPEN_FILES:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(path)
        return self.open[path]

    def read(self, path: str, offset: int, length: int) -> bytes:
        return self.get(path).read_at(length, offset)


class CaptureIndex:
    """Lookups in the two-level index: shards by first key, blocks by first key, then lines."""

    def __init__(self, shards: list[tuple[str, str]]):
        self.shards = sorted(shards)                       # (first key, file)
        self.first = [s[0] for s in self.shards]
        self.files, self.directories, self.block = _Files(), OrderedDict(), (None, None)
        self.payloads, self.kept = OrderedDict(), 0

    def _directory(self, shard: int) -> list:
        if shard not in self.directories:
            path = self.shards[shard][1]
            size = self.files.get(path).size()
            n = int.from_bytes(self.files.read(path, size - 8, 8), "big")
            self.directories[shard] = json.loads(zlib.decompress(self.files.read(path, size - 8 - n, n)))
            if len(self.directories) > OPEN_FILES:
                self.directories.popitem(last=False)
        return self.directories[shard]

    def _lines(self, shard: int, block: int) -> list[str]:
        if self.block[0] != (shard, block):
            _, offset, length = self._directory(shard)[block]
            data = zlib.decompress(self.files.read(self.shards[shard][1], offset, length))
            self.block = ((shard, block), data.decode().split("\n"))
        return self.block[1]

    def find(self, prefix: str) -> Iterator[list]:
        """[page id, file, offset, length] of all captures whose key starts with ``prefix``."""
        # the last shard and block whose first key is below the prefix may hold its first line
        shard = max(0, bisect.bisect_left(self.first, prefix) - 1)
        block = None                      # (first keys end with the space that ends a line's key)
        while shard < len(self.shards):
            firsts = [d[0] for d in self._directory(shard)]
            block = max(0, bisect.bisect_left(firsts, prefix) - 1) if block is None else 0
            while block < len(firsts):
                lines = self._lines(shard, block)
                for i in range(bisect.bisect_left(lines, prefix), len(lines)):
                    if not lines[i].startswith(prefix):
                        return
                    yield json.loads(lines[i].split(" ", 1)[1])
                block += 1
            shard += 1

    def record(self, file: str, offset: int, length: int) -> tuple[dict, bytes]:
        return parse_record(self.files.read(file, offset, length))

    def payload(self, headers: dict, payload: bytes) -> bytes:
        """The full payload of a record: its own, or for a revisit that of the response it
        names, looked up by URL and page; checked against the record's digest."""
        if headers["warc-type"] == "revisit":
            digest = headers["warc-payload-digest"]
            if digest not in self.payloads:
                page = _page_of(headers["warc-refers-to"])
                for _, file, offset, length in self.find(
                        capture_key(headers["warc-refers-to-target-uri"], page) + " "):
                    other, data = self.record(file, offset, length)
                    if other["warc-payload-digest"] == digest and other["warc-type"] == "response":
                        self.payloads[digest] = data
                        self.kept += len(data)
                        break
                else:
                    raise ValueError(f"the response {headers['warc-refers-to']} is missing")
                while self.kept > KEPT_BYTES and len(self.payloads) > 1:
                    self.kept -= len(self.payloads.popitem(last=False)[1])
            payload = self.payloads[digest]
        if "sha1:" + payload_digest(payload) != headers["warc-payload-digest"]:
            raise ValueError(f"{headers['warc-record-id']}: wrong payload digest")
        return payload


def read_captures(requests: DataFrame, shards: DataFrame, id_col: str = "page_id",
                  url_col: str = "url") -> DataFrame:
    """Look up distinct (id, url) requests: a row for each capture found, with ``page_id``,
    ``url``, ``record_type``, ``refers_to``, ``payload`` and ``payload_digest``.

    Requests are range-partitioned by key, so a task's lookups go through neighbouring blocks;
    the number of tasks follows the number of captures. The list of shards (one row for each
    task that wrote the index) goes to every task.
    """
    listed = shards.select("first", "file", "captures").collect()
    firsts = [(r["first"], r["file"]) for r in listed]
    tasks = max(1, -(-sum(r["captures"] for r in listed) // TASK_CAPTURES))

    def key(ids, urls):
        return pa.array([capture_key(u, i) for i, u in zip(ids.to_pylist(), urls.to_pylist())], pa.string())

    def keyed(batches: Iterator) -> Iterator:
        for b in batches:
            yield pa.RecordBatch.from_arrays([key(b.column(0), b.column(1))], names=["key"])

    def read(batches: Iterator) -> Iterator:
        index = CaptureIndex(firsts)
        rows, held = [], 0
        for b in batches:
            for k in b.column(0).to_pylist():
                for page, file, offset, length in index.find(k + " "):
                    headers, own = index.record(file, offset, length)
                    payload = index.payload(headers, own)
                    to = headers.get("warc-refers-to")
                    rows.append((page, headers["warc-target-uri"], headers["warc-type"],
                                 to and _page_of(to), payload, payload_digest(payload)))
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    def batch(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          names=["page_id", "url", "record_type", "refers_to",
                                                 "payload", "payload_digest"])

    keys = requests.select(F.col(id_col).cast("long"), F.col(url_col)).mapInArrow(keyed, "key string").distinct()
    return keys.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(
        read, "page_id long, url string, record_type string, refers_to long, payload binary, "
              "payload_digest string")


def lookup_url(spark: SparkSession, shards: DataFrame, url: str) -> list[tuple[int, str, bytes]]:
    """(page id, record type, payload) of all captures of one URL: a point query."""
    index = CaptureIndex([(r["first"], r["file"]) for r in shards.select("first", "file").collect()])
    out = []
    for page, file, offset, length in index.find(url_key(url) + "\t"):
        headers, own = index.record(file, offset, length)
        out.append((page, headers["warc-type"], index.payload(headers, own)))
    return out
