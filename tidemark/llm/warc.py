"""WARC archives and a normaliser of monolithic gzip.

write_monolithic() writes WARC records, each archive one gzip stream as naive writers make them. normalise() inflates
such a stream once from start to end, rewrites every record as a gzip member of its own, and writes a sidecar index of
offsets, so that any record can be read alone. read_records() reads records back through the index.

Archives lie in the folder that driver and executors share. A task writes under a name of its own attempt and renames
it when complete, so a lost executor's task can run again. Memory is bounded by one record, not by an archive
or its index.

Payloads are the html in UTF-8; null is empty. Of records with equal payloads the largest page_id is the response and
the others are revisits that name it; with a tie for the largest, all of the tied are responses. A null page_id counts
as smallest. Repeated rows are records of their own. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, written

#: Equal payloads below this many bytes stay responses.
LEAST_REVISIT = 0
LEVEL = 2
#: Pages of one payload are dealt over so many partitions when they learn which page they revisit.
SALTS = 16
_CHUNK = 1 << 18


class Store:
    """Files in the shared folder, local or in any store that pyarrow knows."""

    def __init__(self, uri: str):
        if uri.startswith("file:") or "://" not in uri:
            self.fs, self.root = None, "/" + uri.removeprefix("file:").lstrip("/")
        else:
            from pyarrow.fs import FileSystem

            self.fs, self.root = FileSystem.from_uri(uri)

    def write(self, name: str):
        path = f"{self.root}/{name}"
        if self.fs:
            self.fs.create_dir(path.rpartition("/")[0], recursive=True)
            return self.fs.open_output_stream(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb", buffering=1 << 20)

    def read(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}") if self.fs else open(f"{self.root}/{name}", "rb", buffering=1 << 20)

    def rename(self, a: str, b: str) -> None:
        (self.fs.move if self.fs else os.replace)(f"{self.root}/{a}", f"{self.root}/{b}")

    def delete(self, name: str) -> None:
        (self.fs.delete_file if self.fs else os.remove)(f"{self.root}/{name}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(uid: uuid.UUID, kind: str, when: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record of an HTTP message. A revisit holds the message's head alone. Page ids stand in fields of their
    own: several records may be of one page, and each has a record id."""
    target = lambda u: " ".join((u or "").split()) or "urn:page:none"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{uid.urn}>", f"WARC-Date: {when}", f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", *[f"X-Page-ID: {page_id}"] * (page_id is not None),
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {target(refers_url)}", f"WARC-Refers-To-Date: {when}", f"X-Refers-To-Page: {refers_to}"]
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind != "revisit":
        body += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)


def records(stream: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header block, body) of each record of an inflated stream, which is consumed once and chunk by chunk."""
    buffer, at = bytearray(), 0

    def more() -> bool:
        for chunk in stream:
            buffer.extend(chunk)
            return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(buffer[at:]).strip():
                    raise ValueError("the archive ends within a record's headers")
                return
        head = bytes(buffer[at:end])
        length = int(headers(head)["Content-Length"])
        need = end + 4 + length + 4
        while len(buffer) < need:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(buffer[end + 4 : end + 4 + length])
        at = need
        if at > 1 << 20:
            del buffer[:at]
            at = 0


def inflated(f) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in chunks. Zeros after a member are padding; a member that is cut
    off is an error."""
    z, begun = zlib.decompressobj(31), False
    while data := f.read(_CHUNK):
        while data:
            if not begun:
                data = data.lstrip(b"\0")
                begun = bool(data)
                continue
            yield z.decompress(data, _CHUNK)
            data = z.unconsumed_tail
            if z.eof:
                data, begun = z.unused_data, False
                z = zlib.decompressobj(31)
    if begun:
        raise ValueError("the archive is cut off")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, refers_to, refers_url. Digests are compared on narrow rows, and only digests with more than one page are
    joined back; the largest id by digest is found map-side first, so a payload in a third of all pages stays small."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    narrow = p.select("page_id", "url", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("size"))
    last = narrow.filter(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("last"), F.max_by("url", F.struct("page_id", "url")).alias("last_url"), F.count("*").alias("n")).filter("n > 1").select("sha", "last", "last_url")
    last = written(last, "warc-last").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = p.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    joined = salted.join(last, ["sha", "salt"], "left")
    again = (F.octet_length("html") >= least) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return joined.select("page_id", "url", "html", F.when(again, F.col("last")).alias("refers_to"), F.when(again, F.col("last_url")).alias("refers_url"))


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write one archive a task, a single gzip stream of many records; name, n_records. `pages` is what with_revisits()
    gives. The result is a written table, so the archives exist when this returns. A record's id follows from the folder,
    the archive and its place there, so a task that runs again writes the same."""
    when = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches):
        task = TaskContext.get()
        store, name, n = Store(folder), f"mono/{task.partitionId():06d}.warc.gz", 0
        part = f"mono/.{uuid.uuid4().hex}"
        out = z = None
        for b in small_batches(batches, "html"):
            for page, url, html, refers, refers_url in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                if out is None:
                    out, z = store.write(part), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                uid = uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}/{name}#{n}")
                out.write(z.compress(record(uid, "response" if refers is None else "revisit", when, page, url, html.encode("utf-8"), refers, refers_url)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            store.rename(part, name)
            yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [n]}, pa.schema([("name", pa.string()), ("n_records", pa.int64())]))

    return written(pages.mapInArrow(work, "name string, n_records long"), "warc-mono")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member a record, next to its sidecar index (JSON lines: offset, length, type,
    id, digest); name, index, n_records."""

    def work(batches):
        store = Store(folder)
        for b in batches:
            for name in b.column("name").to_pylist():
                to = name.replace("mono/", "members/")
                part, at, n = f"members/.{uuid.uuid4().hex}", 0, 0
                with store.write(part) as out, store.write(part + ".idx") as index, store.read(name) as f:
                    for head, body in records(inflated(f)):
                        data = member(head + b"\r\n\r\n" + body + b"\r\n\r\n")
                        h = headers(head)
                        index.write(json.dumps({"offset": at, "length": len(data), "type": h["WARC-Type"], "id": h["WARC-Record-ID"], "page": h.get("X-Page-ID"), "digest": h["WARC-Payload-Digest"]}).encode() + b"\n")
                        out.write(data)
                        at += len(data)
                        n += 1
                store.rename(part, to)
                store.rename(part + ".idx", to + ".idx")
                yield pa.RecordBatch.from_pydict({"name": [to], "index": [to + ".idx"], "n_records": [n]}, pa.schema([("name", pa.string()), ("index", pa.string()), ("n_records", pa.int64())]))

    rows = archives.count()
    spread = archives.repartition(max(1, min(rows, 10_000)), "name")
    return written(spread.mapInArrow(work, "name string, index string, n_records long"), "warc-members")


def read_records(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload of each record,
    read through the index one member at a time. A response's digest and length come from its payload; a digest that
    does not match the record's own is an error."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: None if x is None else int(x)

    def work(batches):
        store = Store(folder)

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            n = 6 + with_payload
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True)], names[:n])

        for b in batches:
            for name, index in zip(b.column("name").to_pylist(), b.column("index").to_pylist(), strict=True):
                rows, held = [], 0
                with store.read(name) as f, store.read(index) as lines:
                    for line in lines if isinstance(lines, io.BufferedReader) else io.BufferedReader(lines):
                        entry = json.loads(line)
                        f.seek(entry["offset"])
                        head, _, rest = zlib.decompress(f.read(entry["length"]), 31).partition(b"\r\n\r\n")
                        h = headers(head)
                        http, _, body = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers(http)["Content-Length"])
                        if h["WARC-Type"] == "response":
                            if len(body) != size or payload_digest(body) != digest:
                                raise ValueError(f"digest mismatch in {name} at {entry['offset']}")
                        rows.append((number(h.get("X-Page-ID")), h["WARC-Target-URI"], size, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page")), body if with_payload else None))
                        held += len(body) if with_payload else 200
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    rows = archives.count()
    return archives.repartition(max(1, min(rows, 10_000)), "name").mapInArrow(work, schema)


def op7_gzip_normaliser(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    pages = with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    members = normalise(write_monolithic(pages, folder), folder)
    return read_records(members, folder).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h,
             max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, (('0x' || h[1:10])::BIGINT) AS q1, (('0x' || h[11:20])::BIGINT) AS q2, (('0x' || h[21:30])::BIGINT) AS q3, (('0x' || h[31:40])::BIGINT) AS q4 FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform([q1, q2, q3, q4], lambda q: array_to_string(list_transform(range(7, -1, -1),
    lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((q >> (5 * k)) & 31) + 1]), '')), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM b
"""

QUERIES = {"op7_gzip_normaliser": op7_gzip_normaliser}
ORACLES = {"op7_gzip_normaliser": ORACLE}
