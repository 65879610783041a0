"""Web archives: write, normalise to one gzip member a record, index, and read back.

A crawl's archive is one gzip stream for the whole file, so no record can be read alone. The
normaliser inflates each file once, as a stream, rewrites every record as a member of its own
and leaves a sidecar with each member's place. It also turns repeated payloads into revisit
records: which record is the first of its payload is decided on digests alone, so payloads never
pass a shuffle. Tasks write under names of their own attempt, and later steps read only files that
a finished task has reported, so tasks can run again after a lost executor.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.scratch import Scratch

#: Uncompressed bytes after which a task begins another file.
FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header's value: no line breaks or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, headers: dict[str, str | None], block: bytes, name: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>"]
    lines += [f"{k}: {_line(v)}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


class Records:
    """The records of a gzip file, from one pass over its stream, however many members it has.

    Holds one record and one read at a time."""

    def __init__(self, stream):
        self.stream, self.inflate, self.held = stream, zlib.decompressobj(31), bytearray()
        self.raw, self.ended = b"", False

    def _more(self) -> bool:
        while not self.ended:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(READ)
                if not self.raw:
                    self.ended = True
                    return False
            out = self.inflate.decompress(self.raw, 4 * READ)
            self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                self.held += out
                return True
        return False

    def __iter__(self) -> Iterator[bytes]:
        while True:
            at = 0
            while (end := self.held.find(b"\r\n\r\n", at)) < 0:
                at = max(0, len(self.held) - 3)
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a header")
                    return
            head = bytes(self.held[:end])
            size = end + 4 + int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) + 4
            while len(self.held) < size:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            yield bytes(self.held[:size])
            del self.held[:size]


def write_crawl(pages: DataFrame, root: str, level: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a response record per row of pages (page_id, url, html) to whole-file gzip archives under ``root``.

    Gives (file, ordinal, page_id, payload_bytes, payload_digest) of each record."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, gz, name, n, size = None, None, "", 0, 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.write(gz.flush())
                        out.close()
                    name = f"crawl-{uuid.uuid4().hex}.warc.gz"
                    out, gz, n, size = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, wbits=31), 0, 0
                payload = (html or "").encode()
                block = _HTTP % len(payload) + payload
                headers = {
                    "WARC-Date": DATE, "WARC-Target-URI": url or None, "WARC-Payload-Digest": f"sha1:{(digest := digest_of(payload))}",
                    "X-Page-Id": None if page_id is None else str(page_id), "Content-Type": "application/http;msgtype=response",
                }
                raw = record("response", headers, block, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{n}")))
                out.write(gz.compress(raw))
                rows.append((name, n, page_id, len(payload), digest))
                n, size = n + 1, size + len(raw)
            if rows:
                file, ordinal, ids, sizes, digests = zip(*rows)
                yield pa.record_batch([pa.array(file), pa.array(ordinal, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests)], names=["file", "ordinal", "page_id", "payload_bytes", "payload_digest"])
        if out is not None:
            out.write(gz.flush())
            out.close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(written, "file string, ordinal long, page_id long, payload_bytes long, payload_digest string")


def revisits(index: DataFrame, least_bytes: int) -> DataFrame:
    """``index`` with ``first``: where the first record of an equal payload lies, null for first and for short records.

    First is the smallest page_id (nulls last), then the place in the archives. Counts and firsts are
    combined before the exchange; only digests that repeat are joined back, and Spark splits a hot one."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "ordinal")
    firsts = index.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    joined = index.join(firsts.where("n > 1").drop("n"), "payload_digest", "left")
    own = (F.col("first.file") == F.col("file")) & (F.col("first.ordinal") == F.col("ordinal"))
    return joined.withColumn("first", F.when(~own & (F.col("payload_bytes") >= least_bytes), F.col("first")))


#: Most tasks that files are dealt to; beyond it a task has many files, and all about as many.
TASKS = 20_000


def tasks_for(files: DataFrame) -> int:
    """Tasks to deal the distinct files of ``files`` to: twice their number, so that few share one."""
    return max(1, min(TASKS, 2 * files.select("file").distinct().count()))


def normalise(decided: DataFrame, crawl: str, root: str, tasks: int, level: int = 6) -> DataFrame:
    """Rewrite whole-file archives under ``crawl`` as one member a record under ``root``, with sidecars.

    ``decided``: every record's (file, ordinal, first). Gives (file, sidecar, records) of each new file.
    Files are dealt out by their number, as their index rows say nothing of their size."""

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_store, from_base = fs.FileSystem.from_uri(crawl)
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, str, int]] = []
        file, source, records, out, index, at = None, None, None, None, None, 0

        def close() -> None:
            if out is not None:
                source.close(), out.close(), index.close()
                done.append((name, f"{name}.cdxj", n))

        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != file:
                    close()
                    file, n, at = row["file"], 0, 0
                    name = f"{uuid.uuid4().hex}-{file}"
                    source = from_store.open_input_stream(f"{from_base}/{file}", compression=None)
                    records = iter(Records(source))
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    index = store.open_output_stream(f"{base}/{name}.cdxj", compression=None)
                raw = next(records)
                if row["ordinal"] != n:
                    raise ValueError(f"{file}: record {row['ordinal']} is missing")
                first = row["first"]
                if first is not None:
                    headers, block = parse(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kept = {k: headers.get(k) for k in ("WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "X-Page-Id", "Content-Type")}
                    to = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{first['file']}#{first['ordinal']}"))
                    kept |= {
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{to}>",
                        "X-Payload-Length": str(len(payload)), "X-Refers-To-Page-Id": None if first["page_id"] is None else str(first["page_id"]),
                    }
                    raw = record("revisit", kept, http + b"\r\n\r\n", headers["WARC-Record-ID"][10:-1])
                gz = zlib.compressobj(level, wbits=31)
                member = gz.compress(raw) + gz.flush()
                out.write(member)
                index.write(json.dumps({"offset": at, "length": len(member), "ordinal": n}).encode() + b"\n")
                at, n = at + len(member), n + 1
        close()
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done)], names=["file", "sidecar", "records"])

    rows = decided.select("file", "ordinal", F.when(F.col("first").isNotNull(), F.struct("first.page_id", "first.file", "first.ordinal")).alias("first"))
    return rows.repartition(tasks, "file").sortWithinPartitions("file", "ordinal").mapInArrow(rewritten, "file string, sidecar string, records long")


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, member_bytes long"


def read_archives(files: DataFrame, root: str, tasks: int, payloads: bool = True) -> DataFrame:
    """Every record of normalised files (file, sidecar), each read alone by its place in the sidecar.

    A response's payload is held against its digest. payloads: whether to return them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, sidecar in zip(batch.column("file").to_pylist(), batch.column("sidecar").to_pylist()):
                rows = []
                with store.open_input_stream(f"{base}/{sidecar}", compression=None) as lines:
                    entries = lines.read().splitlines()  # one short line a record of a file of bounded size
                with store.open_input_file(f"{base}/{name}") as data:
                    for entry in map(json.loads, entries):
                        rows.append(_row(zlib.decompress(data.read_at(entry["length"], entry["offset"]), 31), name, entry))
                        if len(rows) >= 256:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _row(raw: bytes, name: str, entry: dict) -> tuple:
        headers, block = parse(raw)
        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        if payload is not None and digest_of(payload) != digest:
            raise ValueError(f"{name}: the record at {entry['offset']} differs from its digest")
        number = lambda k: int(headers[k]) if k in headers else None
        size = len(payload) if payload is not None else number("X-Payload-Length")
        return number("X-Page-Id"), headers.get("WARC-Target-URI"), payload if payloads else None, size, digest, kind, number("X-Refers-To-Page-Id"), name, entry["offset"], entry["length"]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return files.select("file", "sidecar").repartition(tasks, "file").mapInArrow(read, RECORDS)


def archive(pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Pages (page_id, url, html) through archives and back: one row a record, in the columns of ``RECORDS``.

    Of records with equal payloads of at least ``least_bytes`` bytes the smallest page_id is a
    response and the others revisit it. Null html is an empty payload; a null page_id comes last
    in that order and stays null; of repeated rows and ids one is the response and its copies
    revisit it. Other columns are not read; an empty table gives no rows and writes no file."""
    scratch = Scratch(pages.sparkSession, "warc")
    crawl, normal = scratch.path("crawl"), scratch.path("normal")
    index = scratch.write(write_crawl(pages, crawl), "index")
    tasks = tasks_for(index)
    files = scratch.write(normalise(revisits(index, least_bytes), crawl, normal, tasks), "files")
    scratch.drop("crawl")
    return read_archives(files, normal, tasks, payloads)


def warc_query(spark, sf_dir: str) -> DataFrame:
    d = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False)
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CODES = ", ".join(f"'{i:05b}'" for i in range(32))
_HEX = ", ".join(f"'{i:04b}'" for i in range(16))
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(string_split(sha1(html), ''), lambda c: [{_HEX}][instr('0123456789abcdef', c)]), '') AS bits FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_position([{_CODES}], substr(bits, 5 * i + 1, 5))::INT, 1)), '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
