"""WARC archives: one gzip member per record, and a splittable reader.

Writing: each task writes archives of at most ARCHIVE_BYTES, under names that follow from its number, by
way of a temporary name; a task that runs again writes the same files. Of records with equal payloads of
at least MIN_SHARED bytes, that with the smallest id is a response, the others are revisits of it.

Reading: a task scans a byte range for the gzip magic, decodes each candidate, and takes it for a record
if it says WARC and has a head that ends, however long the head is. It owns the records that start inside
its range, and reads the last one past the range's end. A member inside another one (an archive stored in
an archive) is left out.

Defined results: a null html is an empty payload. A null id is written as 'null' and read back as null;
rows equal in id and payload are all responses if one is. An empty table gives no archive and no records.
Extra columns are not written.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm import common as C

MIN_SHARED = 100
ARCHIVE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
#: Tasks that read; with more ranges, a task reads several.
MAX_TASKS = 50_000
#: Digests of shared payloads are broadcast up to this number (about 100 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST = 200_000
MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile("[^!-~]")


def with_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Add payload_digest, payload_bytes, record_type and refers_to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = C.without(pages, ["payload_digest", "payload_bytes", "record_type", "refers_to"])
    pages = pages.withColumns({"payload_digest": F.sha2(html, 256), "payload_bytes": F.octet_length(html).cast("long")})
    shared = pages.where(F.col("payload_bytes") >= MIN_SHARED).groupBy("payload_digest").agg(F.min(id_col).alias("__first"), F.count("*").alias("n")).where("n > 1")
    shared = C.stored(shared.select(F.col("payload_digest").alias("__digest"), "__first"), "shared")
    if shared.count() <= MAX_BROADCAST:
        shared = F.broadcast(shared)
    other = F.col("__first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first"))
    out = pages.join(shared, F.col("payload_digest") == F.col("__digest"), "left")
    return out.withColumns({"record_type": F.when(other, F.lit("revisit")).otherwise(F.lit("response")), "refers_to": F.when(other, F.col("__first"))}).drop("__digest", "__first")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    block = _HTTP + (payload if refers_to is None else b"")
    target = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_PROFILE}", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages below uri, a folder that all tasks share. Returns (path, length, records) of the archives."""
    C.small_batches(pages.sparkSession)
    fed = with_types(pages, id_col, html_col).select(F.col(id_col).cast("string"), url_col, F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"), "payload_digest", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(uri)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt, made = context.partitionId(), context.taskAttemptId(), []
        out = final = temporary = None

        def close():
            nonlocal out
            if out is not None:
                length = out.tell()
                out.close()
                store.move(temporary, f"{root}/{final}")
                made.append((f"{uri}/{final}", length, n))
                out = None

        n = 0
        for batch in batches:
            for page, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    final, n = f"pages-{part:06d}-{len(made):04d}.warc.gz", 0
                    temporary = f"{root}/.{final}.{attempt}"
                    out = store.open_output_stream(temporary)
                out.write(member(record(page, url, payload, digest, refers_to)))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "length", "records"])

    return C.stored(fed.mapInArrow(run, "path string, length long, records long"), "archives")


class _Range:
    """Bytes of a file from `start` on, read as far as asked for."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.data, self.over = file, start, b"", False
        self.more(end - start + len(MAGIC))

    def more(self, n: int) -> bool:
        if not self.over:
            self.file.seek(self.start + len(self.data))
            got = self.file.read(n)
            self.over = len(got) < n
            self.data += got
            return bool(got)
        return False


def _member_at(r: _Range, i: int) -> tuple[bytes, int] | None:
    """The decoded member at offset i of the range and the offset after it, or None if it isn't a WARC record."""
    z, out, at, size = zlib.decompressobj(31), [], i, 0
    checked = False
    try:
        while not z.eof:
            if at >= len(r.data) and not r.more(1 << 20):
                return None
            chunk = r.data[at : at + 65536]
            got = z.decompress(chunk)
            at += len(chunk)
            out.append(got)
            size += len(got)
            if not checked and (size >= 10 or z.eof):
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, at - len(z.unused_data)) if b"\r\n\r\n" in data else None


def records_in(file, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, offset after it, decoded record) of the members that start in [start, end)."""
    r, i = _Range(file, start, end), 0
    while True:
        i = r.data.find(MAGIC, i)
        if i < 0 or start + i >= end:
            return
        if got := _member_at(r, i):
            yield start + i, start + got[1], got[0]
            i = got[1]
            if start + i >= end:
                return
        else:
            i += 1


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, lower-cased, and the payload: what follows the HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    if "application/http" in fields.get("content-type", ""):
        block = block.partition(b"\r\n\r\n")[2]
    return fields, block


def archives(spark: SparkSession, uri: str) -> DataFrame:
    """(path, length) of the archives below uri; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(uri).select("path", "length")


SCHEMA = "path string, split long, offset long, after long, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """The records of the archives in files (path, length), by ranges of split_bytes. payload=False leaves payloads out, but for their length and SHA-256."""
    splits = files.where("length > 0").select("path", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"), "length")
    splits = C.stored(splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("end")), "splits")
    n = min(MAX_TASKS, max(1, splits.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = _filesystem(path)
                rows, held = [], 0
                with store.open_input_file(at) as file:
                    for offset, after, data in records_in(file, start, end):
                        rows.append(_row(path, start, offset, after, data, payload))
                        held += len(data) if payload else 200
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    found = C.stored(splits.repartition(n).mapInArrow(run, SCHEMA), "records")
    # a range's own records don't overlap; how far those of earlier ranges reach takes one row a range
    reach = found.groupBy("path", F.col("split").alias("start")).agg(F.max("after").alias("after"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = splits.select("path", "start").join(reach, ["path", "start"], "left").select("path", F.col("start").alias("split"), F.max("after").over(before).alias("__covered"))
    return found.join(covered.where("__covered > split"), ["path", "split"], "left").where("__covered is null or offset >= __covered").drop("__covered")


def _row(path: str, split: int, offset: int, after: int, data: bytes, payload: bool) -> tuple:
    fields, body = parse(data)
    kind = fields.get("warc-type", "")
    number = lambda name: None if (v := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) in ("", "null") else v
    if kind == "revisit":
        size, digest, body = int(fields.get("x-payload-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha256:"), b""
    else:
        size, digest = len(body), hashlib.sha256(body).hexdigest()
    return path, split, offset, after, number("warc-record-id"), fields.get("warc-target-uri"), kind, number("warc-refers-to"), size, digest, body if payload else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    kinds = [s, n, n, n, s, s, s, s, n, s, pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
