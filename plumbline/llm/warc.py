"""WARC archives: a writer with revisit records, and a salvage reader.

Writing. A record per page, each a gzip member of its own. Pages with equal payloads are found by an aggregation on
the SHA-1; the one with the largest id is the response, the others are revisits that refer to it. Where the table of
equal payloads is too large to broadcast, a hot payload (the empty one, say) is one row of it, and Spark's adaptive
skew join splits its pages. The members of an archive are one row of Spark's own text writer, a file each, so any
Hadoop file system works and the commit protocol keeps exactly one copy of each file when tasks are retried. A gzip
member of under 16 MiB ends with a NUL byte (the top byte of its length), and an empty member follows a larger one;
the row leaves the last byte out and the line separator, NUL, puts it back.

Reading. Archives are read as binary files and walked record by record: gzip members (CRC and length checked) or plain
records; version line, headers, length, end mark and payload digest are checked. After a failed check the reader
searches for the next valid member or version line and goes on there; the bytes in between are returned as a gap
with the reason. Records that a damaged member gives before its damage are kept. An archive is held whole by the
task that reads it; the writer ends an archive once it has ``archive_bytes`` bytes or ``records_per_file`` records.

Cases. Null html: an empty payload. Null url: no target header. Null page_id: sorts below all ids, a record without a
number. Repeated page_ids with equal payloads: all of the largest id are responses. Very long pages and urls are kept
whole, a page over ``archive_bytes`` in an archive of its own. Empty table: no records. Empty archives: no records, no
gaps. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read, saved

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
#: Every record has these headers.
NEEDED = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"}
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r\n")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if pd.isna(page_id) else int(page_id)}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response record, or with refers_to a revisit record."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def member(data: bytes, level: int = 4) -> bytes:
    """data as a gzip member that ends with NUL."""
    press = zlib.compressobj(level, wbits=31)
    out = press.compress(data) + press.flush()
    if out[-1]:
        empty = zlib.compressobj(wbits=31)
        out += empty.flush()
    return out


def _archives(archive_bytes: int, records_per_file: int):
    """A row per archive, without its last byte. Ids are strings here: as numbers, pandas would round them beside nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for batch in batches:
            for page_id, url, html, best, revisit in zip(batch["page_id"], batch["url"], batch["html"], batch["best"], batch["revisit"]):
                payload = (html or "").encode("utf-8", "replace")
                one = member(record(page_id, url, payload, best if revisit else None))
                if out and size + len(one) > archive_bytes:
                    yield pd.DataFrame({"value": [b"".join(out)[:-1]]})
                    out, size = [], 0
                out.append(one)
                size += len(one)
                if len(out) >= records_per_file:
                    yield pd.DataFrame({"value": [b"".join(out)[:-1]]})
                    out, size = [], 0
        if out:
            yield pd.DataFrame({"value": [b"".join(out)[:-1]]})

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 100_000, archive_bytes: int = 64 << 20) -> None:
    """Writes pages (page_id, url, html) to *.warc.gz files in path. Payloads under min_bytes are always responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    equal = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
    # its size is known once it is written: small, it is broadcast, and the payloads aren't shuffled
    shared = saved(equal.where("n > 1 and best is not null").select("digest", "best"), "warc-shared")
    marked = rows.join(shared, "digest", "left").withColumn("revisit", F.coalesce(~F.col("best").eqNullSafe(F.col("page_id")), F.lit(True)) & F.col("best").isNotNull() & (F.octet_length("html") >= min_bytes))
    out = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("best").cast("string").alias("best"), "revisit").mapInPandas(_archives(archive_bytes, records_per_file), "value binary")
    out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # a task that had no page leaves an empty file
    files = [(f.getPath(), f.getLen()) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".txt")]

    def named(file) -> None:
        if file[1]:
            fs.rename(file[0], spark._jvm.org.apache.hadoop.fs.Path(folder, file[0].getName()[:-4] + ".warc.gz"))
        else:
            fs.delete(file[0], False)

    with ThreadPoolExecutor(32) as pool:  # a file system answers many at once
        list(pool.map(named, files))


def _before_damage(data: memoryview, at: int, step: int = 512) -> bytes:
    """What a member gives, in small steps, before its error."""
    d, out, p = zlib.decompressobj(31), [], at
    try:
        while not d.eof and (p < len(data) or d.unconsumed_tail):
            chunk = d.unconsumed_tail or data[p : p + 4096]
            p += 0 if d.unconsumed_tail else len(chunk)
            out.append(d.decompress(chunk, step))
    except zlib.error:
        pass
    return b"".join(out)


def _unzip(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """What the member at a place gives, where it ends, and what is wrong with it, if anything."""
    d, out, size = zlib.decompressobj(31), [], 4096
    p = at
    try:
        while not d.eof and p < len(data):
            chunk = data[p : p + size]
            out.append(d.decompress(chunk))
            p += len(chunk)
            size = min(size * 2, 1 << 20)
    except zlib.error as e:
        return _before_damage(data, at), p, f"gzip: {str(e)[:60]}"
    if not d.eof:
        return b"".join(out), p, "gzip: cut off"
    return b"".join(out), p - len(d.unused_data), ""


def _parse(data: bytes | memoryview, at: int) -> tuple[dict | None, int, str]:
    """The record at a place, where it ends, or what is wrong."""
    head_end = -1
    window = 4096
    while head_end < 0:
        part = bytes(data[at : at + window])
        head_end = part.find(END)
        if head_end < 0:
            if len(part) < window:
                return None, at, "no end of headers"
            window *= 4
    lines = part[:head_end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[0-9]", lines[0]):
        return None, at, "no version line"
    head = {}
    names = [line.partition(b":")[0].strip().lower() for line in lines]
    for i, line in enumerate(lines[1:], 1):
        k, sep, v = line.partition(b":")
        if not sep:
            return None, at, "bad header"
        name = k.strip().lower().decode("latin-1")
        # a record cut off within its headers, and the next, which brings all that every record has; a value may end like a version line
        if (name == "warc-type" and name in head) or (v.endswith(lines[0]) and NEEDED.issubset(names[i + 1 :])):
            return None, at, "headers cut off"
        head[name] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
        return None, at, "bad length"
    begin = at + head_end + len(END)
    end = begin + int(head["content-length"])
    if bytes(data[end : end + len(END)]) != END:
        return None, at, "no end mark"
    block = bytes(data[begin:end])
    http_end = block.find(END)
    http, payload = (block[:http_end], block[http_end + len(END) :]) if http_end >= 0 and block.startswith(b"HTTP/") else (b"", block)
    digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    kind = head.get("warc-type")
    told = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", http)
    if kind == "revisit":
        size = int(told[1]) if told else None
    else:
        size, found = len(payload), sha1_base32(payload)
        if digest and digest != found:
            return None, at, "payload digest"
        digest = digest or found
    number = lambda urn: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")) else None
    uri = head.get("warc-target-uri")
    return {
        "record_type": kind, "record_id": head.get("warc-record-id"), "page_id": number(head.get("warc-record-id")), "uri": None if uri is None else unquote(uri),
        "refers_to": number(head.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size, "payload": None if kind == "revisit" else payload,
    }, end + len(END), ""


def salvage(data: bytes | pa.Buffer) -> Iterator[dict]:
    """The records of an archive and its gaps, with offset and length in the archive."""
    view = memoryview(data).cast("B")
    at, gap, reason = 0, None, ""
    while at < len(view):
        found, end, bad = [], at, ""
        if view[at : at + 3] == GZIP:
            plain, end, bad = _unzip(view, at)
            p = 0
            while p < len(plain):
                got, q, why = _parse(plain, p)
                if got is None:
                    bad = bad or why
                    m = START.search(plain, p + 1)
                    if not m:
                        break
                    p = m.start()
                    continue
                found.append(got)
                p = q
            if bad and bad.startswith("gzip"):
                end = at
        else:
            got, end, bad = _parse(view, at) if view[at : at + 5] == b"WARC/" else (None, at, "no record")
            if got:
                found.append(got)
        if found or (end > at and not bad):
            if gap is not None:
                yield {"offset": gap, "length": at - gap, "reason": reason}
                gap = None
        for x in found:
            yield {**x, "offset": at, "length": max(end - at, 0)}
        if end > at:
            if bad:  # some record of a sound member is damaged
                yield {"offset": at, "length": end - at, "reason": bad}
            at = end
            continue
        if gap is None:
            gap, reason = at, bad
        m = START.search(view, at + 1)
        at = m.start() if m else len(view)
    if gap is not None:
        yield {"offset": gap, "length": len(view) - gap, "reason": reason}


SCHEMA = "path string, offset long, length long, reason string, record_type string, record_id string, page_id long, uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"
ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def _read_files(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for x in salvage(content.as_buffer()):
                    if not payloads:
                        x.pop("payload", None)
                    rows.append({"path": path.as_py(), **x})
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Rows of SCHEMA: a record each, or a quarantined gap where reason is not null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "content").mapInArrow(_read_files(payloads), SCHEMA)


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    sound = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("op1: gap in an archive just written: "), "reason")).cast("boolean"))
    return read_archives(spark, path).where(sound).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS best FROM pages
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(d, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - i % 4 * 5 AS INT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM p
"""
