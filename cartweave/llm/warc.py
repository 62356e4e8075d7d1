"""WARC archives with an index that comes first.

``write`` makes archive files of compressed records in a folder that all executors share, and returns the index: file, offset, length,
URL, digest and type of each record. ``read`` takes index rows, sorts them by file and offset, joins ranges that are close to one read
of at most ``READ_BYTES``, and parses the records. A record can so be fetched without reading what stands around it.

Files are written under a name that no other attempt of a task has, and the index is checkpointed, so it only knows files of
attempts that succeeded. Paths are opened through Arrow's file systems (local, HDFS, S3, ...).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fresh_dir

GAP_BYTES, READ_BYTES = 65_536, 8_000_000
SALTS = 32  #: parts in which the copies of a payload are dealt to writers
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


def _opened(path: str):
    """(file system, path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value stays on its line."""
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit without the payload but with its length in the HTTP header."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, url, digest, record_type, refers_to, payload_bytes and payload (None for a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.partition(":")[2]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:"))
    number = lambda x: int(d) if (d := x.removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "digest": fields["warc-payload-digest"].removeprefix("sha1:"), "record_type": fields["warc-type"],
        "refers_to": number(fields["warc-refers-to"]) if revisit else None, "payload_bytes": size, "payload": None if revisit else payload,
    }


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """The index (see INDEX) of the records of pages (page_id, url, html), one for each row.

    Of rows with equal payloads of at least ``least`` bytes those with the smallest page_id are responses, the others revisits that
    refer to it. Null html is an empty payload. A row without page_id is a response of its own.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("hash", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    # Only payloads that occur again are looked up; one copy, or a third of all rows, make no difference to the summed counts.
    first = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("hash", "first")

    def run(batches):
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, where = _opened(path)
        out, at = None, 0
        for b in batches:
            index = []
            for page_id, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                if out is None:
                    system.create_dir(where.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(where, compression=None)
                payload = html.encode()
                digest = payload_digest(payload)
                other = first if first is not None and page_id is not None and page_id != first else None
                raw = gzip.compress(record(page_id, url, payload, digest, other), 1, mtime=0)
                out.write(raw)
                index.append((page_id, path, at, len(raw), url, digest, "response" if other is None else "revisit", other))
                at += len(raw)
            if index:
                columns = list(zip(*index, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return cut(salted.join(first, ["hash", "salt"], "left").select("page_id", "url", "html", "first").mapInArrow(run, INDEX))


def ranges(index: DataFrame) -> DataFrame:
    """(file, start, parts): sorted records of a file that are read at once; parts are (offset, length).

    Neighbours join unless more than GAP_BYTES lie between them; a read ends at a multiple of READ_BYTES. There is a task for each READ_BYTES of
    records, as rows of the index say nothing of how much there is to read.
    """
    stripe = F.floor(F.col("offset") / READ_BYTES)
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES
    by = Window.partitionBy("file", "stripe").orderBy("offset")
    end_before = F.lag(F.col("offset") + F.col("length")).over(by)
    new = F.when(F.col("offset") - end_before <= GAP_BYTES, 0).otherwise(1)
    dealt = index.select("file", "offset", "length", stripe.alias("stripe")).repartition(tasks, "file", "stripe")
    runs = dealt.withColumn("run", new).withColumn("run", F.sum("run").over(by))
    return runs.groupBy("file", "stripe", "run").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts")).select("file", F.element_at("parts", 1).offset.alias("start"), "parts")


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that index rows (file, offset, length) point to: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    The digest of a response is computed from its payload and must be the one of its header. ``payloads=False`` leaves payload null.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches):
        opened: dict[str, object] = {}
        for b in batches:
            for file, start, parts in zip(*(b.column(c).to_pylist() for c in ("file", "start", "parts")), strict=True):
                if file not in opened:
                    for f in opened.values():
                        f.close()
                    system, where = _opened(file)
                    opened = {file: system.open_input_file(where)}
                opened[file].seek(start)
                block, rows = opened[file].read(parts[-1]["offset"] + parts[-1]["length"] - start), []
                for p in parts:
                    r = parse(zlib.decompress(block[p["offset"] - start : p["offset"] - start + p["length"]], 31))
                    if r["payload"] is not None and (len(r["payload"]) != r["payload_bytes"] or payload_digest(r["payload"]) != r["digest"]):
                        raise ValueError(f"{file} at {p['offset']}: the payload is not that of the header")
                    rows.append((r["page_id"], r["url"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"], r["payload"] if payloads else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        for f in opened.values():
            f.close()

    return ranges(index).mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from the archives."""
    index = write(pages, fresh_dir(pages.sparkSession, "warc"))
    return read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
