"""WARC records in ZIP packages: writing them, and reading single records by byte range without extraction.

A package is a ZIP file whose members are stored, not compressed again: ``archive/data.warc.gz`` with the records, each a gzip
member of its own, and ``indexes/index.cdxj`` with one line per record (key, time, JSON with the record's offset and length
in the member). The reader parses the end-of-directory record, its ZIP64 forms where present, and the central directory, places the stored
members by their local headers, and reads the index and then only the bytes of the records that are asked for.

Records with equal payloads of at least ``least`` bytes are written once: that with the largest page_id is the response, the others are
revisits that refer to it. A null html is an empty payload; a null url is written as ``urn:page:<page_id>``. Repeated
page_ids are separate records; of equal payloads with one page_id, one is the response and the others revisit it, and a null page_id counts as
the smallest. Control characters, blanks and line separators in a url are percent-encoded. Extra columns are ignored. An empty table gives
no packages. Pages are written in runs of bounded size, a very long one by itself.

Each attempt of a task writes a package under a name of its own; the manifest names those that count.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import urllib.parse
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .bpe import runs
from .store import Scratch

LEAST = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"  # the tables hold no capture time
_EOCD, _EOCD64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def record(kind: str, uri: str, name: str, payload: bytes, fields: dict[str, str]) -> bytes:
    """One WARC/1.1 record."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": _DATE, "WARC-Target-URI": uri, **fields, "Content-Length": str(len(payload))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names) and the block of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not gap or not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """The stored members of a ZIP file: name -> (offset of the data, length). f: seek() and read()."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        out = f.read(n)
        if len(out) != n:
            raise ValueError("the ZIP file is cut short")
        return out

    tail_at = max(0, size - 65557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(_EOCD)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_EOCD, 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = at(tail_at + end - 20, 20)
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        large = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if large[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", large, 32)
    directory, p, out = at(start, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != _ENTRY:
            raise ValueError("damaged central directory")
        method, packed, full, n_name, n_extra, n_note = struct.unpack_from("<H8xIIHHH", directory, p + 10)
        local = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode()
        q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= stop:
            tag, n = struct.unpack_from("<HH", directory, q)
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", directory, q + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            q += 4 + n
        p = stop + n_note
        if method == 0:
            head = at(local, 30)
            if head[:4] != _LOCAL or packed != full:
                raise ValueError(f"damaged member {name}")
            a, b = struct.unpack_from("<HH", head, 26)
            out[name] = (local + 30 + a + b, full)
    return out


def plan(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Which page is a response and which a revisit: page_id, uri, html, digest, size, revisit, refers_to.

    Payloads are compared by SHA-1 and length. Only these travel to find equal ones, and greatest rows combine before the shuffle; the pages
    themselves are joined by their own rows, so that a page that very many share is no hot key.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = repeats.keyed(pages.select(F.col("page_id").cast("long").alias("doc_id"), text.alias("text"), F.col("url").cast("string").alias("url")), scratch)
    payload = F.encode("text", "UTF-8")
    marked = rows.select("row", "doc_id", F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("size")).where(F.col("size") >= least)
    first = marked.groupBy("digest", "size").agg(F.max(F.struct("row", "doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = marked.join(first, ["digest", "size"]).where("row <> first.row").select("row", F.col("first.doc_id").alias("refers_to"), F.lit(True).alias("revisit"))
    out = rows.join(revisits, "row", "left")
    uri = F.coalesce("url", F.concat(F.lit("urn:page:"), F.col("doc_id").cast("string")))
    digest, size = F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("size")
    return out.select(F.col("doc_id").alias("page_id"), uri.alias("uri"), payload.alias("html"), digest, size, F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")


def _name(page_id) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def safe(uri: str) -> str:
    """A uri without characters that part lines or fields: control characters, blanks and line separators are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: urllib.parse.quote(m[0], safe=""), uri)


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write one package per partition under the URI ``folder``. Rows: package, records."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.wacz"
        lines, at = [], 0
        with store.open_output_stream(f"{base}/{name}") as raw, zipfile.ZipFile(io.BufferedWriter(_Sink(raw)), "w", zipfile.ZIP_STORED) as z:
            with z.open(DATA, "w", force_zip64=True) as out:
                for b in (part for whole in batches for part in runs(whole, whole.schema.get_field_index("html"))):
                    for r in b.to_pylist():
                        page = r["page_id"]
                        fields = {"WARC-Payload-Digest": f"sha1:{r['digest']}", "WARC-Payload-Length": str(r["size"]), "WARC-Page": "" if page is None else str(page)}
                        uri = safe(r["uri"]) if r["uri"] else _name(page)
                        if not r["revisit"]:
                            data = record("response", uri, _name(page), r["html"], fields)
                        else:
                            fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{_name(r['refers_to'])}>"}
                            data = record("revisit", uri, f"{_name(page)}:revisit", b"", fields)
                        data = gzip.compress(data, 1, mtime=0)
                        out.write(data)
                        lines.append(f"{uri} {_DATE} {json.dumps({'offset': at, 'length': len(data)})}\n")
                        at += len(data)
            z.writestr(INDEX, "".join(lines))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64())], names=["package", "records"])

    return planned.mapInArrow(run, "package string, records long")


class _Sink(io.RawIOBase):
    """A write-only view of a stream; the ZIP writer then keeps sizes behind the data and in the directory."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def locate(packages: DataFrame, folder: str) -> DataFrame:
    """The records that the packages' indexes list: package, offset (in the file), length."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as f:
                    found = members(f, f.size())
                    f.seek(found[INDEX][0])
                    lines = f.read(found[INDEX][1]).decode().split("\n")[:-1]
                spans = [json.loads(x.split(" ", 2)[2]) for x in lines]
                at = found[DATA][0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(spans), pa.string()), pa.array([at + s["offset"] for s in spans], pa.int64()), pa.array([s["length"] for s in spans], pa.int64())], names=["package", "offset", "length"]
                )

    return packages.select("package").mapInArrow(run, "package string, offset long, length long")


def read(located: DataFrame, folder: str) -> DataFrame:
    """Range-read records: page_id, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to.

    The digest of a response is taken from the bytes read and must equal its header's.
    """

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        now, f = None, None
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                rows = []
                for name, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if name != now:
                        now, f = name, store.open_input_file(f"{base}/{name}")
                    f.seek(offset)
                    fields, payload = parse(gzip.decompress(f.read(length)))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["warc-payload-length"])):
                        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
                    target = fields.get("warc-refers-to", "")[1:-1].removeprefix("urn:page:")
                    rows.append((int(fields["warc-page"]) if fields["warc-page"] else None, kind, payload if kind == "response" else None, int(fields["warc-payload-length"]), digest, int(target) if target else None))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])

    return located.mapInArrow(run, "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to packages in the shared folder, read every record back, and describe it."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path("packages")
    packages = scratch.table(write(plan(pages, scratch), folder), "written")
    located = scratch.table(locate(packages.repartition(max(1, packages.count())), folder), "index")
    # In the order of the files, so that each task reads few packages from front to back.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = located.repartitionByRange(parts, "package", "offset").sortWithinPartitions("package", "offset")
    return read(ordered, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH marked AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM marked),
placed AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first
  FROM digests WINDOW w AS (PARTITION BY payload_bytes, payload_digest ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN first END AS refers_to
FROM placed
"""
