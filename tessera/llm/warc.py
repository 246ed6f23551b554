"""Web archives in ZIP packages: a writer, and a reader that finds records by the ZIP directory and an index and reads only their ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


@dataclass(frozen=True)
class WarcParams:
    """least: payloads of fewer bytes are never revisits; archive_bytes: compressed records in a package; level: of gzip."""

    least: int = 0
    archive_bytes: int = 16_000_000
    level: int = 1


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit has the HTTP head only and names what it repeats."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:x-page:{'null' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c <= " " or c in "%\x7f" else c for c in url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF + block + CRLF + CRLF


def package(records: list[bytes], index: list[str]) -> bytes:
    """A ZIP whose members are stored: the gzipped records one after another, their index and a description."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, b"".join(records)), (INDEX, "".join(index).encode("utf-8", "surrogatepass")), ("datapackage.json", json.dumps({"profile": "data-package", "records": len(records)}).encode())):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=len(data) >= zipfile.ZIP64_LIMIT) as f:
                f.write(data)
    return out.getvalue()


class ZipDirectory:
    """Places of a ZIP's members from its central directory, with the ZIP64 forms, by range reads alone."""

    def __init__(self, read, size: int):
        self.read = read
        tail = read(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<H2I", tail[at + 10 : at + 20])
        base = size - len(tail)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start) or (at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7"):
            locator = read(base + at - 20, 20)
            if locator[:4] == b"PK\6\7":
                end = read(struct.unpack("<Q", locator[8:16])[0], 56)
                if end[:4] != b"PK\6\6":
                    raise ValueError("no ZIP64 end of central directory")
                count, length, start = struct.unpack("<3Q", end[32:56])
        self.members: dict[str, tuple[int, int, int]] = {}
        raw, i = read(start, length), 0
        for _ in range(count):
            if raw[i : i + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, = struct.unpack("<H", raw[i + 10 : i + 12])
            packed, full = struct.unpack("<2I", raw[i + 20 : i + 28])
            n, extra, comment = struct.unpack("<3H", raw[i + 28 : i + 34])
            offset, = struct.unpack("<I", raw[i + 42 : i + 46])
            name, more = raw[i + 46 : i + 46 + n].decode("utf-8"), raw[i + 46 + n : i + 46 + n + extra]
            while len(more) >= 4:
                tag, m = struct.unpack("<2H", more[:4])
                if tag == 1:
                    values = list(struct.unpack(f"<{m // 8}Q", more[4 : 4 + m // 8 * 8]))
                    full = values.pop(0) if full == 0xFFFFFFFF else full
                    packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = values.pop(0) if offset == 0xFFFFFFFF else offset
                more = more[4 + m :]
            self.members[name] = (offset, packed, method)
            i += 46 + n + extra + comment

    def place(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's data."""
        offset, packed, method = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored")
        head = self.read(offset, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        n, extra = struct.unpack("<2H", head[26:30])
        return offset + 30 + n + extra, packed


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if fields.get("warc-block-digest", "").removeprefix("sha1:") != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"checksum of {fields.get('warc-record-id')}")
    return fields, block


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return None if name in ("", "null") else int(name)


def write_archives(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Writes packages of pages(page_id, url, html) to the shared folder; returns path, n_records of each.

    Of records with equal payloads of at least params.least bytes, the one with the smallest page_id is the response and the others
    revisit it; of repeated rows with that page_id all are responses; so are rows with a null page_id. A null html is empty, a null
    url ""; its control characters, spaces and percent signs are percent-encoded in the record and come back as they were. Records of
    rows with one page_id share their record id. A file gets a name of its own for each attempt and counts only by its row in the result, so a task that is lost and run
    again leaves no doubles. The digest join carries each page once; a digest that many pages share is split by skew handling.
    """
    p, target = params, scratch_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    shared = rows.where((F.octet_length("html") >= p.least) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("of"), "first")
    rows = rows.join(shared, rows["sha"] == shared["of"], "left").select("page_id", "url", "html", "sha", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("first"))

    def run(batches):
        store, root = pafs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        records, index, size = [], [], 0

        def close():
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as out:
                out.write(package(records, index))
            return pa.RecordBatch.from_pydict({"path": [f"{target}/{path.rpartition('/')[2]}"], "n_records": pa.array([len(records)], pa.int64())})

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for page_id, url, html, sha, first in zip(*cols, strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                raw = gzip.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first, first is not None), p.level, mtime=0)
                index.append(f"{''.join(url.split()) or '-'} 20240101000000 {json.dumps({'offset': size, 'length': len(raw), 'page': page_id, 'bytes': len(html.encode('utf-8', 'surrogatepass'))})}\n")
                records.append(raw)
                size += len(raw)
                if size >= p.archive_bytes:
                    yield close()
                    records, index, size = [], [], 0
        if records:
            yield close()

    return written(rows.mapInArrow(run, "path string, n_records long"), "warc-files")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits) of each record of the packages in files(path, ...)."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:

                    def read(at, n, f=f):
                        f.seek(at)
                        return f.read(n)

                    zipped = ZipDirectory(read, f.size())
                    start, _ = zipped.place(ARCHIVE)
                    lines = read(*zipped.place(INDEX)).decode("utf-8", "surrogatepass").split("\n")[:-1]
                    for i in range(0, len(lines), 200):
                        out = []
                        for line in lines[i : i + 200]:
                            entry = json.loads(line.split(" ", 2)[2])
                            fields, block = parse_record(gzip.decompress(read(start + entry["offset"], entry["length"])))
                            head, _, payload = block.partition(CRLF + CRLF)
                            revisit = fields["warc-type"] == "revisit"
                            digest = fields["warc-payload-digest"].removeprefix("sha1:")
                            if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"payload checksum in {path}")
                            length = int(next(x.partition(b":")[2] for x in head.split(CRLF) if x.lower().startswith(b"content-length")))
                            out.append((_page(fields["warc-record-id"]), unquote(fields["warc-target-uri"], errors="surrogatepass"), length, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), None if revisit or not with_payload else payload.decode("utf-8", "replace")))
                        cols = list(zip(*out, strict=True))
                        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    n = max(1, files.count())
    got = files.select("path").repartition(n).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
    return got if with_payload else got.drop("payload")
