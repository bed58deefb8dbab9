"""WARC records in ZIP archives: writing with revisits, reading by ranges.

Writing: the payload of a page is its html in UTF-8. Payloads are compared by SHA-1; of equal
ones the page with the largest page_id becomes a ``response`` record, the others become
``revisit`` records that refer to it (identical-payload-digest profile) and carry HTTP headers
only. Digests of several pages are broadcast where they are few enough (then no page is shuffled, however many share
a payload), else joined by shuffle. Each record is a gzip member of its own. A task packs records into archives of about
``ARCHIVE_BYTES``: a ZIP file with the stored members ``archive/data.warc.gz`` and
``indexes/index.txt`` (offset and length of each record). Archives get new names; only those
of tasks that succeeded are in the manifest, which is written to the shared folder.

Reading: one row of the manifest is one archive. The reader takes the end of the file, finds
the end-of-central-directory record (or, where its fields overflow, the ZIP64 locator and
record), parses the central directory with ZIP64 extra fields, locates the members by their
local headers, reads the index and then fetches runs of records in ranges of at most
``RANGE_BYTES``; nothing is extracted. A response's digest is computed from its payload and
compared with its header; of a revisit, digest and length are those its headers state.

Defined results: a null html is an empty payload; a null url leaves the target header out;
a row with a null page_id is a revisit if a row with a page_id has its payload, else a
response; repeated rows of the largest page_id are all responses; an empty table gives no
archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import bounded, materialise, shared_dir, table
from .tokenfiles import open_fs, write_bytes

ARCHIVE_BYTES, RANGE_BYTES = 16 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.txt"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; refers_to makes it a revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """Of a gzip member: page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    number = lambda s: int(s) if (s := s.strip("<>").removeprefix("urn:page:")) else None
    revisit = fields["warc-type"] == "revisit"
    if not revisit and digest_of(payload) != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have the digest that its header states")
    stated = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length")
    return {
        "page_id": number(fields["warc-record-id"]),
        "payload_bytes": stated if revisit else len(payload),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": number(fields["warc-refers-to"]) if revisit else None,
        "url": fields.get("warc-target-uri"),
        "payload": None if revisit else payload,
    }


def pack(records: list[bytes]) -> bytes:
    """A ZIP archive of records with their index, both stored."""
    index, at = [], 0
    for r in records:
        index.append(f"{at} {len(r)}\n")
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(DATA, b"".join(records))
        z.writestr(INDEX, "".join(index))
    return out.getvalue()


class ZipReader:
    """Members of a ZIP archive that can be read by ranges (size(), seek(), read())."""

    def __init__(self, source):
        self.source = source
        self.members = {name: rest for name, *rest in self._directory()}

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _directory(self) -> Iterator[tuple[str, int, int, int, int]]:
        """(name, method, stored size, size, offset of the local header) of each member."""
        size = self.source.size()
        start = max(0, size - 22 - FULL_16)
        tail = self._at(start, size - start)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of a central directory")
        count, length, offset = struct.unpack_from("<HII", tail, end + 10)
        if FULL_16 == count or FULL_32 in (length, offset):
            locator = self._at(start + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record64 = self._at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of a central directory")
            count, length, offset = struct.unpack_from("<QQQ", record64, 32)
        raw, at = self._at(offset, length), 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            method, = struct.unpack_from("<H", raw, at + 10)
            stored, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
            header, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, stored, header = self._wide(extra, full, stored, header)
            yield name, method, stored, full, header
            at += 46 + n_name + n_extra + n_note

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values with those that overflow taken from the ZIP64 extra field, in its order."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                return [next(wide) if v == FULL_32 else v for v in values]
            at += 4 + n
        return list(values)

    def start(self, name: str) -> int:
        """Offset of a stored member's first byte."""
        method, _, _, header = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        n_name, n_extra = struct.unpack_from("<HH", self._at(header, 30), 26)
        return header + 30 + n_name + n_extra

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        stored = self.members[name][1]
        length = stored - offset if length is None else length
        if offset < 0 or offset + length > stored:
            raise ValueError(f"the range is outside {name}")
        return self._at(self.start(name) + offset, length)


def read_records(archive: ZipReader, range_bytes: int = RANGE_BYTES) -> Iterator[dict]:
    """Parsed records of an archive, fetched in runs of neighbours."""
    entries = [tuple(map(int, x.split())) for x in archive.read(INDEX).splitlines()]
    i = 0
    while i < len(entries):
        j, first = i, entries[i][0]
        while j < len(entries) and (j == i or entries[j][0] == sum(entries[j - 1]) and sum(entries[j]) - first <= range_bytes):
            j += 1
        raw = archive.read(DATA, first, sum(entries[j - 1]) - first)
        for at, n in entries[i:j]:
            yield parse_record(raw[at - first : at - first + n])
        i = j


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in folder; returns the manifest (url, n_records)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    repeated = rows.groupBy("sha").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    rows = rows.join(bounded(materialise(repeated)), "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches):
        held, size = [], 0

        def flush():
            url = f"{folder}/{uuid.uuid4().hex}.zip"
            write_bytes(url, pack(held))
            return pa.RecordBatch.from_pylist([{"url": url, "n_records": len(held)}])

        for batch in batches:
            for part in slices(batch, 128):
                for page_id, url, html, refers_to in zip(*(part.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to"))):
                    payload = html.encode("utf-8")
                    held.append(record(page_id, url, payload, digest_of(payload), refers_to))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return materialise(rows.mapInArrow(run, "url string, n_records long"))


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives of a manifest (see FIELDS)."""
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
    schema = pa.schema(list(types.items()))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(row["url"])
                with fs.open_input_file(path) as source:
                    held = []
                    for r in read_records(ZipReader(source)):
                        held.append(r)
                        if len(held) == 128:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                    yield pa.RecordBatch.from_pylist(held, schema)

    return manifest.repartition(max(1, manifest.count()), "url").mapInArrow(run, FIELDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(hexadecimal: str) -> str:
    """DuckDB SQL for the base32 of 40 hexadecimal digits: 5 digits are 4 characters."""
    group = lambda i: f"CAST('0x' || substr({hexadecimal}, {5 * i + 1}, 5) AS INTEGER)"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({group(i)} >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM p),
r AS (SELECT *, CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN response END AS refers_to FROM g)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_base32_sql('h')} AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""
