"""WARC records in ZIP packages, read by range.

A package holds its WARC file, one gzip member per record, and a CDXJ index of
it as *stored* members, so that a byte range of the package is a byte range of
the WARC file. The reader takes the tail of a package, follows the end record
or its ZIP64 form to the central directory, finds the stored members there,
reads the index, and then only the ranges of records; nothing is extracted.

Executors write and read packages through pyarrow's file systems (local, HDFS,
S3, GCS by the path's scheme). Only packages in the manifest count: what a
lost or repeated task left behind is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shared_path, slices, written

#: Payloads under so many bytes are stored each time.
LEAST_BYTES = 100
#: A package is closed at so many bytes of WARC or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 50_000
#: Neighbouring records are fetched in one range of up to so many bytes.
FETCH = 4 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE, STAMP = "2025-01-01T00:00:00Z", "20250101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# ZIP signatures.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header: int


Fetch = Callable[[int, int], bytes]  # (offset, bytes)


def directory(fetch: Fetch, size: int) -> list[Member]:
    """The members of a ZIP file of that size, from its central directory."""
    tail_at = max(0, size - 65_557)
    tail = fetch(tail_at, size - tail_at)
    end = len(tail)
    while True:  # the last end record whose comment ends with the file
        end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError("no ZIP end record")
        if len(tail) - end >= 22 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    record = tail_at + end
    if record >= 20 and (locator := fetch(record - 20, 20))[:4] == LOCATOR64:
        record = _end64(fetch, record - 20, struct.unpack_from("<Q", locator, 8)[0])
        count, length, start = struct.unpack_from("<QQQ", fetch(record, 56), 32)
    shift = record - length - start  # bytes that stand before the archive
    data, at, found = fetch(start + shift, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: those of the three that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + n
        found.append(Member(name, method, packed, full, header + shift))
        at += 46 + n_name + n_extra + n_comment
    return found


def _end64(fetch: Fetch, locator: int, said: int) -> int:
    """Where the ZIP64 end record stands: as the locator says, or further on by
    what stands before the archive. It ends where the locator begins."""
    for at in (said, locator - 56):
        if 0 <= at <= locator - 56 and (head := fetch(at, 12))[:4] == END64 and at + 12 + struct.unpack_from("<Q", head, 4)[0] == locator:
            return at
    low = max(0, locator - 65_536)  # with data of its own
    near = fetch(low, locator - low)
    at = near.rfind(END64)
    while at >= 0:
        if len(near) - at >= 12 and at + 12 + struct.unpack_from("<Q", near, at + 4)[0] == len(near):
            return low + at
        at = near.rfind(END64, 0, at)
    raise ValueError("the ZIP64 locator leads nowhere")


def stored_at(fetch: Fetch, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed and can't be read by range")
    local = fetch(member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(text: str | None) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed; a revisit keeps the payload's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Refers-To-Page: {refers_to}"]
    head += ["" if page_id is None else f"WARC-Page: {page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(x for x in head if x).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP headers, payload) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines if ": " in line)
    length = int(headers["Content-Length"])
    if len(rest) != length + 4:
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return headers, http, payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, url, html, digest, refers_to -> the manifest (path, records,
    bytes) of the packages written to the folder, as a table."""

    def close(package: zipfile.ZipFile, warc, index: list[str]) -> None:
        warc.close()
        package.writestr(INDEX, "".join(sorted(index)))
        package.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": WARC}, {"path": INDEX}]}))
        package.close()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        sink = package = warc = None
        name, offset, index = "", 0, []

        def done() -> pa.RecordBatch:
            close(package, warc, index)
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([offset], pa.int64())})

        for batch in batches:
            for b in slices(batch, "html"):
                for page_id, url, html, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if package is None:
                        name, offset, index = f"{root}/{uuid.uuid4().hex}.zip", 0, []
                        sink = fs.open_output_stream(name)
                        package = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                        warc = package.open(zipfile.ZipInfo(WARC), "w", force_zip64=True)
                    packed = gzip.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to), 2, mtime=0)
                    warc.write(packed)
                    index.append(f"{_line(url) or '-'} {STAMP} {json.dumps({'page': page_id, 'offset': offset, 'length': len(packed), 'filename': WARC})}\n")
                    offset += len(packed)
                    if offset >= PACKAGE_BYTES or len(index) >= PACKAGE_RECORDS:
                        yield done()
                        package = None
        if package is not None:
            yield done()

    rows = pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")
    return written(rows, "warc-manifest")


def places(fetch: Fetch, members: list[Member]) -> dict[str, list[tuple[int, int]]]:
    """(offset, length) of the records in each archive member, in order, from
    all stored indexes (.cdxj, .cdxj.gz). An index names an archive by its
    member's name or the end of it."""
    found: dict[str, set[tuple[int, int]]] = {}
    archives = [m.name for m in members if m.name.endswith((".warc.gz", ".warc"))]
    for m in members:
        if not m.name.endswith((".cdxj", ".cdxj.gz")):
            continue
        data = fetch(stored_at(fetch, m), m.size)
        for line in (gzip.decompress(data) if m.name.endswith(".gz") else data).decode().splitlines():
            if " {" not in line:
                continue
            x = json.loads(line[line.index(" {") :])
            name = next((a for a in archives if a == x["filename"] or a.endswith(f"/{x['filename']}")), None)
            if name is None:
                raise ValueError(f"the index names no member: {x['filename']}")
            found.setdefault(name, set()).add((int(x["offset"]), int(x["length"])))
    return {name: sorted(x) for name, x in sorted(found.items())}


def ranges(fetch: Fetch, size: int) -> Iterator[bytes]:
    """The records of a package's archives in their order, each fetched by its
    range from the index."""
    members = directory(fetch, size)
    by = {m.name: m for m in members}
    for name, spots in places(fetch, members).items():
        start, own = stored_at(fetch, by[name]), by[name].size
        k = 0
        while k < len(spots):
            first = last = k
            while last + 1 < len(spots) and spots[last + 1][0] == sum(spots[last]) and sum(spots[last + 1]) - spots[first][0] <= FETCH:
                last += 1
            at, upto = spots[first][0], sum(spots[last])
            if upto > own:
                raise ValueError("the index leads out of the archive")
            data = fetch(start + at, upto - at)
            for offset, length in spots[first : last + 1]:
                one = data[offset - at : offset - at + length]
                yield gzip.decompress(one) if name.endswith(".gz") else one
            k = last + 1


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """manifest -> (page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, payload), of a revisit the payload is null and its length and
    digest are those of the whole payload, from the headers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            with fs.open_input_file(path) as file:
                rows, held = [], 0
                for data in ranges(lambda offset, n: file.read_at(n, offset), file.size()):
                    rows.append(_row(*parse(data)))
                    held += len(data)
                    if held > FETCH:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    many = max(1, manifest.count())
    return manifest.select("path").repartition(many).mapInArrow(run, _READ)


_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _row(headers: dict[str, str], http: bytes, payload: bytes) -> tuple:
    said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != said):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
    number = lambda name: int(headers[name]) if name in headers else None
    return number("WARC-Page"), headers.get("WARC-Target-URI"), kind, length, said, number("WARC-Refers-To-Page"), payload if kind == "response" else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of at least
    ``LEAST_BYTES`` those but the one with the smallest id refer to it."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    groups = base.filter(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # As a table of its own: the join is then a broadcast where it is small, and splits a payload of very many pages where not.
    met = base.join(written(groups.select("digest", "first"), "warc-groups"), "digest", "left")
    return met.select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def op4(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one
    row per page, all read back from the packages.

    Null and empty html are empty payloads (always responses); a page without
    an id never is referred to but may refer; rows repeated with the smallest
    id of their payload are all responses; html of any length is one record,
    held whole by the task that writes or reads it; an empty table writes no
    package; other columns are ignored.
    """
    folder = shared_path(pages.sparkSession, "warc")
    manifest = write_archives(with_revisits(pages), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
