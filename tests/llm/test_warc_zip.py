import gzip
import hashlib
import io
import struct
import zipfile

import pytest

from factloom.llm import warc_zip as wz
from factloom.llm._shared import shared_path

SCHEMA = "page_id long, url string, html string, digest string, first long, n string"


def fetcher(data):
    return lambda offset, n: data[offset : offset + n]


def test_directories_as_the_standard_library_writes_them():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 in the comment"
        z.writestr("ä.txt", "one")
        z.writestr("b", "two", zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("c"), "w", force_zip64=True) as f:
            f.write(b"three")
    for prefix in (b"", b"junk before"):
        data = prefix + out.getvalue()
        members = {m.name: m for m in wz.directory(fetcher(data), len(data))}
        assert set(members) == {"ä.txt", "b", "c"}
        at = wz.stored_at(fetcher(data), members["c"])
        assert data[at : at + members["c"].size] == b"three"
        with pytest.raises(ValueError):
            wz.stored_at(fetcher(data), members["b"])


def test_zip64_directory():
    """A directory whose numbers all stand in its ZIP64 records."""
    name, body = b"m", b"payload"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, len(body), len(body), 1, 0) + name
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(local) + len(body)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    data = local + body + central + end64 + b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(central), 1)
    data += b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (m,) = wz.directory(fetcher(data), len(data))
    at = wz.stored_at(fetcher(data), m)
    assert data[at : at + m.size] == body
    data = b"bytes that stand before the archive" + data
    (m,) = wz.directory(fetcher(data), len(data))
    at = wz.stored_at(fetcher(data), m)
    assert data[at : at + m.size] == body
    with pytest.raises(ValueError):
        wz.directory(fetcher(data.replace(wz.END64, b"none")), len(data))


def test_packages_of_other_names_and_several_archives():
    records = [wz.record(k, f"http://a/{k}", b"x" * k, hashlib.sha256(b"x" * k).hexdigest(), None) for k in range(6)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        lines = []
        for name, own in (("archive/one.warc.gz", records[:4]), ("archive/two.warc", records[4:])):
            data = b""
            for r in own:
                packed = gzip.compress(r) if name.endswith("gz") else r
                lines.append(f'com,a)/ 2025 {{"offset": "{len(data)}", "length": "{len(packed)}", "filename": "{name.split("/")[1]}"}}')
                data += packed
            z.writestr(name, data)
        z.writestr("indexes/index.cdxj.gz", gzip.compress("\n".join(["!meta", *lines]).encode()))
        z.writestr("pages/pages.jsonl", "{}")
    data = out.getvalue()
    assert list(wz.ranges(fetcher(data), len(data))) == records


def test_no_zip():
    with pytest.raises(ValueError):
        wz.directory(fetcher(b"x" * 99), 99)


def test_round_trip_of_pages(spark, monkeypatch):
    monkeypatch.setattr(wz, "PACKAGE_RECORDS", 3)
    big, small = "<p>é" + "x" * 200, "tiny"
    rows = [(5, "http://a/ü \r\n", big), (2, None, big), (9, "u", big), (7, "u", small), (8, "u", small), (1, "u", None), (3, "u", ""), (None, "u", big), (4, "u", "y" * 99), (6, "u", "y" * 99), (12, "u", "\r\n\r\n" * 50), (2, None, big), (13, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "d", 1, "n") for r in rows], SCHEMA)
    got = sorted(map(tuple, wz.op4(pages).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min((j for j, _, g in rows if g == h and j is not None), default=None) if len(data) >= 100 else i
        same = i == first or len(data) < 100 or first is None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if same else "revisit", None if same else first))
    assert got == sorted(want, key=str)
    assert wz.op4(pages.limit(0)).count() == 0


def test_payloads_and_urls_come_back(spark):
    pages = spark.createDataFrame([(1, "http://a/ b", "<p>ü</p>", "d", 1, "n")], SCHEMA)
    folder = shared_path(spark, "warc-test")
    r = wz.read_archives(wz.write_archives(wz.with_revisits(pages), folder), folder).first()
    assert (bytes(r.payload).decode(), r.url, r.record_type) == ("<p>ü</p>", "http://a/%20b", "response")
