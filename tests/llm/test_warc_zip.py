import gzip
import hashlib
import io
import random
import struct
import zipfile

import pytest
from linkengine.llm import warc_zip as W


def test_zip64_and_ranges(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open("archive/data.warc.gz", "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr("indexes/ü.txt", "abc")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 trap"
    data = out.getvalue()
    (tmp_path / "a.zip").write_bytes(data)
    for package in (W.open_bytes(data), W.open_path(str(tmp_path / "a.zip"))):
        assert package.range("archive/data.warc.gz", 3, 4) == b"3456"
        assert package.range("indexes/ü.txt", 0, 3) == b"abc"
        with pytest.raises(ValueError):
            package.range("archive/data.warc.gz", 8, 4)
        with pytest.raises(ValueError):
            package.locate("packed")
    with pytest.raises(ValueError):
        W.open_bytes(b"not a zip")


def test_zip64_directory():
    """A directory whose end record and sizes are only in ZIP64 fields."""
    name, body = b"m", b"hello"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5) + body
    central = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert W.open_bytes(local + central + end64 + locator + end).range("m", 1, 3) == b"ell"


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(W, "PACKAGE_BYTES", 2000)
    big, odd = "é" * 600, "x\r\n\r\n\x00" * 300
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", big), (4, "u", "s"), (5, "u", "s"), (6, "u", None), (7, "u", ""), (None, "u", big), (None, "v", odd), (8, "u", odd), (8, "u", odd), (9, "u", "q" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = W.read_packages(spark, W.write_packages(df), with_payload=True).collect()
    assert len(got) == len(rows)
    first = {big: 3, odd: 8}
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit = html in first and page_id != first[html]
        want.append((str(page_id), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", str(first[html] if revisit else None)))
        if not revisit:
            assert any(bytes(r["payload"]) == body and r["page_id"] == page_id for r in got)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert W.read_packages(spark, W.write_packages(df.limit(0))).count() == 0


def record(i, body, digest=True):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: http://example.com/{i}\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    if digest:
        head += f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\n"
    return f"{head}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_indexes_and_archives_of_other_writers(spark, tmp_path):
    """Any member names, real CDXJ lines, plain and gzipped archives, records without a digest."""
    a, b, c = record(1, b"one"), record(2, b"two", digest=False), gzip.compress(record(3, b"three"))
    lines = [
        '!meta 0 {"format": "cdxj"}',
        f'com,example)/1 20200101000000 {{"url": "http://example.com/1", "mime": "text/html", "length": "{len(a)}", "offset": "0", "filename": "rec-1.warc"}}',
        f'com,example)/2 20200101000000 {{"length": {len(b)}, "offset": {len(a)}, "filename": "rec-1.warc"}}',
    ]
    more = f'com,example)/3 20200101000000 {{"length": "{len(c)}", "offset": "4", "filename": "rec-2.warc.gz"}}'
    with zipfile.ZipFile(tmp_path / "site.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/rec-1.warc", a + b)
        z.writestr("archive/rec-2.warc.gz", b"skip" + c)
        z.writestr("indexes/index.cdxj", "\n".join(lines) + "\n")
        z.writestr("indexes/more.cdx.gz", gzip.compress(more.encode()))
        z.writestr(zipfile.ZipInfo("pages/pages.jsonl"), b"x", zipfile.ZIP_DEFLATED)
    got = W.read_packages(spark, str(tmp_path), with_payload=True, glob="*.wacz").collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == [(1, b"one"), (2, b"two"), (3, b"three")]
    assert {r["payload_digest"] for r in got} == {hashlib.sha1(x).hexdigest() for x in (b"one", b"two", b"three")}


def test_package_beyond_four_gigabytes(spark, tmp_path):
    """A sparse ZIP64 package whose second half lies beyond 32-bit offsets; only ranges are read."""
    far = 5 << 30
    body = gzip.compress(record(7, b"seven" * 10))
    index = f'com,example)/7 20200101000000 {{"length": "{len(body)}", "offset": "{far}", "filename": "big.warc.gz"}}'.encode()

    def local(name, size):
        return struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, size, size)

    def central(name, size, at):
        head = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF)
        return head + name + struct.pack("<HHQQQ", 1, 24, size, size, at)

    names = (b"archive/big.warc.gz", b"indexes/index.cdxj")
    with open(tmp_path / "big.zip", "wb") as f:
        first = local(names[0], far + len(body))
        f.write(first)
        f.seek(len(first) + far)
        f.write(body)
        second = f.tell()
        f.write(local(names[1], len(index)) + index)
        at = f.tell()
        directory = central(names[0], far + len(body), 0) + central(names[1], len(index), second)
        f.write(directory)
        f.write(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 2, 2, len(directory), at))
        f.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(directory), 1))
        f.write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    got = W.read_packages(spark, str(tmp_path), with_payload=True).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in got] == [(7, b"seven" * 10)]


def test_written_bytes_survive(spark):
    """Payloads that do not compress, so that the package holds every byte value."""
    random.seed(6)
    html = ["".join(chr(random.randrange(32, 0xD000)) for _ in range(700_000)) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").selectExpr("*", "'http://x/' as url")
    got = {r["page_id"]: r for r in W.read_packages(spark, W.write_packages(df), with_payload=True).collect()}
    assert len(got) == 3 and all(bytes(got[i]["payload"]) == t.encode() for i, t in enumerate(html))
