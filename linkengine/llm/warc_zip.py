"""WARC archives packaged in ZIP files, read by ranges without extraction.

A package holds stored (uncompressed) members: archives ``archive/*.warc`` or ``*.warc.gz``
(one gzip member per record) and indexes ``indexes/*.cdxj``, ``*.cdx`` or either with
``.gz``, a line of key, timestamp and JSON fields per record. The reader opens a package by
its path, reads its tail, parses the end-of-central-directory records (ZIP64 as well), the
central directory and the local headers, locates archives and indexes, and reads each
record by its byte range inside the package. No package is loaded or extracted.

Packages are listed by Spark and opened on the executors by ``pyarrow.fs`` (local and
mounted folders, HDFS, S3, GCS), so they may be of any size. A first pass reads the
directories and indexes and deals the entries out in slices of ``SLICE_RECORDS``; a second reads the
records, so that one package of many records is shared by many tasks.

Packages are written by Spark's committed output, so retries and lost executors leave no
partial archive. The text writer stores a package per file as it is and appends a line
feed, which is the ZIP's comment.

Cases: a null html is an empty payload. Repeated rows are records of their own; rows
that share the largest id of a payload are all responses, and so are rows of payloads
without any id. A null id is written as such and read back as null. Control characters
of a url are percent-encoded. Very long payloads are read one record at a time. Records without a
payload digest get that of what they hold. Index lines that begin with ``!`` are headers.
An index without a ``filename`` refers to the only archive. A package with archives but no
index is an error. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, shared_dir

ARCHIVE_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
ARCHIVE_ENDS = (".warc", ".warc.gz")
INDEX_ENDS = (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")
#: Records that a task reads from one package before the next slice may go elsewhere.
SLICE_RECORDS = 1000
#: Open packages that a task holds at once.
OPEN_PACKAGES = 8
#: A package is closed once its records reach this size.
PACKAGE_BYTES = 8 << 20
#: Payloads below this many bytes are never revisits.
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class ZipRanges:
    """The stored members of a ZIP of ``size`` bytes behind ``read(offset, length)``."""

    def __init__(self, read, size: int):
        self._read, self._size = read, size
        self.members = {name: where for name, *where in self._central()}

    def _end(self) -> tuple[int, int, int]:
        """(entries, size, offset) of the central directory."""
        tail_at = max(0, self._size - (22 + 0xFFFF))
        tail = self._read(tail_at, self._size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self._read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("ZIP64 locator is missing")
            record = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end record is missing")
            entries, size, offset = struct.unpack_from("<QQQ", record, 32)
        return entries, size, offset

    def _central(self) -> Iterator[tuple[str, int, int, int]]:
        entries, size, offset = self._end()
        directory, at = self._read(offset, size), 0
        for _ in range(entries):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("central directory is damaged")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            local = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:
                    # The ZIP64 field holds, in this order, only what overflowed.
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                extra = extra[4 + n :]
            yield name, method, local, packed
            at += 46 + n_name + n_extra + n_comment

    def locate(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes."""
        method, local, packed = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        header = self._read(local, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError(f"local header of {name} is damaged")
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        return local + 30 + n_name + n_extra, packed

    def read(self, offset: int, length: int) -> bytes:
        """Bytes of the package itself."""
        return self._read(offset, length)

    def range(self, name: str, offset: int, length: int) -> bytes:
        start, size = self.locate(name)
        if offset < 0 or offset + length > size:
            raise ValueError(f"range outside {name}")
        return self._read(start + offset, length)


def open_bytes(content: bytes) -> ZipRanges:
    view = memoryview(content)
    return ZipRanges(lambda at, n: bytes(view[at : at + n]), len(content))


def open_path(path: str) -> ZipRanges:
    """A package by its path or uri; every read is of one range."""
    from pyarrow import fs

    path = re.sub("^file:/*", "file:///", path)
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    f = store.open_input_file(inner)

    def read(at: int, n: int) -> bytes:
        return f.read_at(n, at)

    return ZipRanges(read, f.size())


def _clean(value: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. ``digest`` is the payload's SHA-1 in hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _digest(value: str | None) -> str | None:
    """The hex form of a SHA-1 given in base 32 or in hex; null for other digests."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()


def parse_record(packed: bytes) -> dict:
    """Headers and payload of one record, gzipped or plain; digest and length are of the full payload."""
    raw = zlib.decompress(packed, 31) if packed[:2] == b"\x1f\x8b" else packed
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    is_http = "application/http" in fields.get("content-type", "")
    http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    declared = _digest(fields.get("warc-payload-digest"))
    revisit = fields["warc-type"] == "revisit"
    if revisit:
        http_fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        size, digest = int(http_fields.get("content-length", 0)), declared
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if declared not in (None, digest):
            raise ValueError("payload digest does not match")
    number = lambda v: int(v[10:-1]) if v and re.fullmatch(r"<urn:page:-?[0-9]+>", v) else None
    return {
        "page_id": number(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": number(fields.get("warc-refers-to")),
    }


def _surt(url: str | None) -> str:
    """The sort key of a url: host labels from the last, then the path."""
    host, _, path = (url or "").partition("://")[2].partition("/")
    return f"{','.join(reversed(_clean(host).lower().split('.')))})/{_clean(path)}"


def build_package(records: list[bytes], urls: list[str | None] | None = None) -> bytes:
    """A package of finished records, as it is before the line feed that is its comment."""
    offset, index = 0, []
    for i, r in enumerate(records):
        url = urls[i] if urls else None
        fields = {"url": _clean(url), "mime": "text/html", "status": "200", "length": str(len(r)), "offset": str(offset), "filename": ARCHIVE_MEMBER.rpartition("/")[2]}
        index.append(f"{_surt(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(fields)}")
        offset += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(ARCHIVE_MEMBER), b"".join(records))
        z.writestr(zipfile.ZipInfo(INDEX_MEMBER), "\n".join(index))
        z.comment = b"\n"
    return out.getvalue()[:-1]


def index_entries(package: ZipRanges) -> Iterator[tuple[str, int, int]]:
    """(archive member, offset, length) of every record that the package's indexes name."""
    archives = {m.rpartition("/")[2]: m for m in package.members if m.startswith("archive/") and m.endswith(ARCHIVE_ENDS)}
    indexes = sorted(m for m in package.members if m.startswith("indexes/") and m.endswith(INDEX_ENDS))
    if archives and not indexes:
        raise ValueError("the package has archives but no index")
    for member in indexes:
        content = package.range(member, 0, package.locate(member)[1])
        if member.endswith(".gz"):
            content = gzip.decompress(content)
        for line in content.decode().splitlines():
            if not line.strip() or line.startswith("!"):
                continue
            fields = json.loads(line[line.index("{") :])
            name = fields.get("filename")
            if name is None and len(archives) != 1:
                raise ValueError("an index line names no archive")
            yield archives[name.rpartition("/")[2]] if name else next(iter(archives.values())), int(fields["offset"]), int(fields["length"])


def read_package(package: ZipRanges) -> Iterator[dict]:
    """The records of a package, each by its range."""
    for member, offset, length in index_entries(package):
        yield parse_record(package.range(member, offset, length))


def _packages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    records: list[bytes] = []
    urls: list[str | None] = []
    size = 0
    whole = lambda v: None if v is None else int(v)
    for pdf in batches:
        for page_id, url, payload, digest, refers_to, revisit in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["refers_to"], pdf["revisit"]):
            records.append(build_record(whole(page_id), url, bytes(payload), digest, whole(refers_to), bool(revisit)))
            urls.append(url)
            size += len(records[-1])
            if size >= PACKAGE_BYTES:
                yield pd.DataFrame({"content": [build_package(records, urls)]})
                records, urls, size = [], [], 0
    if records:
        yield pd.DataFrame({"content": [build_package(records, urls)]})


def _whole(values: list) -> pd.Series:
    return pd.Series(values, dtype="Int64")


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths of packages to slices of their index: absolute offsets and lengths of records."""
    for pdf in batches:
        for path in pdf["path"]:
            package, offsets, lengths = open_path(path), [], []
            located: dict[str, tuple[int, int]] = {}

            def slice_() -> pd.DataFrame:
                out = pd.DataFrame({"path": [path], "offsets": [np.array(offsets, dtype=np.int64)], "lengths": [np.array(lengths, dtype=np.int64)]})
                offsets.clear()
                lengths.clear()
                return out

            for member, offset, length in index_entries(package):
                start, size = located.setdefault(member, package.locate(member))
                if offset < 0 or offset + length > size:
                    raise ValueError(f"range outside {member}")
                offsets.append(start + offset)
                lengths.append(length)
                if len(offsets) == SLICE_RECORDS:
                    yield slice_()
            if offsets:
                yield slice_()


def _records(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: OrderedDict[str, ZipRanges] = OrderedDict()
        for pdf in batches:
            for path, offsets, lengths in zip(pdf["path"], pdf["offsets"], pdf["lengths"]):
                if path not in opened:
                    opened[path] = open_path(path)
                    if len(opened) > OPEN_PACKAGES:
                        opened.popitem(last=False)
                rows, held = [], 0
                for i, (at, n) in enumerate(zip(offsets.tolist(), lengths.tolist())):
                    rows.append(parse_record(opened[path].read(at, n)))
                    if not with_payload:
                        rows[-1].pop("payload")
                    held += n if with_payload else 0
                    if held >= PACKAGE_BYTES or i + 1 == len(offsets):
                        out = {"page_id": _whole([r["page_id"] for r in rows]), "url": [r["url"] for r in rows]}
                        if with_payload:
                            out["payload"] = [r["payload"] for r in rows]
                        out |= {"payload_bytes": _whole([r["payload_bytes"] for r in rows]), "payload_digest": [r["payload_digest"] for r in rows]}
                        out |= {"record_type": [r["record_type"] for r in rows], "refers_to": _whole([r["refers_to"] for r in rows])}
                        yield pd.DataFrame(out)
                        rows, held = [], 0

    return run


def write_packages(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write a record per row of ``pages`` into packages under ``path``; returns it."""
    path = path or f"{shared_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= REVISIT_FROM
    firsts = rows.filter(long).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    firsts = materialize(firsts.filter("n > 1 and refers_to is not null").drop("n"), "payloads")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = lookup_join(rows, firsts, ["digest"]).select("page_id", "url", "payload", "digest", "refers_to", revisit.alias("revisit"))
    # Ids travel as text: pandas has no whole numbers with nulls in plain columns.
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    packages = rows.mapInPandas(_packages, "content binary")
    packages.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def read_packages(spark, path: str, with_payload: bool = False, glob: str = "*") -> DataFrame:
    """The records of all packages under ``path`` whose names fit ``glob``."""
    # Only paths are asked for, so Spark lists the files without reading them.
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).filter("length > 0").select("path")
    slices = files.mapInPandas(_slices, "path string, offsets array<long>, lengths array<long>")
    slices = slices.repartition(F.xxhash64("path", F.element_at("offsets", 1)))
    payload = "payload binary, " if with_payload else ""
    schema = f"page_id long, url string, {payload}payload_bytes long, payload_digest string, record_type string, refers_to long"
    return slices.mapInPandas(_records(with_payload), schema)
