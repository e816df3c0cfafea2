"""WARC records in ZIP packages: writing them, and reading single records by range without unpacking.

A package is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip member a record, a warcinfo record
first), ``indexes/index.cdxj`` (one line a record with its offset and length, sorted by the sort-friendly form of its
URL) and ``datapackage.json`` (sizes and digests of the others). The reader takes the end of the file, its directory
(ZIP64 where sizes ask for it), the place of a stored member's bytes, and then only the ranges it wants.

Defined results: null html or url counts as empty; a null page_id is never referred to; equal payloads under one
page_id are all responses; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: Bytes of records after which a task starts another package.
PACKAGE_BYTES = 256 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A URN that holds the page's id; pages without one get a random URN of another kind."""
    known = uuid.UUID(int=page_id & (1 << 64) - 1) if page_id is not None else uuid.uuid4()
    return f"<urn:uuid:{known}>"


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64:
        return None
    return value - (1 << 64) if value >> 63 else value


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers of its response only."""
    # URLs stand in a header line, so control characters can't
    uri = "".join(c if c.isprintable() and c != " " else "%{:02X}".format(ord(c)) for c in url) or "urn:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http + payload if refers_to is None else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(raw: bytes) -> Record:
    """A record from its bytes."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _headers(http), payload)


class Package:
    """Random access to the stored members of a ZIP file."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self._file = fs.open_input_file(path)
        self._size = self._file.size()
        self.members = self._directory()

    def close(self) -> None:
        self._file.close()

    def _at(self, offset: int, size: int) -> bytes:
        out = self._file.read_at(size, offset)
        if len(out) != size:
            raise ValueError("the package ends early")
        return out

    def _directory(self) -> dict[str, tuple[int, int]]:
        """(header offset, size) of every stored member."""
        tail = self._at(self._size - (n := min(self._size, 22 + 65535)), n)
        k = tail.rfind(b"PK\x05\x06")
        if k < 0:
            raise ValueError("no end of central directory")
        entries, size, start = struct.unpack_from("<HII", tail, k + 10)
        if entries == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
            where = self._size - n + k - 20
            sign, _, end64, _ = struct.unpack("<IIQI", self._at(where, 20)) if where >= 0 else (0, 0, 0, 0)
            if sign == 0x07064B50:
                end = self._at(end64, 56)
                if end[:4] != b"PK\x06\x06":
                    raise ValueError("bad ZIP64 end of central directory")
                entries, size, start = struct.unpack_from("<QQQ", end, 32)
        raw = self._at(start, size)
        out: dict[str, tuple[int, int]] = {}
        at = 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            (method,) = struct.unpack_from("<H", raw, at + 10)
            packed, full, names, extras, comments = struct.unpack_from("<IIHHH", raw, at + 20)
            (offset,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + names].decode("utf-8")
            extra = raw[at + 46 + names : at + 46 + names + extras]
            x = 0
            while x + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # the values that did not fit, in this order
                    y = x + 4
                    if full == 0xFFFFFFFF:
                        (full,), y = struct.unpack_from("<Q", extra, y), y + 8
                    if packed == 0xFFFFFFFF:
                        (packed,), y = struct.unpack_from("<Q", extra, y), y + 8
                    if offset == 0xFFFFFFFF:
                        (offset,), y = struct.unpack_from("<Q", extra, y), y + 8
                x += 4 + length
            if method == 0:
                out[name] = (offset, full)
            at += 46 + names + extras + comments
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes: past its local header, whose lengths are its own."""
        offset, size = self.members[name]
        head = self._at(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"bad local header of {name}")
        names, extras = struct.unpack_from("<HH", head, 26)
        return offset + 30 + names + extras, size

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        base, full = self.locate(name)
        return self._at(base + offset, full - offset if size is None else size)

    def index(self) -> list[dict]:
        lines = self.read(INDEX).decode().splitlines()
        return [json.loads(x.split(" ", 2)[2]) for x in lines]

    def find(self, url: str) -> list[Record]:
        """The records of a URL, by its place in the sorted index."""
        lines, key = self.read(INDEX).decode().splitlines(), surt(url)
        base, _ = self.locate(DATA)
        out = []
        for line in lines[bisect.bisect_left(lines, f"{key} ") :]:
            if not line.startswith(f"{key} "):
                break
            x = json.loads(line.split(" ", 2)[2])
            out.append(parse(gzip.decompress(self._at(base + x["offset"], x["length"]))))
        return out

    def records(self) -> Iterator[Record]:
        """Every record of the index in the order of the archive, each by its own range."""
        base, _ = self.locate(DATA)
        for x in sorted(self.index(), key=lambda x: x["offset"]):
            yield parse(gzip.decompress(self._at(base + x["offset"], x["length"])))


def surt(url: str) -> str:
    """The sort-friendly form of a URL: the host's parts from the last to the first, then the path and the query."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        parts, host, port = None, "", None
    if not host:
        return quote(url.lower(), safe="!#$%&'()*+,/:;=?@[]~-._") or "-"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    place = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{quote(place, safe=',:-_')}){quote(tail.lower(), safe='!#$%&()*+,/:;=?@[]~-._' + chr(39))}"


def info() -> bytes:
    """The warcinfo record that begins an archive."""
    body = b"software: kinweave\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


class PackageWriter:
    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self._out = fs.open_output_stream(path)
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_STORED)
        self._data = self._zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self._lines, self._sum = 0, [], hashlib.sha256()
        self._write(info())

    def _write(self, raw: bytes) -> int:
        packed = gzip.compress(raw, 1, mtime=0)
        self._data.write(packed)
        self._sum.update(packed)
        self.size += len(packed)
        return len(packed)

    def add(self, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> None:
        about = {"url": url, "mime": "text/html" if refers_to is None else "warc/revisit", "status": "200", "digest": f"sha1:{digest32(payload)}", "offset": self.size}
        about |= {"length": self._write(record(page_id, url, payload, refers_to)), "filename": DATA.rpartition("/")[2]}
        self._lines.append(f"{surt(url)} {DATE.translate(_DIGITS)} {json.dumps(about)}")

    def close(self) -> int:
        self._data.close()
        index = "\n".join([*sorted(self._lines), ""]).encode()
        self._zip.writestr(zipfile.ZipInfo(INDEX), index)
        parts = ((DATA, self._sum.hexdigest(), self.size), (INDEX, hashlib.sha256(index).hexdigest(), len(index)))
        resources = [{"name": n.rpartition("/")[2], "path": n, "hash": f"sha256:{h}", "bytes": b} for n, h, b in parts]
        self._zip.writestr(zipfile.ZipInfo(ABOUT), json.dumps({"profile": "data-package", "created": DATE, "resources": resources}))
        self._zip.close()
        self._out.close()
        return len(self._lines)


_DIGITS = str.maketrans("", "", "-:TZ")


def references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of pages whose payload a smaller page_id has; of (page_id, html)."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    slim = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).select("page_id", F.sha1(body).alias("sha1"))
    first = slim.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_hot(slim, first, ["sha1"], "n").where("page_id is null or page_id > refers_to").where("refers_to is not null")


def write_packages(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes packages under ``path``; gives (path, records) of those that finished attempts wrote."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    known = scratch.save(references(rows, least_bytes).distinct(), "references")
    sha1 = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    keyed = rows.withColumn("own", sha1)
    full = keyed.join(known, keyed["page_id"].eqNullSafe(known["page_id"]) & (keyed["own"] == known["sha1"]), "left")
    full = full.select(keyed["page_id"], "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, counts = [], []
        out = None
        for batch in batches:
            for page, url, html, ref in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    paths.append(f"{path}/{uuid.uuid4().hex}.zip")
                    out = PackageWriter(paths[-1])
                out.add(page, url or "", (html or "").encode(), ref)
                if out.size >= PACKAGE_BYTES:
                    counts.append(out.close())
                    out = None
        if out is not None:
            counts.append(out.close())
        if paths:
            yield pa.RecordBatch.from_pydict({"path": paths, "records": pa.array(counts, pa.int64())})

    return full.mapInArrow(write, "path string, records long")


def read_packages(manifest: DataFrame) -> DataFrame:
    """Every record of the packages: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                package, rows, size = Package(uri), [], 0
                for r in package.records():
                    kind = r.headers["warc-type"]
                    said = r.headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest32(r.payload) != said:
                        raise ValueError(f"{uri}: a payload does not match its digest")
                    ref = page_of(r.headers["warc-refers-to"]) if kind == "revisit" else None
                    payload = r.payload if kind == "response" else None
                    rows.append((page_of(r.headers["warc-record-id"]), r.headers["warc-target-uri"], payload, int(r.http["content-length"]), said, kind, ref))
                    size += len(r.payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                package.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = max(1, manifest.count())
    out = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").repartition(n).mapInArrow(read, out)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages, reads the packages back and gives what they say; the packages go once that is stored."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.save(write_packages(pages, scratch.at("packages"), least_bytes), "manifest")
    back = scratch.save(read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "back")
    scratch.drop("packages")
    return back
