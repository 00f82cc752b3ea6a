"""WARC records in ZIP packages, written and range-read by Spark tasks.

A package (the layout of web archive collections) stores its members without
compression: ``archive/data.warc.gz`` with one gzip member per record,
``indexes/index.cdxj`` with the place of each record, and a manifest. The
reader finds the end-of-directory record (or its ZIP64 form) in the file's
tail, parses the central directory, reads the index member and then single
records by byte range; nothing is extracted.

Packages lie in a folder that all executors share and are opened through
Arrow's file systems by URI. A task writes a package under a temporary name
and moves it, so a task that runs again leaves the same files.

Defined results: null payloads are empty; equal payloads of ``MIN_REVISIT``
bytes or more are written once, by the smallest page_id (null ids are passed
over; rows repeating that id are responses too); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common
from rankloom.session import scratch_dir

MIN_REVISIT = 100
PACKAGE_BYTES = 16 << 20    # a package is closed when it holds so much
DATA, INDEX, MANIFEST = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
_DATE = "2000-01-01T00:00:00Z"
_NO, _WIDE = 0xFFFF, 0xFFFFFFFF


# ---- ZIP ----

def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False, comment: bytes = b"") -> bytes:
    """A ZIP file of stored members; 64-bit fields where needed, or always."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        n, at, crc = name.encode(), len(out), zlib.crc32(data)
        big = zip64 or len(data) >= _WIDE or at >= _WIDE
        size = _WIDE if big else len(data)
        local = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        central = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        version = 45 if big else 20
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, version, 0x800, 0, 0, 0x21, crc, size, size, len(n), len(local)) + n + local + data
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, version, version, 0x800, 0, 0, 0x21, crc, size, size,
                                 len(n), len(central), 0, 0, 0, 0, _WIDE if big else at) + n + central
    at, count = len(out), len(members)
    big = zip64 or at >= _WIDE or len(directory) >= _WIDE or count >= _NO
    out += directory
    if big:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(directory), at)
        out += struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, _NO if big else count, _NO if big else count,
                       _WIDE if big else len(directory), _WIDE if big else at, len(comment)) + comment
    return bytes(out)


class ZipDirectory:
    """Members of a ZIP file, from its directory alone. ``read_at(offset,
    length)`` gives bytes of the file."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        tail_at = max(0, size - 22 - 0xFFFF)
        tail = read_at(tail_at, size - tail_at)
        i = len(tail)
        while True:
            i = tail.rfind(b"PK\5\6", 0, i)
            if i < 0:
                raise ValueError("no end of a ZIP directory")
            if i + 22 <= len(tail) and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] == len(tail):
                break       # else the mark lies inside a comment
        count, length, at = struct.unpack_from("<HII", tail, i + 10)
        if _NO == count or _WIDE in (length, at):
            where = tail_at + i - 20
            locator = read_at(where, 20) if where >= 0 else b""
            if locator[:4] == b"PK\6\7":
                end = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != b"PK\6\6":
                    raise ValueError("bad ZIP64 end of directory")
                count, length, at = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, dict] = {}
        self._parse(read_at(at, length), count)

    def _parse(self, directory: bytes, count: int) -> None:
        p = 0
        for _ in range(count):
            if directory[p:p + 4] != b"PK\1\2":
                raise ValueError("bad ZIP directory entry")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            crc, packed, size, n, x, c = struct.unpack_from("<IIIHHH", directory, p + 16)
            at = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46:p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = directory[p + 46 + n:p + 46 + n + x], 0
            while q + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, q)
                if kind == 1:   # 64-bit values of the fields that are full, in this order
                    r = q + 4
                    if size == _WIDE:
                        size, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                    if packed == _WIDE:
                        packed, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                    if at == _WIDE:
                        at = struct.unpack_from("<Q", extra, r)[0]
                q += 4 + length
            self.members[name] = {"method": method, "flags": flags, "crc": crc, "size": size, "packed": packed, "at": at}
            p += 46 + n + x + c

    def data_offset(self, name: str) -> int:
        """Where a stored member's bytes begin (its local header has its own lengths)."""
        m = self.members[name]
        if m["method"] or m["flags"] & 1:
            raise ValueError(f"{name} is not stored plainly")
        head = self.read_at(m["at"], 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"bad local header of {name}")
        return m["at"] + 30 + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str) -> bytes:
        data = self.read_at(self.data_offset(name), self.members[name]["size"])
        if zlib.crc32(data) != self.members[name]["crc"]:
            raise ValueError(f"checksum of {name}")
        return data


# ---- WARC ----

def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    return int(urn[len("<urn:page:"):-1]) if urn and len(urn) > len("<urn:page:>") else None


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: an HTTP response, or (``refers_to``) a revisit without its payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:     # controls, spaces and other scripts would break the header
        plain = url.isascii() and url.isprintable() and " " not in url
        head += ["WARC-Target-URI: " + url] if plain else ["WARC-Target-URI: " + quote(url), "X-Target-Escaped: yes"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n or rest[n:] != b"\r\n\r\n":
        raise ValueError("WARC record of a wrong length")
    return headers, rest[:n].partition(b"\r\n\r\n")[2]


# ---- Spark ----

def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def classify(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to`` of every page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256))
    long_ = F.octet_length("payload") >= MIN_REVISIT
    firsts = p.where(long_).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .where("_n > 1").select(F.col("payload_digest").alias("_d"), "_first")
    firsts = common.materialize(firsts, "firsts")
    both = p.join(firsts, F.col("payload_digest") == F.col("_d"), "left")
    return both.select("page_id", "url", "payload", "payload_digest",
                       F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def _write(root: str, package_bytes: int) -> Callable:
    def package(fs, base: str, name: str, records: list) -> tuple[str, int]:
        data, index = bytearray(), []
        for page_id, refers, raw in records:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            index.append(json.dumps({"page": page_id, "offset": len(data), "length": len(member), "revisit": refers is not None}))
            data += member
        whole = zip_bytes([(DATA, bytes(data)), (INDEX, "\n".join(index).encode()),
                           (MANIFEST, json.dumps({"profile": "data-package", "records": len(records)}).encode())])
        part, final = f"{base}/.{name}-{uuid.uuid4().hex}", f"{base}/{name}"
        with fs.open_output_stream(part) as f:
            f.write(whole)
        fs.move(part, final)
        return f"{root}/{name}", len(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        records, held, made = [], 0, []

        def close():
            made.append((*package(fs, base, f"part-{task:06d}-{len(made):05d}.wacz", records), len(records)))
            records.clear()
        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))):
                raw = warc_record(page_id, url, payload, digest, refers)
                records.append((page_id, refers, raw))
                held += len(raw)
                if held >= package_bytes:
                    close()
                    held = 0
        if records:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["path", "size", "records"])
    return run


def write_packages(pages: DataFrame, root: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``classify``-ed pages; returns the packages: ``path, size, records``."""
    rows = pages.sortWithinPartitions("page_id", "payload_digest", "url")
    return common.materialize(rows.mapInArrow(_write(root, package_bytes), "path string, size long, records long"), "packages")


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist()):
            fs, name = _open(path)
            with fs.open_input_file(name) as f:
                z = ZipDirectory(lambda at, n, f=f: f.read_at(n, at), size)
                base = z.data_offset(DATA)
                index = [json.loads(x) for x in z.read(INDEX).decode().split("\n") if x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(index)), pa.array([base + x["offset"] for x in index], pa.int64()),
                 pa.array([x["length"] for x in index], pa.int64())], names=["path", "offset", "length"])


def _fetch(with_payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for b in batches:
            cols = {k: [] for k in ("page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload")}
            for path, at, n in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if path != opened:
                    if f:
                        f.close()
                    fs, name = _open(path)
                    opened, f = path, fs.open_input_file(name)
                z = zlib.decompressobj(31)
                raw = z.decompress(f.read_at(n, at))
                if not z.eof:
                    raise ValueError(f"record at {at} of {path} is cut")
                head, payload = parse_record(raw)
                kind, digest = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"digest of the record at {at} of {path}")
                cols["page_id"].append(_page(head["warc-record-id"]))
                cols["record_type"].append(kind)
                cols["refers_to"].append(_page(head.get("warc-refers-to", "")))
                url = head.get("warc-target-uri")
                cols["url"].append(unquote(url) if url and "x-target-escaped" in head else url)
                cols["payload_bytes"].append(len(payload) if kind == "response" else None)
                cols["payload_digest"].append(digest)
                cols["payload"].append(payload if kind == "response" else None)
            types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
            names = [c for c in cols if with_payload or c != "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(cols[c], types.get(c, pa.string())) for c in names], names=names)
        if f:
            f.close()
    return run


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the packages (``path, size``), each read by its byte range.
    Responses carry their own payload; a revisit's is that of ``refers_to``."""
    n = max(1, packages.count())
    where = packages.repartition(n, "path").mapInArrow(_locate, "path string, offset long, length long")
    # neighbours stay together, but one package can be read by several tasks
    spread = F.floor(F.col("offset") / F.lit(4 << 20))
    schema = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string"
    return where.repartition(F.col("path"), spread).sortWithinPartitions("path", "offset") \
        .mapInArrow(_fetch(with_payload), schema + (", payload binary" if with_payload else ""))


def op2_warc_zip(spark, sf_dir: str) -> DataFrame:
    """Every page written to a package and read back."""
    common.prepare(spark)
    root = scratch_dir(spark, f"wacz-{uuid.uuid4().hex}")
    pages = classify(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    records = common.materialize(read_packages(write_packages(pages, root), with_payload=False), "records")
    sizes = records.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(
        F.max("payload_bytes").alias("_bytes")).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_d"), "_bytes")
    sizes = common.materialize(sizes, "sizes")
    out = records.join(sizes, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_d")), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(encode(h)) AS payload_digest FROM p),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
