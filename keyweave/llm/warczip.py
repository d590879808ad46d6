"""WARC records in ZIP packages: a writer, and a reader that parses the ZIP directories and range-reads single records.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdxj`` (a line per record with its
offset and length), both stored without compression, so that a record is a byte range of the package. The reader finds
members through the end-of-central-directory record or its ZIP64 counterpart and never extracts one.
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
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import lookup_join, materialize, scratch_path
from keyweave.workers import ship

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed once its records reach this many or this many compressed bytes.
RECORDS, PACKAGE_BYTES = 20_000, 32 << 20
LEVEL = 1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"


#: Schemes of Hadoop paths, and what pyarrow calls the same store.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs", "gcs": "gs", "dbfs": "file", "": "file"}


def uri(path: str) -> str:
    """A Hadoop path as pyarrow names it. Paths of dbfs are read where it is mounted."""
    scheme, colon, rest = path.partition(":") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else ("", "", path)
    rest = rest if rest.startswith("//") else "//" + rest
    if scheme == "dbfs":
        rest = "///dbfs/" + rest.lstrip("/")
    return f"{_SCHEMES.get(scheme, scheme)}:{rest}"


def filesystem(path: str):
    """A pyarrow file system and the path in it, for whatever store the path's scheme names; ValueError if there is none."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(uri(path))
    except (ValueError, OSError, NotImplementedError) as e:  # pyarrow's errors of unknown schemes are of these kinds
        raise ValueError(f"no file system for {path}") from e


def record(kind: str, page: str | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record: the payload in an HTTP response, or a revisit with no block that names the record it repeats."""
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = _HTTP % len(payload) + payload if kind == "response" else b""
    head = {"WARC-Type": kind, "WARC-Record-ID": urn(page), "WARC-Date": _DATE, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": size, "Content-Length": len(block)}
    if url:
        head["WARC-Target-URI"] = "".join(c if c >= " " else "%%%02X" % ord(c) for c in url)
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": urn(refers_to)}
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head.items()), b"\r\n", block, b"\r\n\r\n"])


class Package:
    """Gathers records and writes them out as one ZIP file."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.lines: list[str] = []
        self.at = 0

    def add(self, page: str | None, kind: str, data: bytes) -> None:
        packed = gzip.compress(data, LEVEL, mtime=0)
        self.lines.append(json.dumps({"page": page, "type": kind, "offset": self.at, "length": len(packed)}))
        self.parts.append(packed)
        self.at += len(packed)

    def write(self, folder: str, zip64: bool = False) -> str:
        """The path of the new package; a task that runs again writes another file."""
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        with files.open_output_stream(f"{path}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
            for member, data in ((ARCHIVE, self.parts), (INDEX, ["\n".join(self.lines).encode()])):
                info = zipfile.ZipInfo(member)
                with z.open(info, "w", force_zip64=zip64 or member == ARCHIVE and self.at >= 1 << 31) as out:
                    for x in data:
                        out.write(x)
        return f"{folder}/{name}"


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def _tail_records(read, size: int) -> tuple[int, int]:
    """Offset and length of the central directory."""
    tail_at = max(0, size - 65_557 - 20)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    length, offset = struct.unpack_from("<II", tail, end + 12)
    entries = struct.unpack_from("<H", tail, end + 10)[0]
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7" and (entries == 0xFFFF or 0xFFFFFFFF in (length, offset)):
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        wide = read(at, 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        length, offset = struct.unpack_from("<QQ", wide, 40)
    return offset, length


def members(read, size: int) -> dict[str, Member]:
    """The members that the central directory lists. read: returns so many bytes from an offset."""
    offset, length = _tail_records(read, size)
    data, at, out = read(offset, length), 0, {}
    while at < length:
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, packed, full, n, m, c = struct.unpack_from("<H8xIIHHH", data, at + 10)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name, extra, end = data[at + 46 : at + 46 + n].decode(), at + 46 + n, at + 46 + n + m
        while extra + 4 <= end:
            tag, k = struct.unpack_from("<HH", data, extra)
            if tag == 1:  # ZIP64: only the values that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{k // 8}Q", data, extra + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra += 4 + k
        out[name] = Member(name, method, full, header)
        at = end + c
    return out


def data_offset(read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    head = read(member.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else b""


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of every record of a package, each read by its byte range."""
    files, inner = filesystem(path)
    with files.open_input_file(inner) as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        found = members(read, f.size())
        start, index = data_offset(read, found[ARCHIVE]), found[INDEX]
        for line in io.BytesIO(read(data_offset(read, index), index.size)):
            x = json.loads(line)
            yield parse(zlib.decompress(read(start + x["offset"], x["length"]), 31))


def _page(urn: str | None) -> int | None:
    inner = (urn or "")[len("<urn:page:") : -1]
    return int(inner) if inner else None


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", zip64: bool = False) -> DataFrame:
    """Writes a record per row into packages below ``folder``; their paths and numbers of records, as a table that is already written.

    The payload is the html in UTF-8 (null: empty). Of the rows with equal payloads those with the largest page_id are
    responses and the others revisit it; rows without page_id revisit too, unless no equal row has one.
    """
    ship(pages.sparkSession)
    filesystem(folder)  # fails here rather than in a task
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    groups = p.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    p = lookup_join(p, groups, "digest", "n", pages.count(), ["page_id"])
    response = F.col("page_id").eqNullSafe(F.col("last"))
    text = [F.col(c).cast("string").alias(c) for c in ("page_id", "last")]  # pandas would turn longs with nulls into doubles
    p = p.select(text[0], "url", F.when(response, F.col("payload")).alias("payload"), "size", "digest", text[1])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = Package()
        for b in batches:
            for page, link, payload, size, digest, last in zip(*(b[c].astype(object).where(b[c].notna(), None) for c in b.columns), strict=True):
                kind = "revisit" if payload is None else "response"
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                pack.add(page, kind, record(kind, page, link, payload or b"", int(size), b32, last))
                if len(pack.parts) >= RECORDS or pack.at >= PACKAGE_BYTES:
                    yield pd.DataFrame({"path": [pack.write(folder, zip64)], "records": [len(pack.parts)]})
                    pack = Package()
        if pack.parts:
            yield pd.DataFrame({"path": [pack.write(folder, zip64)], "records": [len(pack.parts)]})

    return materialize(p.mapInPandas(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of the packages at manifest.path.

    A response whose payload does not have the digest and length that its headers say raises ValueError.
    """
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                rows, held = [], 0
                for h, payload in records(path):
                    kind, digest, n = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"])
                    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (digest, n):
                        raise ValueError(f"damaged record {h['WARC-Record-ID']} in {path}")
                    rows.append((_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), n, digest, kind, _page(h.get("WARC-Refers-To")), *([payload] if payloads else [])))
                    held += len(payload) if payloads else 0
                    if len(rows) >= RECORDS or held >= PACKAGE_BYTES:
                        yield _frame(rows, payloads)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, payloads)

    ship(manifest.sparkSession)
    n = manifest.count()
    return manifest.select("path").repartition(max(1, min(n, 10_000)), "path").mapInPandas(run, fields + (", payload binary" if payloads else ""))


def _frame(rows: list[tuple], payloads: bool) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    return pd.DataFrame({k: pd.array(v, dtype="Int64") if k in ("page_id", "refers_to") else list(v) for k, v in columns.items()})


def archives_query(pages: DataFrame) -> DataFrame:
    manifest = write_archives(pages, scratch_path(pages.sparkSession, "warc"))
    return read_archives(manifest).drop("url")
