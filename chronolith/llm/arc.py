"""Legacy ARC archives to WARC, and pages to archives and back.

:func:`parse_arc` reads ARC files of version 1 and 2: a version block names the version and so the fields of
the header lines, each of which declares its record's length; records are taken by that length, never by
searching the content. :func:`convert` synthesises the WARC form: a record id derived from the record's own
fields (so that reruns agree), an ISO timestamp from the 14 digits, type and media type from the record, and
block and payload digests. Payloads equal to an earlier record's become revisits that refer to it.

:func:`archive_pages` packs pages into ARC files, converts these, and writes ``.warc.gz`` files; each record
is a header, a blank line, its block and two line ends, and a gzip member of its own, so that any record can
be read from its offset alone. :func:`read_warc` reads such files back.

Defined cases: a null html is an empty payload; a null url is ``about:blank``; urls are percent-encoded, as
header fields are separated by blanks; of equal payloads the smallest page id is the response, and rows that
repeat it are responses too; a null page id is never the first if another exists, and if none exists all are
responses; a page id is carried in an HTTP header of the record, other columns are not archived; an empty
table makes no records. A truncated or malformed ARC file raises ``ValueError`` with the offset, which
:func:`convert_arcs`, for ARC files that are there, returns as a row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, scratch_path, slices, stage

#: Fields of a header line by ARC version, as fixed by the format.
FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
END = b"\r\n\r\n"
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT = 0
#: Text bytes of one ARC file that is packed and converted at a time; only a single longer page makes a larger one.
ARC_BYTES = 4 << 20
#: Converted ARC files in one WARC file at most; a file is read by one task, compressed as it is.
FILE_ARCS = 32
#: A gzip member without content, which separates the rows of the sink.
EMPTY = gzip.compress(b"", mtime=0)
WARC = "url string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


@dataclass
class ArcRecord:
    version: str
    fields: dict[str, str]
    block: bytes


def parse_arc(data: bytes, info: bool = False) -> Iterator[ArcRecord]:
    """The records of an uncompressed ARC file; with ``info`` the version block, too, as its first record."""
    at, version = 0, ""
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # the blank line between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header at {at} has no end")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "surrogateescape")
        start = end + 1
        if not version:
            parts = line.split(" ")
            if not parts[0].startswith("filedesc:") or not parts[-1].isdigit() or len(parts) < 3:
                raise ValueError("an ARC file begins with its version block")
            length = int(parts[-1])
            version = data[start : start + length].split(b" ", 1)[0].decode("ascii", "replace")
            if version not in FIELDS:
                raise ValueError(f"ARC version {version!r} is not known")
            if info:
                yield ArcRecord(version, {"url": parts[0], "ip": parts[1], "date": parts[2], "type": "text/plain", "length": parts[-1]}, data[start : start + length])
            at = start + length
            continue
        names = FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)  # only the first field, the url, may hold blanks
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"ARC header at {at} has {len(parts)} fields, version {version} has {len(names)}")
        length = int(parts[-1])
        if start + length > len(data):
            raise ValueError(f"ARC record at {at} declares {length} bytes, {len(data) - start} are left")
        yield ArcRecord(version, dict(zip(names, parts)), data[start : start + length])
        at = start + length


def make_arc(version: str, name: str, records: list[tuple[str, bytes]], date: str = "19970101000000") -> bytes:
    """An ARC file of HTTP blocks; the form of its header lines follows the version."""
    names = " ".join({"1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"), "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}[version])
    about = f"{version} 0 archive\n{names}\n\n".encode()
    tail = f"200 - - 0 {name} " if version == "2" else ""
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}{len(about)}\n".encode(), about]
    for url, block in records:
        out.append(f"{url} 0.0.0.0 {date} text/html {tail}{len(block)}\n".encode())
        out += [block, b"\n"]
    return b"".join(out)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and body; a block without a header is all body."""
    if block.startswith(b"HTTP/"):
        ends = [(at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
        if ends:
            return block[: min(ends)], block[min(ends) :]
    return b"", block


def header_value(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def convert(record: ArcRecord, refers_to: str | None = None) -> tuple[bytes, bytes]:
    """Header lines and block of the WARC record of an ARC record.

    A record is named by its page id, or else by url and date, together with its payload's digest.
    ``refers_to`` names an earlier record with the same payload: the record is a revisit then, whose block
    keeps the HTTP header only.
    """
    f = record.fields
    head, payload = http_parts(record.block)
    if not f["date"].isdigit():
        raise ValueError(f"ARC date {f['date']!r} has other characters than digits")
    stamp = datetime.strptime((f["date"] + "00000101000000"[len(f["date"]) :])[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    if f["url"].startswith("filedesc:"):
        about = f"isPartOf: {f['url'][len('filedesc:'):].lstrip('/')}\r\nformat: WARC File Format 1.1\r\ndescription: converted from an ARC file of version {record.version}\r\n"
        kind, media, block, payload = "warcinfo", "application/warc-fields", about.encode("utf-8", "surrogateescape"), about.encode("utf-8", "surrogateescape")
    elif refers_to:
        kind, media, block = "revisit", "application/http;msgtype=response", head
    elif head:
        kind, media, block = "response", "application/http;msgtype=response", record.block
    else:
        kind, media, block = "resource", f["type"], record.block
    sha = digest(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(header_value(head, 'X-Page-Id') or f['url'] + f['date'], sha)}",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {encode_url(f['url'])}",
        f"WARC-IP-Address: {f['ip']}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {media}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines[-2:-2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape"), block


def parse_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, taken by Content-Length, from the pieces of a file in order.

    No more than one record and one piece are held at a time.
    """
    held, seen = bytearray(), 0

    def take() -> tuple[dict[str, str], bytes] | None:
        nonlocal seen
        if held and not b"WARC/".startswith(held[:5]) and not held.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {seen}")
        end = held.find(END)
        if end < 0:
            return None
        fields = dict(line.split(": ", 1) for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:])
        start = end + len(END)
        stop = start + int(fields["Content-Length"])
        if len(held) < stop + len(END):
            return None
        if held[stop : stop + len(END)] != END:
            raise ValueError(f"the WARC record at {seen} does not end after {stop - start} bytes")
        block = bytes(held[start:stop])
        del held[: stop + len(END)]
        seen += stop + len(END)
        return fields, block

    for chunk in chunks:
        held += chunk
        while (record := take()) is not None:
            yield record
    if held:
        raise ValueError(f"the WARC record at {seen} is cut off")


def unzipped(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The content of a gzip file, member after member, in pieces; what follows a member is copied by ``step`` bytes at most."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("the gzip file is cut off")
            piece = view[at : at + step]
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)


def page_block(page_id: int | None, html: bytes, first: int | None) -> bytes:
    """An HTTP response of a page; ``first`` is the page that it repeats, if it does."""
    ident = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    same = "" if first is None else f"X-Same-As: {first}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ident}{same}X-Length: {len(html)}\r\n\r\n".encode() + html


def encode_url(url: str | None) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else "about:blank"


def first_pages(pages: DataFrame) -> DataFrame:
    """``_id, _key, first``: of every page that repeats another's payload, and the smallest page that has it.

    ``pages`` has id, key (a digest of the payload) and size.
    """
    keys = pages.where(F.col("size") >= MIN_REVISIT)
    firsts = keys.groupBy("key").agg(F.min("id").alias("first"), F.count("key").alias("n")).where("n > 1 and first is not null").select("key", "first")
    return keys.join(firsts, "key").where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "first").distinct()


def to_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a WARC record per page as ``.warc.gz`` files in ``path``, by way of ARC files of both versions.

    A file ends after FILE_ARCS converted ARC files, so its size is bounded by bytes, whatever the number of pages.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("key"))
    repeats = stage(first_pages(rows.select("id", "key", F.octet_length("html").alias("size"))), "repeats")
    every = rows.join(repeats, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for part in slices(batch, "html", ARC_BYTES):
                version = "12"[n % 2]
                n += 1
                blocks = []
                for row in part.to_pylist():
                    html = row["html"].encode()
                    blocks.append((encode_url(row["url"]), page_block(row["id"], html, row["first"])))
                out = []
                for record in parse_arc(make_arc(version, f"part-{n}.arc", blocks)):
                    head, _ = http_parts(record.block)
                    lines, block = convert(record, header_value(head, "X-Same-As"))
                    out.append(zlib.compress(lines + END + block + END, wbits=31))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])

    # The text sink writes the bytes of each row as they are, and its line end is a gzip member without content.
    members = every.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    bound_batches(pages.sparkSession)
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", FILE_ARCS).text(path)
    _name_archives(pages.sparkSession, path)


def _name_archives(spark, path: str) -> None:
    """Give the sink's files in ``path`` the ending of archives: one rename in the folder for each of its files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            target = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name[:-4]}.warc.gz")
            if not files.rename(status.getPath(), target):
                raise OSError(f"{name} in {path} cannot be renamed")


def read_warc(spark, path: str) -> DataFrame:
    """One row per record of the ``.warc.gz`` files in ``path``; every digest is checked against its block."""

    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in WARC.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parse_warc(unzipped(content.as_py())):
                    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
                    head, payload = http_parts(block)
                    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] != "revisit" and sha != digest(payload):
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not match")
                    ident, refers = header_value(head, "X-Page-Id"), header_value(head, "X-Same-As")
                    if (fields.get("WARC-Refers-To") or "") != (record_id(refers, sha) if refers else ""):
                        raise ValueError(f"{fields['WARC-Record-ID']} refers to an unknown record")
                    rows.append((fields["WARC-Target-URI"], None if ident is None else int(ident), fields["WARC-Type"], None if refers is None else int(refers), int(header_value(head, "X-Length") or len(payload)), sha))
                    if len(rows) == 5000:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(run, WARC)


def convert_arcs(spark, path: str) -> DataFrame:
    """``path, url, record_type, record, error``: a WARC record (header, block and end, as bytes) for every record of the
    ``.arc`` and ``.arc.gz`` files in ``path``, the version block as ``warcinfo``.

    Of a malformed record or a file that is cut off, one row with an error tells the place; the records before it are
    there, as are other files. A file is read by one task and is held there as a whole.
    """
    fields = "path string, url string, record_type string, record binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                try:
                    data = content.as_py()
                    for record in parse_arc(b"".join(unzipped(data)) if data[:2] == b"\x1f\x8b" else data, True):
                        lines, block = convert(record)
                        rows.append((name, record.fields["url"].encode("utf-8", "replace").decode(), lines.split(b"\r\n", 2)[1].partition(b": ")[2].decode(), lines + END + block + END, None))
                        held += len(block)
                        if held > ARC_BYTES:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                            rows, held = [], 0
                except (ValueError, zlib.error) as problem:
                    rows.append((name, None, None, None, str(problem)))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    names = [f.split()[0] for f in fields.split(", ")]
    schema = pa.schema([(n, pa.binary() if n == "record" else pa.string()) for n in names])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").load(path)
    return files.select("path", "content").mapInArrow(run, fields)


def archive_pages(pages: DataFrame, **names: str) -> DataFrame:
    """Pages to WARC files in the shared folder and back."""
    path = scratch_path(pages.sparkSession, "warc")
    to_warc(pages, path, **names)
    return read_warc(pages.sparkSession, path)
