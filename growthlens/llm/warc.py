"""Legacy archive converter: ARC version 1 and 2 to WARC 1.1.

An ARC record says its length on a header line whose fields depend on the
version, named in the archive's first record. The converter reads records by
those lengths and makes the WARC identifiers, timestamps, types and digests
that belong to them. Payloads met before become revisit records. Archives of
others are read as they come: header names in any case, Latin-1, spaces in URLs,
bare line feeds, records of other protocols; damage costs the record it hits.

Archives are rows (archive, content) of a table: any store that Spark reaches
holds them, a row is one complete archive of about ``ARCHIVE_BYTES``, and no
task or row grows with the input. Records are gzip members, as usual.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

ARCHIVE_BYTES = 4 << 20
#: Payloads of fewer bytes are never revisited.
MIN_REVISIT_BYTES = 0
#: Compressed bytes given to a decompressor at a time. What lies behind its gzip
#: member it copies, so a whole archive would be copied once for every record.
FED_BYTES = 4096
CAPTURED = "20240101000000"
#: The header fields of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed values of WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ARCHIVE = "archive string, content binary"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f-\xff%]")


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def sha1_base32(payload: bytes) -> str:
    return _base32(hashlib.sha1(payload).digest())


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _inflate(content: memoryview, at: int) -> tuple[bytes, int | None]:
    """The gzip member that starts at ``at`` and where it ends: nowhere if it is
    cut off. Raises zlib.error for a damaged one."""
    member, out = zlib.decompressobj(31), []
    while at < len(content) and not member.eof:
        fed = content[at:at + FED_BYTES]
        out.append(member.decompress(fed))
        at += len(fed)
    return b"".join(out), at - len(member.unused_data) if member.eof else None


def _percent(url: str) -> str:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode()


# -- ARC ------------------------------------------------------------------

def arc_header(name: str, version: int) -> bytes:
    body = f"{version} 0 growthlens\n{ARC_FIELDS[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, block: bytes) -> bytes:
    known = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/html",
             "Result-code": "200", "Location": "-", "Offset": str(offset),
             "Filename": name, "Archive-length": str(len(block))}
    if version == 2:
        known["Checksum"] = sha1_base32(block)
    return " ".join(known[f] for f in ARC_FIELDS[version].split()).encode() + b"\n" + block + b"\n"


class Damaged(NamedTuple):
    """A place of an archive that holds no record one could read."""

    offset: int
    reason: str


def read_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record after the archive's own; raises
    ValueError at the first damage."""
    for found in arc_records(content):
        if isinstance(found, Damaged):
            raise ValueError(f"{found.reason} at {found.offset}")
        yield found


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes] | Damaged]:
    """What an archive holds, in order. After damage the reader goes on with the
    next line that is a record's header by its address, date and length.

    The first record describes the archive, by the version 1 fields or, in
    version 2, also by those: its length is always the last. An archive without
    it is read by the number of fields."""
    data, holes = _inflated(content)
    yield from holes
    at, version, last = 0, None, ""
    while at < len(data):
        line, body = _line(data, at)
        if not line.strip():  # archives differ in the line ends after a block
            at = body
            continue
        try:
            length = int(line.rsplit(" ", 1)[1])
            if length < 0 or body + length > len(data):
                raise ValueError("a record is cut off")
            stop = _block_end(data, body, length)
            if at == 0 and line.startswith("filedesc://"):
                version = _version(data[body:body + length])
                at = stop
                continue
            if at == 0:
                yield Damaged(0, "the archive does not describe itself")
            header = _header(line, version)
            iso_date(header["Archive-date"])
        except (ValueError, IndexError) as e:
            yield Damaged(at, str(e) if isinstance(e, ValueError) and "invalid literal" not in str(e) else "no length ends the header line")
            nearest = _HEADER.search(data, body)
            at = nearest.start() if nearest else len(data)
            continue
        yield header, data[body:body + length]
        at = stop


def _inflated(content: bytes) -> tuple[bytes, list[Damaged]]:
    """The records of a plain or gzip archive, and the gzip members that could
    not be read to their end (offsets are those of the compressed bytes)."""
    if content[:2] != b"\x1f\x8b":
        return content, []
    out, holes, at, view = [], [], 0, memoryview(content)
    while at < len(content):
        try:
            record, end = _inflate(view, at)
            out.append(record)
            if end is None:
                holes.append(Damaged(at, "a gzip member is cut off"))
                break
            at = end
        except zlib.error:
            holes.append(Damaged(at, "a gzip member is damaged"))
            at = content.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                break
    return b"".join(out), holes


def _text(raw: bytes) -> str:
    """Header bytes: UTF-8, or else Latin-1, as old archives have it."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _line(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\n", at)
    end = len(data) if end < 0 else end
    return _text(data[at:end].removesuffix(b"\r")), end + 1


def _block_end(data: bytes, at: int, length: int) -> int:
    """Where the next record may start: a block ends a line, or the archive."""
    stop = at + length
    if stop == len(data) or data[stop:stop + 1] == b"\n":
        return stop + 1
    if data[stop:stop + 2] == b"\r\n":
        return stop + 2
    if _HEADER.match(data, stop):
        return stop
    raise ValueError("a record is not as long as it says")


def _version(description: bytes) -> int:
    first = _text(description).split("\n")[0]
    version = first.split(" ")[0]
    if not version.isdigit() or int(version) not in ARC_FIELDS:
        raise ValueError(f"ARC version {first!r}")
    return int(version)


#: A header line of either version: address, date, ..., length.
_HEADER = re.compile(rb"(?m)^[^\s][^\n]* (?:[0-9]{1,3}\.){3}[0-9]{1,3} [0-9]{14} [^\n]*?[0-9]+\r?$")
_FIELDS = re.compile(r"(?P<url>.*?) (?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:]+) (?P<date>[0-9]{4,17}) (?P<rest>.*)")


def _header(line: str, version: int | None) -> dict[str, str]:
    """The values by field name. A URL, and a content type, may hold spaces: the
    address and date between them tell where they end."""
    m = _FIELDS.fullmatch(line)
    if version is None:
        version = 2 if m and len(m["rest"].split(" ")) >= 7 else 1
    names = ARC_FIELDS[version].split()
    values = [m["url"], m["ip"], m["date"], *m["rest"].rsplit(" ", len(names) - 4)] if m else line.rsplit(" ", len(names) - 1)
    if len(values) != len(names):
        raise ValueError(f"{len(values)} header values for {len(names)} fields")
    return dict(zip(names, values))


# -- HTTP and WARC ----------------------------------------------------------

def http_response(payload: bytes, page_id: int | None) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


#: The blank line that ends a head; some servers sent bare line feeds.
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head with its blank line, header fields by lower-case name, payload). A
    head that does not end is all of the block; a block that is no HTTP response
    is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    gap = _HEAD_END.search(block)
    cut = gap.end() if gap else len(block)
    return block[:cut], _fields(block[:cut]), block[cut:]


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; of repeated ones the first."""
    out: dict[str, str] = {}
    for line in _text(head).replace("\r\n", "\n").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _page(fields: dict[str, str]) -> int | None:
    page = fields.get("x-page-id", "")
    return int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None


def record_id(url: str, date: str, digest: str, page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page}')}>"


def iso_date(arc_date: str) -> str:
    """A date of 4 to 14 digits; what is missing is the earliest possible."""
    if not re.fullmatch("[0-9]{4,17}", arc_date):
        raise ValueError(f"{arc_date!r} is no date")
    d = arc_date[:14] + "00000101000000"[len(arc_date[:14]):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _whole(content: bytes) -> bytes:
    """All gzip members of an archive; raises where one can't be read to its
    end. Zero bytes behind a member are padding."""
    out, at, view = [], 0, memoryview(content)
    while at < len(content):
        record, end = _inflate(view, at)
        if end is None:
            raise EOFError(f"the gzip member at {at} is cut off")
        out.append(record)
        at = end
        while at < len(content) and not content[at]:
            at += 1
    return b"".join(out)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    data, at = _whole(content), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no record starts at {at}")
        headers = _fields(data[at:end])
        stop = end + 4 + int(headers["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is not as long as it says")
        yield headers, data[end + 4:stop]
        at = stop + 4


def convert(header: dict[str, str], block: bytes, firsts: dict[tuple[int | None, bytes], dict]) -> bytes:
    """The WARC record of an ARC record; ``firsts`` has by page id and payload
    digest the response that a record revisits: {page, url, date}. What is no
    HTTP response becomes a resource of the type that the ARC header states."""
    head, fields, payload = split_http(block)
    url, date, page, sha1 = header["URL"], iso_date(header["Archive-date"]), _page(fields), hashlib.sha1(payload).digest()
    digest, first = _base32(sha1), firsts.get((page, sha1))
    kind = "resource" if not head else "revisit" if first else "response"
    out = {"WARC-Type": kind, "WARC-Record-ID": record_id(url, date, digest, page),
           "WARC-Date": date, "WARC-Target-URI": _percent(url)}
    if header["IP-address"] != "0.0.0.0":
        out["WARC-IP-Address"] = header["IP-address"]
    out |= {"Content-Type": "application/http; msgtype=response" if head else header["Content-type"], "WARC-Payload-Digest": f"sha1:{digest}"}
    if kind == "revisit":
        block = head
        out |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Truncated": "length",
                "WARC-Refers-To": record_id(first["url"], first["date"], digest, first["page"]),
                "WARC-Refers-To-Target-URI": _percent(first["url"]), "WARC-Refers-To-Date": first["date"],
                "X-Refers-To-Page-Id": str(first["page"]), "X-Payload-Length": str(len(payload))}
    out["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
    return warc_record(out, block)


# -- Spark --------------------------------------------------------------------

def _write_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, serial = TaskContext.get().partitionId(), 0
    version, name, members, raw, packed = 1, "", [], 0, 0
    for batch in batches:
        for page, url, html in zip(*(batch.column(i) for i in range(3))):
            if not members:
                version, name = 1 + serial % 2, f"{part:06d}-{serial:06d}.arc.gz"
                members, raw = [_member(arc_header(name, version))], 0
                packed = len(members[0])
            block = http_response((html.as_py() or "").encode("utf-8", "surrogatepass"), page.as_py())
            members.append(_member(arc_record(version, name, packed, _percent(url.as_py() or "unknown:"), block)))
            packed, raw = packed + len(members[-1]), raw + len(block)
            if raw >= ARCHIVE_BYTES:
                yield _archive(name, members)
                members, serial = [], serial + 1
    if members:
        yield _archive(name, members)


def _archive(name: str, members: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([name]), pa.array([b"".join(members)], pa.binary())], names=["archive", "content"])


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as ARC archives, versions 1 and 2 in turn."""
    return map_arrow(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")),
                     _write_arc, _ARCHIVE)


def _sound(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    return (r for r in arc_records(content) if not isinstance(r, Damaged))


def _damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(name.as_py(), *r) for name, content in zip(batch.column(0), batch.column(1))
                for r in arc_records(content.as_py()) if isinstance(r, Damaged)]
        if rows:
            yield pa.record_batch([pa.array(x) for x in zip(*rows)], names=["archive", "offset", "reason"])


def damaged_records(archives: DataFrame) -> DataFrame:
    """(archive, offset, reason): the places of ARC archives that hold no record
    one could read. The conversion goes on after them."""
    return map_arrow(archives.select("archive", "content"), _damage, "archive string, offset long, reason string")


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            rows = []
            for header, block in _sound(content.as_py()):
                _, fields, payload = split_http(block)
                rows.append((name.as_py(), hashlib.sha1(payload).digest(), len(payload), _page(fields), header["URL"], iso_date(header["Archive-date"])))
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                      names=["archive", "digest", "size", "page", "url", "date"])


def _write_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content, firsts in zip(*(batch.column(i) for i in range(3))):
            name = name.as_py().replace(".arc.gz", ".warc.gz")
            later = {(x["later"], x["digest"]): x for x in firsts.as_py() or ()}
            info = b"software: growthlens\r\nformat: WARC File Format 1.1\r\n"
            members = [_member(warc_record(
                {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, iso_date(CAPTURED), "", None),
                 "WARC-Date": iso_date(CAPTURED), "WARC-Filename": name, "Content-Type": "application/warc-fields"}, info))]
            for header, block in _sound(content.as_py()):
                members.append(_member(convert(header, block, later)))
            yield _archive(name, members)


def arc_to_warc(archives: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """ARC archives (archive, content) as WARC archives of the same records.

    Of records with equal payloads of at least ``min_bytes`` that with the
    smallest page id is a response and the others revisit it; a page id that has
    several payloads is judged by each. Records without a page id, and repeats
    of the smallest, stay responses. Records that are no HTTP response become
    resources; damaged ones are left out (``damaged_records`` lists them).
    """
    found = materialize(map_arrow(archives, _payloads, "archive string, digest binary, size long, page long, url string, date string"), "payloads")
    known = found.filter((F.col("size") >= min_bytes) & F.col("page").isNotNull())
    firsts = materialize(
        known.groupBy("digest").agg(F.min(F.struct("page", "url", "date")).alias("first"), F.max("page").alias("last"))
        .filter("first.page < last").select("digest", "first"), "firsts")
    # As many rows as the archive has records. Written out: where they are few,
    # Spark sends them to the archives instead of shuffling those.
    revisits = materialize(
        known.join(firsts, "digest").filter("page > first.page")
        .groupBy("archive").agg(F.collect_set(F.struct(F.col("page").alias("later"), "digest", "first.*")).alias("firsts")), "revisits")
    return map_arrow(archives.join(revisits, "archive", "left").select("archive", "content", "firsts"), _write_warc, _ARCHIVE)


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(1):
            rows = []
            for headers, block in read_warc(content.as_py()):
                kind = headers["warc-type"]
                if kind not in ("response", "revisit", "resource"):
                    continue
                _, fields, payload = split_http(block)
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind != "revisit" and sha1_base32(payload) != digest:
                    raise ValueError(f"{headers['warc-record-id']}: the payload is not what its digest says")
                size = int(headers.get("x-payload-length", len(payload)))
                first = headers.get("x-refers-to-page-id")
                rows.append((_page(fields), size, digest, kind, int(first) if first else None,
                             headers["warc-record-id"], headers["warc-target-uri"], headers["warc-date"]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                      names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "date"])


def read_warc_archives(archives: DataFrame) -> DataFrame:
    """Per response, revisit or resource record: page_id, payload_bytes and payload_digest
    (of the full payload), record_type, refers_to, record_id, uri, date."""
    return map_arrow(archives.select("archive", "content"), _read_warc,
                     "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                     "record_id string, uri string, date string")


def convert_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, **columns: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC archives read back.

    One row per row of ``pages``. Null html is an empty payload, a null url
    ``unknown:``, characters that a header line can't hold are percent-encoded.
    A page id twice gives two records, each judged by its own payload: both
    respond where theirs is the smallest id of it, else they revisit. A null id is kept and always responds.
    Other columns are ignored.
    """
    legacy = materialize(write_arc(pages, **columns), "arc")
    return read_warc_archives(materialize(arc_to_warc(legacy, min_bytes), "warc"))
