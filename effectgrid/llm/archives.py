"""Legacy archive converter: ARC files to WARC files, and readers of both.

An archive is a row (archive, segment, content): content is a stretch of an
archive file of bounded size, one gzip member per record, so that archives lie
wherever Spark's tables lie. ARC header lines are told by the version in the
file's first record: five fields in version 1, ten in version 2, the last one
the length of what follows. Identifiers, timestamps, types and digests, which
ARC lacks, are synthesised from these lines and the content.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.llm.tables import stored

#: Bytes of records, unpacked, in one segment; more only if one record has more.
SEGMENT_BYTES = 8 << 20
#: Equal payloads of fewer bytes are all stored.
LEAST_REVISIT = 100
_FIELDS = {1: 5, 2: 10}
_BEGIN = datetime(1996, 1, 1, tzinfo=timezone.utc)


def packed(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a segment, unpacked one at a time."""
    at, view = 0, memoryview(content)
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            piece = view[at : at + 8192]
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(parts)


# ---- ARC ------------------------------------------------------------------


def arc_description(version: int, name: str) -> bytes:
    fields = b"URL IP-address Archive-date Content-type Archive-length"
    if version == 2:
        fields = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = b"%d 0 effectgrid\n%s\n" % (version, fields)
    return arc_record(version, f"filedesc://{name}", "19960101000000", "text/plain", body, name)


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, name: str) -> bytes:
    # blanks and control characters would end the field; all others stay as they are
    url = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)
    head = [url or "-", "0.0.0.0", date, kind]
    if version == 2:
        head += ["200", "-", "-", "0", name]
    return " ".join([*head, str(len(body))]).encode("utf-8", "surrogatepass") + b"\n" + body + b"\n"


def parse_arc(record: bytes, version: int | None) -> tuple[int | None, dict | None]:
    """(version, fields) of one record; fields are None for one that is no ARC record.

    The file's first record tells the version. A declared length beyond the
    content marks the record as truncated; what follows it is left out.
    """
    line, _, rest = record.partition(b"\n")
    head = line.split(b" ")
    first = head[0].startswith(b"filedesc://")
    if first:
        try:
            version = int(rest.split(b" ", 1)[0])
        except ValueError:
            version = 1
    if _FIELDS.get(version or 1) != len(head) or not head[-1].isdigit():
        return version, None
    length = int(head[-1])
    return version, {
        "url": head[0].decode("utf-8", "replace"),
        "ip": head[1].decode("ascii", "replace"),
        "date": head[2].decode("ascii", "replace"),
        "kind": head[3].decode("ascii", "replace"),
        "body": rest[:length],
        "truncated": len(rest) < length,
        "description": first,
    }


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """Header and payload of an HTTP response; all is payload if there is no header."""
    if body.startswith(b"HTTP/"):
        head, gap, payload = body.partition(b"\r\n\r\n")
        if gap:
            return head + gap, payload
    return b"", body


def _header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(name.lower() + b":"):
            return line[len(name) + 1 :].strip().decode("utf-8", "replace")
    return None


# ---- WARC -----------------------------------------------------------------


def record_id(archive: str, segment: int, at: int) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{archive}/{segment}/{at}'.encode()).digest()[:16], version=5)}"


def warc_date(date: str) -> str:
    try:
        return datetime.strptime(date[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1996-01-01T00:00:00Z"


def warc_record(kind: str, own: str, fields: dict, refers: str | None = None) -> bytes:
    head, payload = http_parts(fields["body"])
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{own}>"),
        ("WARC-Date", warc_date(fields["date"])),
    ]
    if kind == "warcinfo":
        lines += [("WARC-Filename", fields["url"].removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")]
        block = b"software: effectgrid\r\nformat: WARC File Format 1.1\r\n"
    else:
        digest = hashlib.sha256(payload).hexdigest()
        lines += [("WARC-Target-URI", fields["url"]), ("WARC-IP-Address", fields["ip"]), ("WARC-Payload-Digest", f"sha256:{digest}")]
        if fields["truncated"]:
            lines.append(("WARC-Truncated", "length"))
        if refers:
            lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers}>")]
        lines.append(("Content-Type", "application/http; msgtype=response" if head else fields["kind"]))
        block = head if kind == "revisit" else head + payload
    lines.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(record: bytes) -> dict | None:
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    strip = lambda x: x.strip("<>") if x else None
    block = rest[: int(_header(head, b"Content-Length") or 0)]
    return {
        "type": _header(head, b"WARC-Type"),
        "id": strip(_header(head, b"WARC-Record-ID")),
        "digest": (_header(head, b"WARC-Payload-Digest") or "").removeprefix("sha256:"),
        "refers": strip(_header(head, b"WARC-Refers-To")),
        "block": block,
    }


# ---- Spark jobs -----------------------------------------------------------

ARCHIVE = "archive string, segment int, content binary"
_ARCHIVE_FIELDS = [("archive", pa.string()), ("segment", pa.int32()), ("content", pa.binary())]


def _row(fields: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _write_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    version, name = 1 + task % 2, f"legacy-{task:06d}.arc.gz"
    held, size, segment = [packed(arc_description(version, name))], 0, 0
    some = False
    for batch in batches:
        for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            payload = (html or "").encode("utf-8", "surrogatepass")
            date = (_BEGIN + timedelta(seconds=(page or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            record = arc_record(version, url or "", date, "text/html", head + payload, name)
            if some and size + len(record) > SEGMENT_BYTES:
                yield _row(_ARCHIVE_FIELDS, [(name, segment, b"".join(held))])
                held, size, segment = [packed(arc_description(version, name))], 0, segment + 1
            held.append(packed(record))
            size, some = size + len(record), True
    if some:
        yield _row(_ARCHIVE_FIELDS, [(name, segment, b"".join(held))])


def write_arc(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """ARC archives of the pages, versions 1 and 2 by turns; stored in the shared folder."""
    rows = pages.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{url_column}`").cast("string"), F.col(f"`{html_column}`"))
    return stored(rows.toDF("page", "url", "html").mapInArrow(_write_arc, ARCHIVE))


def _arc_records(content: bytes) -> Iterator[tuple[int, dict]]:
    version = None
    for at, member in enumerate(members(content)):
        version, fields = parse_arc(member, version)
        if fields is not None:
            yield at, fields


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):  # one segment in memory at a time
            rest = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names) if c not in ("archive", "segment", "content")}
            col = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            yield col["archive"][i].as_py(), col["segment"][i].as_py(), col["content"][i].as_buffer(), rest


_LIST = [("archive", pa.string()), ("segment", pa.int32()), ("at", pa.int32()), ("record", pa.string()), ("page", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for archive, segment, content, _ in _segments(batches):
        rows = []
        for at, fields in _arc_records(content):
            if not fields["description"]:
                head, payload = http_parts(fields["body"])
                page = _header(head, b"X-Page-Id")
                rows.append((archive, segment, at, record_id(archive, segment, at), int(page) if page else None, len(payload), hashlib.sha256(payload).hexdigest()))
        yield _row(_LIST, rows)


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for archive, segment, content, rest in _segments(batches):
        revisits = {r["at"]: r["refers"] for r in rest["revisits"] or []}
        out = []
        for at, fields in _arc_records(content):
            kind = "warcinfo" if fields["description"] else "revisit" if at in revisits else "response"
            out.append(packed(warc_record(kind, record_id(archive, segment, at), fields, revisits.get(at))))
        yield _row(_ARCHIVE_FIELDS, [(archive.replace(".arc", ".warc"), segment, b"".join(out))])


def convert(arcs: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """WARC archives with the records of ARC archives.

    Of records with equal payloads of `least` bytes or more the one of the
    smallest page is a response, the others are revisits of it that store no
    payload; records of the same page as that one stay responses.
    """
    listed = stored(arcs.mapInArrow(_listed, "archive string, segment int, at int, record string, page long, bytes long, digest string"))
    large = listed.where(F.col("bytes") >= least)
    first = large.where("page is not null").groupBy("digest").agg(F.min(F.struct("page", "record")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = large.join(first, "digest").where("page <> first.page")
    # a list per segment, so no longer than the segment
    by_segment = revisits.groupBy("archive", "segment").agg(F.collect_list(F.struct("at", F.col("first.record").alias("refers"))).alias("revisits"))
    both = arcs.join(by_segment, ["archive", "segment"], "left").select("archive", "segment", "content", "revisits")
    return stored(both.mapInArrow(_converted, ARCHIVE))


_READ = [("record", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("page", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, content, _ in _segments(batches):
        rows = []
        for member in members(content):
            r = parse_warc(member)
            if r is None or r["type"] not in ("response", "revisit"):
                continue
            head, payload = http_parts(r["block"])
            page = _header(head, b"X-Page-Id")
            if r["type"] == "response":
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if digest != r["digest"]:
                    raise ValueError(f"{r['id']}: the payload does not have the digest of its header")
            else:
                size, digest = int(_header(head, b"Content-Length") or 0), r["digest"]
            rows.append((r["id"], r["type"], r["refers"], int(page) if page else None, size, digest))
        yield _row(_READ, rows)


def read_warc(warcs: DataFrame) -> DataFrame:
    """One row per response and revisit: page, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's size and digest are those of the full payload, and refers_to is
    the page of the record that it names.
    """
    kinds = "record string, record_type string, refers string, page long, payload_bytes long, payload_digest string"
    records = stored(warcs.mapInArrow(_read_warc, kinds))
    named = records.where("record_type = 'revisit'").select(F.col("refers").alias("record")).distinct()
    target = records.join(named, "record", "left_semi").select(F.col("record").alias("refers"), F.col("page").alias("refers_to"))
    return records.join(target, "refers", "left").select("page", "payload_bytes", "payload_digest", "record_type", "refers_to")


def page_records(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC archives and back: one row per page.

    A null html is an empty payload, a null url is written as "-"; pages with a
    null id are kept with a null id and revisit the smallest id of their
    payload never. An empty table gives no archives and no rows.
    """
    return read_warc(convert(write_arc(pages))).withColumnRenamed("page", "page_id")
