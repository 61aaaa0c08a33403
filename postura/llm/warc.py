"""Web archives: records of pages with segments, revisits and chunked transfer framing, written and read back by all tasks.

Writing. Every row becomes one record in the WARC 1.1 format, a gzip member of its own. A page is an HTTP response whose body
travels in chunks. A block longer than ``segment`` bytes, or longer than the room that the file still has, is cut: the
first record has segment number 1, ``continuation`` records follow with the identifier of their origin, and the last one names
the total length. Segments of one page may thus lie in two files. Of pages with equal payloads the one with the largest id
is written as ``response``; the others are ``revisit`` records with the payload's digest and no payload.

Reading. Files are read in parallel, record by record, never as a whole. Records without segments are decoded where they are
read. Segments are grouped by their origin, ordered by number, checked for gaps and for the total length and put together;
then the chunked framing is taken off and the payload's digest compared. A revisit gets length and referred page from
the response with its digest.

``status`` is ``ok`` or names what is wrong with a record (a missing or conflicting segment, a wrong length or digest, bad
framing, a revisit without its response); such a record stays as a row.

Groups of equal payloads may be a large part of all rows: they are pre-aggregated, and both joins by digest are salted.
Manifests name the files that count, so repeated or lost tasks do no harm.

Defined cases: a null html is an empty payload; a null url is a record without an address and reads as null; control signs in
an address are percent-encoded; rows that share the largest id of their payload are all responses, a null id being the
smallest; repeated rows are records of their own; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura.llm.common import by_value, column, salted_join, small_batches, text_of
from postura.llm.files import file_system
from postura.operators.ordered import stage

#: Bytes of a segment's block, of an HTTP chunk, and of a file before the next one is begun.
SEGMENT, CHUNK, FILE_BYTES = 1 << 15, 1 << 13, 64 << 20
MANIFEST = "path string, records long, bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
OK, GAP, CONFLICT, LENGTH = "ok", "missing segment", "conflicting segments", "wrong length"
FRAMING, DIGEST, ORPHAN = "bad framing", "wrong digest", "missing response"


def sha1(data: bytes) -> str:
    """Bare upper-case base32, as archives label digests."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def address(url: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for part in (body[at:at + size] for at in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body inside chunked framing: extensions of a chunk and trailing fields are passed over; ValueError if it is broken."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = framed[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(b"[0-9A-Fa-f]+", size):
            raise ValueError("chunk size")
        n, at = int(size, 16), end + 2
        if not n:
            break
        if framed[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk length")
        parts.append(framed[at:at + n])
        at += n + 2
    while (end := framed.find(b"\r\n", at)) > at:  # trailing fields
        at = end + 2
    if end < 0 or end + 2 != len(framed):
        raise ValueError("end of body")
    return b"".join(parts)


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    fields = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
    coded = any(name.strip().lower() == b"transfer-encoding" and value.strip().lower() == b"chunked" for name, _, value in fields)
    return unchunked(body) if coded else body


class Writer:
    """Files of one task; a file is closed when its plain bytes reach the limit."""

    def __init__(self, folder: str, date: str, segment: int, file_bytes: int):
        self.folder, self.date, self.segment, self.limit = folder, date, segment, file_bytes
        self.out, self.done = None, []

    def _open(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
        files, place = file_system(self.path)
        files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out, self.size, self.records = files.open_output_stream(place, compression=None), 0, 0
        info = b"software: postura\r\nformat: WARC File Format 1.1\r\n"
        self._record({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, info)

    def _record(self, fields: dict[str, object], block: bytes) -> None:
        named = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": self.date} | fields
        named |= {"WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Length": len(block)}
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None) + "\r\n"
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.out.write(packer.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush())
        self.size += len(block)
        self.records += 1

    def _room(self) -> int:
        if self.out is not None and self.size >= self.limit:
            self.close()
        if self.out is None:
            self._open()
        return max(1, min(self.segment, self.limit - self.size))

    def response(self, fields: dict[str, object], payload: bytes) -> None:
        block = HTTP + chunked(payload)
        fields |= {"WARC-Type": "response", "Content-Type": "application/http;msgtype=response"}
        room = self._room()
        if len(block) <= room:
            return self._record(fields, block)
        origin, at, number = f"<urn:uuid:{uuid.uuid4()}>", 0, 0
        while at < len(block):
            part, number = block[at:at + self._room()], number + 1
            at += len(part)
            last = {"WARC-Segment-Total-Length": len(block)} if at == len(block) and number > 1 else {}
            own = (fields | {"WARC-Record-ID": origin} if number == 1
                   else {"WARC-Type": "continuation", "WARC-Segment-Origin-ID": origin, "WARC-Target-URI": fields["WARC-Target-URI"]})
            self._record(own | {"WARC-Segment-Number": number} | last, part)

    def revisit(self, fields: dict[str, object], first: str | None) -> None:
        self._room()
        self._record(fields | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To-Date": self.date,
                               "WARC-Refers-To-Target-URI": first, "Content-Type": "application/http;msgtype=response"}, HTTP)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({"path": self.path, "records": self.records - 1, "bytes": self.size})
            self.out = None

    def finished(self) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        if self.done:
            yield pa.RecordBatch.from_pylist(self.done, kind)
            self.done = []


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0,
          date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every row as a record; payloads shorter than ``least`` bytes are never revisits. The staged manifest: path, records, bytes."""
    small_batches(df.sparkSession)
    page = [column(id_col).cast("long").alias("page"), column(url_col).cast("string").alias("url")]
    body = text_of(html_col).cast("binary")
    slim = df.select(*page, F.sha1(body).alias("sha"), F.octet_length(body).alias("size")).where(F.col("size") >= least)
    equal = (slim.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page", "url")).alias("first"))
             .where("n > 1").select("sha", "first"))
    rows = salted_join(df.select(*page, F.sha1(body).alias("sha"), body.alias("body")), equal, "sha", F.col("page"))
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first.page"))
    ready = rows.select("page", "url", "body", again.alias("again"), F.col("first.url").alias("first"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, date, segment, file_bytes)
        for batch in batches:
            for page, url, body, again, first in zip(*[c.to_pylist() for c in batch.columns]):
                fields = {"WARC-Target-URI": None if url is None else address(url), "X-Page-Id": page,
                          "WARC-Payload-Digest": f"sha1:{sha1(body)}"}
                if again:
                    writer.revisit(fields, None if first is None else address(first))
                else:
                    writer.response(fields, body)
            yield from writer.finished()
        writer.close()
        yield from writer.finished()

    return stage(ready.mapInArrow(save, MANIFEST))


def members(path: str, block: int = 1 << 16) -> Iterator[bytes]:
    """Plain bytes of each gzip member of a file, one at a time; damaged compression is an error."""
    files, place = file_system(path)
    with files.open_input_stream(place, compression=None) as source:
        plain, reader = [], zlib.decompressobj(31)
        while data := source.read(block):
            while data:
                plain.append(reader.decompress(data))
                data = reader.unused_data
                if reader.eof:
                    yield b"".join(plain)
                    plain, reader = [], zlib.decompressobj(31)
        if any(plain):
            yield b"".join(plain)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


def opened(block: bytes, digest: str | None) -> tuple[str, bytes | None]:
    """Status and payload of a whole response block."""
    try:
        payload = body_of(block)
    except ValueError:
        return FRAMING, None
    return (OK if digest in (None, sha1(payload)) else DIGEST), payload


_FOUND = ("record_type string, record_id string, page_id long, url string, digest string, status string, payload_bytes long, "
          "payload_digest string, payload binary")
_SCAN = f"{_FOUND}, origin string, segment int, total long, block binary"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _outcome(block: bytes, digest: str | None, keep: bool) -> tuple:
    status, payload = opened(block, digest)
    if payload is None:
        return status, None, None, None
    return status, len(payload), sha1(payload), payload if keep else None


def scan(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the files: whole ones decoded, segments as they are (``origin``, ``segment``, ``total``, ``block``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*_KINDS, pa.string(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, held = [], 0
                for member in members(path):
                    fields, block = parsed(member)
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    page, digest = fields.get("x-page-id"), fields.get("warc-payload-digest")
                    digest = digest and digest.removeprefix("sha1:")
                    number, origin = fields.get("warc-segment-number"), fields.get("warc-segment-origin-id")
                    total = fields.get("warc-segment-total-length")
                    base = (kind, fields["warc-record-id"], None if page is None else int(page), fields.get("warc-target-uri"), digest)
                    if number is not None:
                        rest = (None,) * 4 + (origin or fields["warc-record-id"], int(number), None if total is None else int(total), block)
                    elif kind == "response":
                        rest = _outcome(block, digest, payload) + (None,) * 4
                    else:
                        rest = (OK, None, digest, None) + (None,) * 4
                    out.append(base + rest)
                    held += len(block)
                    if held > 4 << 20 or len(out) >= 512:
                        yield _batch(out, kinds, _SCAN)
                        out, held = [], 0
                if out:
                    yield _batch(out, kinds, _SCAN)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n).mapInArrow(run, _SCAN)


def joined(parts: list[dict]) -> tuple[str, bytes | None]:
    """Status and block of one record's segments."""
    blocks: dict[int, bytes] = {}
    for part in parts:
        if blocks.setdefault(part["segment"], part["block"]) != part["block"]:
            return CONFLICT, None
    total = next((part["total"] for part in parts if part["segment"] == len(blocks)), None)
    if total is None or sorted(blocks) != list(range(1, len(blocks) + 1)):
        return GAP, None
    block = b"".join(blocks[i] for i in range(1, len(blocks) + 1))
    return (OK, block) if len(block) == total else (LENGTH, None)


def reassemble(parts: DataFrame, payload: bool = True) -> DataFrame:
    """Segments (``origin``, ``segment``, ``total``, ``block`` and the fields of the first) to whole records.

    A group is one record, so it is as large as one page. A segment that was stored twice counts once.
    """
    first = F.min(F.struct("segment", "page_id", "url", "digest")).alias("f")
    whole = parts.groupBy("origin").agg(first, F.collect_list(F.struct("segment", "total", "block")).alias("parts"))
    ready = whole.select("origin", "f.page_id", "f.url", "f.digest", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, page, url, digest, parts in zip(*[batch.column(i) for i in range(5)]):
                status, block = joined(parts.as_py())
                outcome = _outcome(block, digest.as_py(), payload) if status == OK else (status, None, None, None)
                row = ("response", origin.as_py(), page.as_py(), url.as_py(), digest.as_py(), *outcome)
                yield _batch([row], _KINDS, _FOUND)

    return ready.mapInArrow(run, _FOUND)


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """One row per page: record_id, page_id, url, record_type, refers_to (a page id), payload_bytes, payload_digest, status and,
    unless left out, payload. Length and digest are those of the payload as read; a revisit has its response's."""
    small_batches(manifest.sparkSession)
    scanned = stage(scan(manifest, payload))
    names = [field.split()[0] for field in _FOUND.split(", ")]
    parts = scanned.where("segment is not null").select("origin", "segment", "total", "block", "record_type", "record_id", "page_id",
                                                        "url", "digest")
    found = stage(scanned.where("segment is null").select(*names).unionByName(reassemble(parts, payload)))
    asked = found.where("record_type = 'revisit'")
    first = (found.where(f"record_type <> 'revisit' and status = '{OK}'").join(asked.select("digest").distinct(), "digest", "left_semi")
             .groupBy("digest").agg(F.max(F.struct("page_id", "payload_bytes", "payload")).alias("_first")))
    linked = salted_join(asked, first, "digest", F.col("record_id"))
    missing = F.col("_first").isNull()
    again = linked.select("record_id", "page_id", "url", "record_type", F.col("_first.page_id").alias("refers_to"),
                          F.col("_first.payload_bytes").alias("payload_bytes"), "payload_digest",
                          F.when(missing, ORPHAN).otherwise(OK).alias("status"), F.col("_first.payload").alias("payload"))
    own = found.where("record_type <> 'revisit'").select(
        "record_id", "page_id", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest",
        "status", "payload")
    both = own.unionByName(again)
    return both if payload else both.drop("payload")


def digest(manifest: DataFrame) -> DataFrame:
    """Per page, from the files: page_id, payload_bytes, payload_digest, record_type, refers_to, status."""
    return read(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


by_value(__name__)
