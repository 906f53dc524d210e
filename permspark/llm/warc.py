"""WARC archives with segmented records, and their reassembly.

Writing: one record for each page; the payload is sent in chunked transfer coding. Blocks above SEGMENT bytes are segmented:
the first segment is the response record, continuation records follow with the origin's identifier and a segment number, the last of
them with the total length. Of equal payloads of at least REVISIT bytes the page with the largest page_id is archived, the others become
revisit records that refer to it.

Reading: files are read as streams. Whole records are decoded where they are read; segments are grouped by origin identifier and
sorted by segment number, and the chunks are decoded while the segments pass, so that one segment is in memory at a time. The segments
must be numbered 1 to n without a gap and their lengths must add up to the total; else the record's status is "broken" and it
has no payload digest. A repeated segment counts once.

Null html is an empty payload, a null url gives no target URI, and a null page_id is the smallest id. Every row
has a record: rows with equal page_id and html are numbered by url, and the number is part of their record id; revisits refer to the first. Other columns are ignored. An empty table makes no file and gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from permspark.llm.ordered import parallelism
from permspark.llm.shared_files import located, partition, published
from permspark.sources.writers import scratch_dir, staged

REVISIT = 1000
SEGMENT = 1 << 14
CHUNK = 1 << 12
#: Compressed bytes after which a file ends.
FILE_BYTES = 1 << 25
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    name = hashlib.sha1(f"{'' if page_id is None else page_id}:{digest}{f':{copy}' if copy else ''}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def safe_uri(url: str) -> str:
    """White space and control characters would break a header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(kind: str, own: str, headers: dict[str, object], block: bytes) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": DATE} | headers | {"Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + CRLF * 2


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = (payload[k : k + size] for k in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def page_records(page_id, url, payload: bytes, digest: str, target, segment: int = SEGMENT, copy: int = 0) -> Iterator[bytes]:
    """The WARC records of a page; `target` is the page that it revisits, or None; `copy` tells rows of one page_id and digest apart."""
    own = record_id(page_id, digest, copy)
    about = {"WARC-Target-URI": None if url is None else safe_uri(url), "X-Page-ID": page_id}
    about["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = {"Content-Type": "application/http; msgtype=response"}
    if target is not None:
        refers = {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(target, digest)}
        yield record("revisit", own, about | refers | kind, http + CRLF)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record("response", own, about | kind, block)
        return
    cuts = range(0, len(block), segment)
    yield record("response", own, about | kind | {"WARC-Segment-Number": 1}, block[:segment])
    for number, at in enumerate(cuts[1:], 2):
        name = f"<urn:uuid:{uuid.uuid5(uuid.UUID(own[10:-1]), str(number))}>"
        headers = {"WARC-Segment-Origin-ID": own, "WARC-Segment-Number": number, "WARC-Target-URI": about["WARC-Target-URI"]}
        headers["WARC-Segment-Total-Length"] = len(block) if number == len(cuts) else None
        yield record("continuation", name, headers, block[at : at + segment])


def writing(folder: str, segment: int, file_bytes: int) -> Callable:
    """Task: rows (page_id, digest, target, is_page, url, html) sorted by page_id, digest, is_page and url; a target precedes its pages."""

    def pages(batches) -> Iterator[tuple]:
        target, done, copy = (None, None, None), object(), 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, digest, refers, is_page, url, html = row
                if not is_page:
                    target = (page_id, digest, refers)
                else:
                    copy = copy + 1 if (page_id, digest) == done else 0
                    done = (page_id, digest)
                    yield page_id, url, html, digest, target[2] if target[:2] == done else None, copy

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pages(batches)
        row, number = next(rows, None), 0
        while row is not None:
            uri, size, count = f"{folder}/pages-{partition():06d}-{number:05d}.warc.gz", 0, 0
            with published(uri) as out:
                while row is not None and size < file_bytes:
                    page_id, url, html, digest, target, copy = row
                    for data in page_records(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, target, segment, copy):
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member for each record
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        size, count = size + len(member), count + 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [count]})
            number += 1

    return write


def write_archives(pages: DataFrame, folder: str | None = None, segment: int = SEGMENT, file_bytes: int = FILE_BYTES, least: int = REVISIT) -> DataFrame:
    """Writes the archives to a shared folder and returns the list of files: uri, n_records."""
    folder = folder or scratch_dir(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    named = pages.select("page_id", F.sha1(html).alias("digest"), "url", "html", F.octet_length(html).alias("_n"))
    slim = named.filter(F.col("_n") >= least).select("page_id", "digest")
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("_c")).filter("_c > 1")
    groups = staged(groups.select(F.col("digest").alias("_d"), "target"))
    revisits = slim.join(groups, F.col("digest") == F.col("_d")).filter(~F.col("page_id").eqNullSafe(F.col("target")))
    marks = revisits.select("page_id", "digest", "target", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = named.select("page_id", "digest", F.lit(None).cast("long").alias("target"), F.lit(True).alias("is_page"), "url", "html")
    dealt = rows.unionAll(marks.distinct()).repartition(parallelism(pages), "page_id", "digest")
    made = dealt.sortWithinPartitions("page_id", "digest", "is_page", "url").mapInArrow(writing(folder, segment, file_bytes), "uri string, n_records long")
    return staged(made)


def read_headers(stream) -> dict[str, str] | None:
    """Headers of the next record by lower-case name, or None at the end."""
    line = stream.readline()
    while line in (CRLF, b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    out = {}
    while (line := stream.readline().rstrip(CRLF)):
        name, _, value = line.partition(b":")
        out[name.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
    return out


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file, compressed or not."""
    system, path = located(uri)
    with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
        while (headers := read_headers(stream)) is not None:
            yield headers, stream.read(int(headers["content-length"]))


class Payload:
    """Payload of an HTTP block that comes in parts: drops the HTTP headers and decodes chunked transfer coding."""

    def __init__(self, keep: bool = False):
        self.head, self.chunks, self.left, self.rest, self.over = b"", None, 0, b"", False
        self.size, self.sha1, self.kept, self.bad = 0, hashlib.sha1(), [] if keep else None, False

    def _take(self, data: bytes) -> None:
        self.size += len(data)
        self.sha1.update(data)
        if self.kept is not None:
            self.kept.append(data)

    def feed(self, data: bytes) -> None:
        if self.chunks is None:
            self.head += data
            head, mark, data = self.head.partition(CRLF * 2)
            if not mark:
                return
            self.head = b""
            fields = [line.lower().replace(b" ", b"") for line in head.split(CRLF)[1:]]
            self.chunks = b"transfer-encoding:chunked" in fields
        if not self.chunks:
            self._take(data)
            return
        data, self.rest = self.rest + data, b""
        at = 0
        while at < len(data) and not self.over:
            if self.left > 2:  # bytes of a chunk, then its line end
                part = data[at : at + self.left - 2]
                self._take(part)
                at, self.left = at + len(part), self.left - len(part)
            elif self.left:
                skip = min(self.left, len(data) - at)
                at, self.left = at + skip, self.left - skip
            else:
                end = data.find(CRLF, at)
                if end < 0:
                    self.rest = data[at:]
                    return
                try:
                    size = int(data[at:end].split(b";")[0], 16)
                except ValueError:
                    self.bad = self.over = True
                    return
                at, self.left, self.over = end + 2, size + 2 if size else 0, size == 0

    def whole(self) -> bool:
        return not self.bad and self.chunks is not None and (self.over or not self.chunks)


SEGMENTS = "record_id string, page_id long, uri string, segment long, total long, block binary"
RESULTS = "record_id string, page_id long, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, status string, payload binary"
RESULT_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()), ("payload", pa.binary())]
)
SEGMENT_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary())]
)


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _batches(rows: Iterator[tuple], like: pa.Schema, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[-1] or b"")
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), like)], schema=like)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), like)], schema=like)


def _closed(record_id, page_id, uri, payload: Payload, good: bool) -> tuple:
    good = good and payload.whole()
    data = b"".join(payload.kept) if payload.kept is not None and good else None
    digest = payload.sha1.hexdigest() if good else None
    return record_id, page_id, uri, "response", None, payload.size if good else None, digest, "ok" if good else "broken", data


def whole_records(keep: bool) -> Callable:
    """Task: responses that aren't segmented, and revisits."""

    def rows(uris) -> Iterator[tuple]:
        for uri in uris:
            for h, block in records(uri):
                page_id, target = _number(h.get("x-page-id")), h.get("warc-target-uri")
                if h["warc-type"] == "revisit":
                    digest = base64.b32decode(h["warc-payload-digest"].rpartition(":")[2]).hex()
                    yield h["warc-record-id"], page_id, target, "revisit", h.get("warc-refers-to"), None, digest, "ok", None
                elif h["warc-type"] == "response" and "warc-segment-number" not in h:
                    payload = Payload(keep)
                    payload.feed(block)
                    yield _closed(h["warc-record-id"], page_id, target, payload, True)

    return lambda batches: _batches(rows(u for b in batches for u in b.column(0).to_pylist()), RESULT_SCHEMA)


def segment_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: segments of responses, by the identifier of their origin."""

    def rows() -> Iterator[tuple]:
        for uri in (u for b in batches for u in b.column(0).to_pylist()):
            for h, block in records(uri):
                if "warc-segment-number" in h and h["warc-type"] in ("response", "continuation"):
                    origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                    total = _number(h.get("warc-segment-total-length"))
                    yield origin, _number(h.get("x-page-id")), h.get("warc-target-uri"), int(h["warc-segment-number"]), total, block

    return _batches(rows(), SEGMENT_SCHEMA)


def reassembling(keep: bool) -> Callable:
    """Task: segments sorted by origin and number become records."""

    def rows(batches) -> Iterator[tuple]:
        origin = None
        for batch in batches:
            for own, page_id, uri, number, total, block in zip(*(c.to_pylist() for c in batch.columns)):
                if own != origin:
                    if origin is not None:
                        yield _closed(origin, *about, payload, good and length == wanted)
                    origin, about, payload, good, last, length, wanted = own, (None, None), Payload(keep), True, 0, 0, None
                if number == last:
                    continue
                if number == 1:
                    about = (page_id, uri)
                good, last, length = good and number == last + 1 and wanted is None, number, length + len(block)
                wanted = total
                if good:
                    payload.feed(block)
        if origin is not None:
            yield _closed(origin, *about, payload, good and length == wanted)

    return lambda batches: _batches(rows(batches), RESULT_SCHEMA)


def read_archives(files: DataFrame, keep: bool = True) -> DataFrame:
    """One row for each response or revisit record in the files (column uri). `keep` returns payloads, else only their digests."""
    dealt = files.select("uri").repartition(parallelism(files), "uri")
    segments = dealt.mapInArrow(segment_records, SEGMENTS)
    sorted_ = segments.repartition(parallelism(files), "record_id").sortWithinPartitions("record_id", "segment")
    return dealt.mapInArrow(whole_records(keep), RESULTS).unionAll(sorted_.mapInArrow(reassembling(keep), RESULTS))


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Records with the size of the payload that a revisit refers to, and that page's id; a revisit without its response is broken."""
    responses = found.filter("record_type = 'response'")
    known = responses.select(F.col("record_id").alias("_r"), F.col("page_id").alias("_p"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d"))
    met = found.filter("record_type = 'revisit'").join(known, F.col("refers_to") == F.col("_r"), "left")
    good = F.col("payload_digest").eqNullSafe(F.col("_d"))
    names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "status"]
    fixed = met.select(
        "page_id", "uri", F.col("_n").alias("payload_bytes"), "payload_digest", "record_type", F.col("_p").alias("refers_to"),
        F.when(good, "ok").otherwise("broken").alias("status"),
    )
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionAll(fixed.select(*names))
