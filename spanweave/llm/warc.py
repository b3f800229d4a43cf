r"""WARC archives: writing with segments and revisits, reading with reassembly.

Writing. Each page is one record, ``response`` or, for a repeated payload, ``revisit``. The block of a response is
an HTTP head and its body, with chunked transfer framing for bodies of CHUNKED_FROM bytes and more. A block of
more than ``segment`` bytes is cut: the first record has WARC-Segment-Number 1, and ``continuation`` records
name it by WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length. Records are gzip members; archives
are rows (archive, part, data) of at most about ARCHIVE_BYTES, kept as a table in the shared folder, or files
``*.warc.gz`` read by ``archives_from_files``.

Reading. Members are parsed one by one. Whole records are decoded where they are; only segments are grouped, by
the record that they continue, ordered by number, and joined if all are there and the total length agrees.
Chunked framing is taken off, and the payload is held against its digest.

Scale: payload digests are computed in the scan; groups of equal payloads come from partial aggregates of
(digest, least id). They go back to pages by ``lookup``: broadcast if they are few, and else salted, so that a payload
with a third of all pages costs no task more than its share. Parts are written by the task that holds the pages;
segments of one origin are bounded by the longest page. Archives are read in time that follows their length.

Edge cases: null html is an empty payload; payloads under MIN_PAYLOAD bytes are always responses; pages that
repeat an id are written once each and only the first of equal ones can be referred to; a page with a null id is
a response or, as others, a revisit; damaged segments (gaps, wrong length) come back with ``ok`` false, never as
a short payload; empty tables give empty results; only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import Scratch, freeing, lookup, shuffle_parts, table

MIN_PAYLOAD = 100
SEGMENT = 32 << 10
CHUNKED_FROM = 4 << 10
HTTP_CHUNK = 8 << 10
ARCHIVE_BYTES = 4 << 20

_END = b"\r\n"


# --- records ------------------------------------------------------------------------------------------------


def chunked(body: bytes, size: int = HTTP_CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Body without chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(_END, at)
        n = int(body[at:line].split(b";")[0].strip(), 16)
        if n == 0:
            return b"".join(out)
        if body[line + 2 + n : line + 4 + n] != _END:
            raise ValueError("a chunk does not end where it says")
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def record(kind: str, name: str, block: bytes, **fields: object) -> bytes:
    """One record; fields as target_uri=..., with None left out."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + name.encode() + b">"]
    lines += [b"WARC-" + k.replace("_", "-").title().encode() + b": " + str(v).encode() for k, v in fields.items() if v is not None]
    lines += [b"Content-Length: %d" % len(block), b"", block, b"", b""]
    return _END.join(lines)


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds. Input is handed on in slices, so that what lies behind a member is copied no more
    than once for it and at most as much again as the member is long."""
    view, at = memoryview(data), 0
    while at < len(view):
        reader, parts, step = zlib.decompressobj(31), [], 1 << 10
        while not reader.eof and at < len(view):
            some = view[at : at + step]
            parts.append(reader.decompress(some))
            at += len(some) - len(reader.unused_data)
            step = min(2 * step, 1 << 20)
        yield b"".join([*parts, reader.flush()])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head fields (names in lower case) and block of each record of plain or gzipped data, one or more members."""
    if data[:2] == b"\x1f\x8b":
        for member in members(data):
            yield from records(member)
        return
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def payload(block: bytes) -> tuple[bytes, dict[str, str]]:
    """Body of an HTTP block without transfer framing, and its head fields."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body, fields


# --- writing ------------------------------------------------------------------------------------------------


def _uri(url: str | None) -> str | None:
    """A header value: without line breaks, which would end the field."""
    return None if url is None else " ".join(url.split())


def page_records(name: str, url: str | None, body: bytes, digest: str, refers_to: str | None, segment: int) -> list[bytes]:
    """The records of one page."""
    common = {"target_uri": _uri(url), "date": "2024-01-01T00:00:00Z", "payload_digest": f"sha256:{digest}"}
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
        return [record("revisit", name, block, **common, profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", refers_to=f"<{refers_to}>")]
    if len(body) >= CHUNKED_FROM:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body)
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    if len(block) <= segment:
        return [record("response", name, block, **common)]
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record("response", name, cuts[0], **common, segment_number=1)]
    for i, cut in enumerate(cuts[1:], 2):
        out.append(record("continuation", f"{name}:{i}", cut, target_uri=_uri(url), date=common["date"], segment_number=i, segment_origin_id=f"<{name}>", segment_total_length=len(block) if i == len(cuts) else None))
    return out


def write_archives(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Archives (archive, part, data) of pages (page_id, url, html), repeated payloads as revisits."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    told = own.withColumn("digest", F.sha2("body", 256)).withColumn("long", F.octet_length("body") >= MIN_PAYLOAD)
    seen = told.filter("long").groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("copies"))
    groups = Scratch(pages.sparkSession, "payloads").keep(seen.filter("copies > 1 AND least IS NOT NULL").select("digest", "least"), "repeated")
    joined = lookup(told, groups, "digest", groups.count())
    joined = joined.withColumn("refers_to", F.when(F.col("long") & ~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, rows = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": pa.array([task], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, body, digest, to = (batch.column(c)[i].as_py() for c in range(5))
                rows += 1
                name = f"urn:page:{'' if page is None else page}#{task}.{rows}"  # rows that repeat an id are records of their own
                for r in page_records(name, url, body, digest, None if to is None else f"urn:page:{to}", segment):
                    held.append(gzip.compress(r, 5, mtime=0))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield done()
                        part, held, size = part + 1, [], 0
        if held:
            yield done()

    return joined.select("page_id", "url", "body", "digest", "refers_to").mapInArrow(*freeing(write, "archive int, part int, data binary"))


# --- reading ------------------------------------------------------------------------------------------------


def archives_from_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files, plain or gzipped, as rows for ``read_archives``."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("data"))


_DECODED = "name string, kind string, url string, refers_to string, digest string, n bigint, sha256 string, ok boolean"
_PARSED = f"{_DECODED}, number int, total bigint, block binary"


def _decode(head: dict[str, str], block: bytes, whole: bool = True) -> tuple:
    """Name, kind, url, refers_to, digest told, payload bytes, digest found, ok."""
    kind, told = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:")
    ids = [head.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to")]
    try:
        body, fields = payload(block)
    except ValueError:
        whole, body, fields = False, b"", {}
    if kind == "revisit":
        n, found = int(fields.get("content-length", 0)), told
    else:
        n, found = len(body), hashlib.sha256(body).hexdigest()
    ok = whole and (not told or told == found)
    return ids[0], kind, head.get("warc-target-uri"), ids[1], told or None, n, found, ok


def read_archives(archives: DataFrame) -> DataFrame:
    """Every response and revisit: name, kind, url, refers_to, digest (as told), n (bytes of the full payload),
    sha256 (as found; of a revisit as told), ok. Segments are reassembled."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("sha256", pa.string()), ("ok", pa.bool_()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in records(data.as_py()):
                    if "warc-segment-number" in head:
                        origin = head.get("warc-segment-origin-id", head["warc-record-id"]).strip("<>")
                        total = head.get("warc-segment-total-length")
                        told = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        to = head.get("warc-refers-to", "").strip("<>") or None
                        rows.append((origin, head["warc-type"], head.get("warc-target-uri"), to, told, None, None, None, int(head["warc-segment-number"]), int(total) if total else None, block))
                    elif head["warc-type"] in ("response", "revisit"):
                        rows.append((*_decode(head, block), None, None, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments, sorted by origin and number."""
        schema = pa.schema([("name", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("sha256", pa.string()), ("ok", pa.bool_())])

        def done(origin: str, parts: list[tuple]) -> pa.RecordBatch:
            (kind, url, to, told, *_), block = parts[0], b"".join(p[6] for p in parts)
            whole = [p[4] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1][5] == len(block)
            fields = {"warc-target-uri": url, "warc-refers-to": to, "warc-payload-digest": told}
            head = {"warc-type": kind if kind != "continuation" else "response", "warc-record-id": origin} | {k: v for k, v in fields.items() if v is not None}
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(_decode(head, block, whole), schema, strict=True)], schema=schema)

        name, parts = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != name:
                    if parts:
                        yield done(name, parts)
                    name, parts = row[0], []
                parts.append(row[1:])
        if parts:
            yield done(name, parts)

    parsed = Scratch(archives.sparkSession, "warc").keep(archives.select("data").mapInArrow(*freeing(parse, _PARSED)), "parsed")
    segments = parsed.filter("number IS NOT NULL").select("name", "kind", "url", "refers_to", "digest", "number", "total", "block")
    sorted_ = segments.repartition(shuffle_parts(archives.sparkSession), "name").sortWithinPartitions("name", "number")
    whole = parsed.filter("number IS NULL").select(*(c.split()[0] for c in _DECODED.split(", ")))
    return whole.unionByName(sorted_.mapInArrow(*freeing(join, _DECODED)))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark, "archives").keep(write_archives(table(spark, sf_dir, "pages")), "archives")
    read = read_archives(archives)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)", 1).try_cast("long")
    return read.select(page("name").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"), "ok")
