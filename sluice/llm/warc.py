"""WARC archives: a writer of one gzip member per record, and a salvage reader.

The reader checks each member and record (gzip checksum, version line, lengths, closing line ends, block digest). Where a
check fails it looks for the next gzip member or version line that holds a valid record, goes on from there, and logs the
bytes between as a quarantined gap. Within a member of many records it does so in the content.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.tables import fresh_path, keep, table

REVISIT_FROM = 100  # payload bytes
FILE_BYTES = 32 << 20  # a file ends with the record that reaches this
HELD_BYTES = 64 << 20  # content of a gzip member that is held whole; a larger one is unpacked twice, its records as they come
RECORD_BYTES = 1 << 30  # a record that says it is longer is quarantined, and it alone
PIECE = 1 << 20  # bytes unpacked at a time
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compress(b"", 1, 31)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HEAD_END = re.compile(rb"\r\n\r\n|WARC/1\.[01]\r\n")  # what comes first
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_RECORDS = (
    "path string, gap boolean, start long, stop long, reason string, page_id long, url string, record_type string, "
    "payload binary, payload_bytes long, payload_digest string, refers_to long"
)


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only, whose Content-Length tells the payload's size."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += ["WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += [f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte, the top byte of its length; a record of 16 MiB or more gets an empty
    member after it for that."""
    packed = zlib.compress(record, 4, 31)
    return packed if packed[-1] == 0 else packed + EMPTY_MEMBER


def _members(file_bytes: int):
    """The members of a file as one row, but for the last zero byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True)
            for p, u, html, d, r, v in rows:
                held.append(member(record_bytes(p, u, html.encode(), d, r, v)))
                size += len(held[-1])
                if size >= file_bytes:
                    yield file(held)
                    held, size = [], 0
        if held:
            yield file(held)

    def file(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["member"])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", file_bytes: int = FILE_BYTES) -> None:
    """Writes a record per row under `path`. Of equal payloads of at least REVISIT_FROM bytes the least id's row is the
    response and the others revisit it; rows that share that id are all responses; null ids revisit unless the whole
    group is null. A null html is an empty payload; repeated rows give a record each, an empty table an empty folder; long
    pages are written whole, and files end by bytes. Further columns are ignored. Spark's text sink ends each row with the
    zero byte that its last member lacks, so the files are plain concatenated members, in whatever store Spark writes to."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    slim = rows.select("page_id", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= REVISIT_FROM)
    groups = keep(
        slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null"),
        "payloads",
    )
    marked = rows.join(groups.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    marked = marked.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"), revisit.alias("revisit"))
    lines = marked.mapInArrow(_members(file_bytes), "member binary").select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", "\u0000").option("maxRecordsPerFile", 1).text(path)


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at this offset and where it ends; ValueError if a check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise ValueError("no version line")
    end = _HEAD_END.search(data, at + 8)
    if not end:
        raise ValueError("header without an end")
    if end[0] != b"\r\n\r\n":
        raise ValueError("version line within a header")
    body = end.start()
    lines = data[at:body].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    stop = body + 4 + int(head["content-length"])
    block = data[body + 4 : stop]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("content length does not fit")
    if (digest := head.get("warc-block-digest", "")).startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    head["block"] = block
    return head, stop + 4


def _unpacked(data: memoryview, at: int) -> Generator[bytes, None, tuple[int, str]]:
    """The content of the gzip member at this offset, PIECE bytes at most at a time; returns where it ends and why it is broken,
    if it is, after what could be unpacked."""
    unpack, step = zlib.decompressobj(31), 8192
    while not unpack.eof:
        if at >= len(data):
            return len(data), "member cut short"
        rest = data[at : at + step]
        while len(rest) and not unpack.eof:
            before = unpack.copy()
            try:
                piece = unpack.decompress(rest, PIECE)
            except zlib.error as e:
                for k in range(len(rest)):
                    try:
                        piece = before.decompress(rest[k : k + 1])
                    except zlib.error:
                        break
                    yield piece
                return at, f"bad member: {e}"
            yield piece
            rest = unpack.unconsumed_tail
        at, step = at + step, min(2 * step, 1 << 20)
    return min(at, len(data)) - len(unpack.unused_data), ""


def _member_at(data: memoryview, at: int) -> tuple[bytes | None, int, str]:
    """A gzip member's content (None if it is more than HELD_BYTES), where it ends, and why it is broken, if it is."""
    out, size, pieces = [], 0, _unpacked(data, at)
    while True:
        try:
            piece = next(pieces)
        except StopIteration as e:
            return (None if size > HELD_BYTES else b"".join(out)), *e.value
        size += len(piece)
        out.append(piece)
        if size > HELD_BYTES:
            out.clear()


def _streamed(pieces: Iterator[bytes]) -> Iterator[tuple[int, int, str, dict | None]]:
    """As _within, of content that arrives in pieces. Held are the bytes from the record in hand on, no more."""
    held, base, done = bytearray(), 0, False  # base: the offset of held[0]

    def more(size: int) -> None:
        nonlocal done
        while len(held) < size and not done:
            piece = next(pieces, None)
            if piece is None:
                done = True
            else:
                held.extend(piece)

    bad, why = None, ""
    while True:
        more(PIECE)
        if not held:
            break
        end = _HEAD_END.search(held, 8, PIECE) if _VERSION.match(held) else None
        declared = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*\r\n", held[: end.start() + 2]) if end else None
        size = end.end() + int(declared[1]) + 4 if declared and end[0] == b"\r\n\r\n" else 0
        try:
            if size > RECORD_BYTES:
                raise ValueError("record too large")
            more(size)
            head, stop = _parse(bytes(held[: size or PIECE]), 0)
        except ValueError as e:
            bad, why = (base, str(e)) if bad is None else (bad, why)
            found = _VERSION.search(held, 1)
            while not found and not done:  # nine bytes stay, as a version line may be cut
                base += max(0, len(held) - 9)
                del held[: max(0, len(held) - 9)]
                more(len(held) + PIECE)
                found = _VERSION.search(held, 1)
            cut = found.start() if found else len(held)
            base += cut
            del held[:cut]
            continue
        if bad is not None:
            yield bad, base, why, None
            bad = None
        yield base, base + stop, "", head
        base += stop
        del held[:stop]
    if bad is not None:
        yield bad, base, why, None


def _within(content: bytes) -> list[tuple[int, int, str, dict | None]]:
    """Records and gaps of a member's content, by its own offsets."""
    out, at, bad, why = [], 0, None, ""
    while at < len(content):
        try:
            head, stop = _parse(content, at)
        except ValueError as e:
            bad, why = (at, str(e)) if bad is None else (bad, why)
            found = _VERSION.search(content, at + 1)
            at = found.start() if found else len(content)
            continue
        if bad is not None:
            out.append((bad, at, why, None))
            bad = None
        out.append((at, stop, "", head))
        at = stop
    return out if bad is None else [*out, (bad, len(content), why, None)]


def salvage(data: bytes) -> Iterator[tuple[int, int, str, dict | None]]:
    """(start, stop, reason, record): records in order, and between them the gaps, whose record is None. A gap within a
    member has the member's place, and its offsets in the content as part of the reason. The records that a broken member
    still holds come before its gap, whose place includes them. Members of any size are read: of one that is larger than
    HELD_BYTES only the record in hand is held."""
    view, at, bad, why = memoryview(data), 0, None, ""
    while at < len(data):
        inner, failed = [], ""
        if data[at : at + 3] == MAGIC:
            content, stop, failed = _member_at(view, at)
            if content is None:  # records go on as they are found, whatever comes after them
                if bad is not None:
                    yield bad, at, why, None
                    bad = None
                for a, z, reason, head in _streamed(_unpacked(view, at)):
                    yield at, stop, reason and f"{reason} (bytes {a} to {z} of the member's content)", head
                if failed:
                    found = _START.search(data, max(stop, at + 1))
                    yield at, found.start() if found else len(data), failed, None
                    stop = found.start() if found else len(data)
                at = stop
                continue
            inner = _within(content)
            if inner and all(head is None for *_, head in inner):
                inner, failed = [], failed or inner[0][2]
        else:
            try:
                head, stop = _parse(data, at)
                inner = [(0, 0, "", head)]
            except ValueError as e:
                failed = str(e)
        if failed:
            found = _START.search(data, at + 1)
            stop = found.start() if found else len(data)
        if bad is not None and (inner or not failed):
            yield bad, at, why, None
            bad = None
        for a, z, reason, head in inner:
            yield at, stop, reason and f"{reason} (bytes {a} to {z} of the member's content)", head
        if failed and bad is None:
            bad, why = at, failed
        at = stop
    if bad is not None:
        yield bad, len(data), why, None


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _described(path: str, start: int, stop: int, why: str, head: dict | None) -> tuple:
    if head is None:
        return (path, True, start, stop, why, *[None] * 7)
    http, _, payload = head["block"].partition(b"\r\n\r\n")
    kind, declared = head.get("warc-type", ""), re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    digest, size, refers = hashlib.sha256(payload).hexdigest(), len(payload), None
    if kind == "revisit":
        digest, size = head.get("warc-payload-digest", "").removeprefix("sha256:"), int(declared[1]) if declared else None
        payload, refers = None, _page(head.get("warc-refers-to"))
    return path, False, start, stop, None, _page(head.get("warc-record-id")), head.get("warc-target-uri"), kind, payload, size, digest, refers


def _salvaged(payloads: bool):
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _RECORDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = []
                for item in salvage(content.as_py()):
                    row = _described(path, *item)
                    rows.append(row if payloads else (*row[:8], None, *row[9:]))
                    if len(rows) == 1000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives under `path`: rows with gap = true hold a quarantined byte range [start, stop)
    of a file and the first failed check; the others a record. Files may hold plain records, members, or both; each is read
    whole by one task, so none may have more than 2 GiB. An empty folder gives an empty table."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_salvaged(payloads), _RECORDS)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = read_archives(spark, path, payloads=False)
    lost = F.raise_error(F.concat(F.lit("a gap in an archive: "), F.col("reason"), F.lit(" in "), F.col("path")))  # these archives are whole
    page = F.when(F.col("gap"), lost).otherwise(F.col("page_id"))
    return rows.select(page.cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""
