"""WARC archives: a writer with revisit records and a salvage reader.

Writing turns rows into gzip members, one record each, and gathers members
into archives of bounded size. Archives are rows (archive, data) of a Parquet
table, so they can lie in any store that Spark reaches and a repeated task
replaces what it wrote; ``export`` puts them into a folder as files.

Reading walks the bytes. A member that doesn't decompress, or a record whose
header, length or digest fails, is not trusted: the reader looks for the next
gzip magic or version line at which a whole record checks out, goes on there,
and reports the bytes between as a quarantined gap.

Defined results: a null html is an empty payload; null page ids are written as
``null`` and read back as null; of rows with the same id and payload each is a
response if the id is the smallest; an empty table gives no archives; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeweave.scratch import Scratch

log = logging.getLogger(__name__)
LEAST = 100
ARCHIVE_BYTES = 1 << 20
#: Copies of a repeated payload's row, and parts of the pages that share it.
SALTS = 16
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
HEADER_STEP = 1 << 12
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- writing -----------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record: a response, or a revisit of page ``first`` without the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if first is not None:
        head += [("WARC-Refers-To", name(first)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without a time stamp, so equal records have equal bytes."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, first): ``first`` is the page that a revisit refers to, else null.

    Only digests are grouped, with partial sums first. A repeated payload's
    row is copied once for each salt, so the pages that share one payload
    spread over as many tasks when the two are joined.
    """
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.when(F.length("payload") >= least, F.sha2("payload", 256)))
    firsts = p.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(firsts, ["digest", "salt"], "left")
    return out.select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))


def archives(pages: DataFrame, most: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """(archive, data): gzip members of the pages' records, gathered until ``most`` bytes are reached."""
    schema = pa.schema([("archive", pa.string()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            data = b"".join(held)
            return pa.RecordBatch.from_pylist([{"archive": f"pages-{hashlib.sha256(data).hexdigest()[:16]}.warc.gz", "data": data}], schema)

        held: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(member(record(page_id, url, payload, first), level))
                size += len(held[-1])
                if size >= most:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return roles(pages).mapInArrow(run, "archive string, data binary")


def export(table: DataFrame, folder: str) -> int:
    """Writes archives as files into a folder that the driver sees, one at a time; how many."""
    from pathlib import Path

    n = 0
    for n, row in enumerate(table.toLocalIterator(), 1):
        part = Path(folder, row["archive"] + ".part")
        part.write_bytes(row["data"])
        part.rename(Path(folder, row["archive"]))
    return n


# -- reading -----------------------------------------------------------------


@dataclass
class Record:
    """A record that passed its checks."""

    headers: dict[str, str]
    block: bytes
    payload: bytes = field(init=False)

    def __post_init__(self) -> None:
        head, found, body = self.block.partition(END)
        self.payload = body if found and head.startswith(b"HTTP/") else self.block


class Broken(ValueError):
    """What stands at this place is no whole record."""


def parse(data: bytes | memoryview, at: int = 0) -> tuple[Record, int]:
    """The record whose version line is at ``at``, and where the next thing begins."""
    size = HEADER_STEP
    head = bytes(data[at : at + size])
    if not head.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise Broken("no version line")
    while (stop := head.find(END)) < 0:
        if at + size >= len(data):
            raise Broken("header doesn't end")
        size *= 4
        head = bytes(data[at : at + size])
    headers: dict[str, str] = {}
    for line in head[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("header line without colon")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("no length")
    start = at + stop + len(END)
    end = start + int(length)
    if end > len(data):
        raise Broken("truncated")
    if bytes(data[end : end + len(END)]) != END:
        raise Broken("no end of record")
    block = bytes(data[start:end])
    made = Record(headers, block)
    claims = [("warc-block-digest", block)] + [("warc-payload-digest", made.payload)] * (headers.get("warc-type") == "response")
    for name, content in claims:
        kind, _, value = headers.get(name, "").partition(":")
        if kind.lower() == "sha256" and hashlib.sha256(content).hexdigest() != value.lower():
            raise Broken(f"{name} differs")
    return made, end + len(END)


def inflate(data: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """The gzip member at ``at``, where it ends, and what it lacks; fed in steps, so what follows is not copied."""
    out, d, pos = [], zlib.decompressobj(31), at
    try:
        while not d.eof:
            if pos >= len(data):
                return b"".join(out), len(data), "truncated member"
            out.append(d.decompress(data[pos : pos + step]))
            pos += step
    except zlib.error as e:
        raise Broken(f"member: {e}") from None
    return b"".join(out), min(pos, len(data)) - len(d.unused_data), ""


def at_record(data: memoryview, at: int) -> tuple[list[Record | str], int]:
    """What stands at ``at``, plain or in a gzip member, and where it ends.

    In a member the reader goes on at the next version line after what is no
    whole record, and tells why; a member without any whole record is broken.
    """
    if bytes(data[at : at + 3]) != MAGIC:
        one, end = parse(data, at)
        return [one], end
    content, end, lacks = inflate(data, at)
    found: list[Record | str] = []
    pos = 0
    while pos < len(content):
        try:
            one, pos = parse(content, pos)
            found.append(one)
        except Broken as e:
            if not found or not isinstance(found[-1], str):
                found.append(str(e))
            after = content.find(b"WARC/1.", pos + 1)
            pos = after if after >= 0 else len(content)
    if not any(isinstance(x, Record) for x in found):
        raise Broken(lacks or next(iter(found), "empty member"))
    if lacks and not isinstance(found[-1], str):
        found.append(lacks)
    return found, end


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(start, end, record, or why these bytes are quarantined) over a whole archive, without holes."""
    view, pos, lost, why = memoryview(data), 0, -1, ""
    while pos < len(data):
        try:
            found, end = at_record(view, pos)
        except Broken as e:
            if lost < 0:
                lost, why = pos, str(e)
            after = [x for x in (data.find(MAGIC, pos + 1), data.find(b"WARC/1.", pos + 1)) if x >= 0]
            pos = min(after, default=len(data))
            continue
        if lost >= 0:
            yield lost, pos, why
            lost = -1
        for one in found:
            yield pos, end, one
        pos = end
    if lost >= 0:
        yield lost, len(data), why


ROWS = "archive string, start long, end long, gap string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read(table: DataFrame) -> DataFrame:
    """ROWS: one for each record and one for each quarantined gap, which ``gap`` explains.

    ``payload_bytes`` and ``payload_digest`` are of the full payload: counted
    anew for responses, and as their record states them for revisits.
    """
    names = [x.split()[0] for x in ROWS.split(", ")]

    def number(name: str) -> int | None:
        last = name.strip("<>").rpartition(":")[2]
        return int(last) if last.lstrip("-").isdigit() else None

    def row(archive: str, start: int, end: int, one: Record | str) -> tuple:
        if isinstance(one, str):
            return (archive, start, end, one, *[None] * 7)
        h = one.headers
        whole = h.get("warc-type") == "response"
        size = len(one.payload)
        if not whole:
            size = next((int(v) for k, _, v in (x.partition(b":") for x in one.block.split(b"\r\n")) if k.lower() == b"content-length"), 0)
        digest = hashlib.sha256(one.payload).hexdigest() if whole else h.get("warc-payload-digest", "").rpartition(":")[2]
        refers = number(h["warc-refers-to"]) if "warc-refers-to" in h else None
        return archive, start, end, None, number(h.get("warc-record-id", "")), h.get("warc-target-uri"), h.get("warc-type"), one.payload if whole else None, size, digest, refers

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [row(archive, *x) for x in salvage(data or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    return table.select("archive", "data").mapInArrow(run, ROWS)


def logged_gaps(found: DataFrame) -> int:
    """How many byte gaps are quarantined; each reason is logged with its gaps and bytes."""
    total = 0
    for r in found.filter("gap is not null").groupBy("gap").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes")).collect():  # reasons are of few kinds
        log.warning("%d gaps of %d bytes quarantined: %s", r["n"], r["bytes"], r["gap"])
        total += r["n"]
    return total


def round_trip(pages: DataFrame) -> DataFrame:
    """One row for each page, as read back from the archives that were written; a page that isn't found again is an error."""
    scratch = Scratch(pages.sparkSession, "warc")
    found = scratch.keep(read(scratch.keep(archives(pages), "archives")).drop("payload"), "read")
    logged_gaps(found)
    written, kept = pages.count(), found.filter("gap is null")
    if (n := kept.count()) != written:
        raise RuntimeError(f"{written} pages written, {n} read back")
    return kept.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
