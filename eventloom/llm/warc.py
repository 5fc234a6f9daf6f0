"""WARC archives: a writer in plain DataFrame operations and a salvage reader.

Writing: records are built by DataFrame functions and written by Spark's text sink, whose committer gives
whole archives in any store. Plain archives have the two empty lines after a record as the sink's line
separator; compressed ones have a gzip member per record and an empty member as separator, so that damage
costs one record. Of records with equal payloads the one with the smallest id is a response, the others
revisit it.

Reading: archives (plain, or gzip members of any size) are walked record by record. A record counts if
its version line, headers, Content-Length and closing lines are right and its payload has the digest it
states. After a failed check the reader looks for the next version line, also inside a member, goes on from
there and logs the bytes between as a quarantined gap. What a damaged or cut member decompresses to before
its fault is read like any other; the reader then looks for the next gzip member that opens into a version
line. So every byte of the archive lies in a plain record, in a member or in a gap, and every decompressed
byte of a member in a record or in a gap, whose offsets then count decompressed bytes of the member it
names. A record of a damaged member that states no digest is given out as not verified.

Defined cases: a null payload is empty; a null id writes no id header and reads as null; rows that share
an id and a payload are all responses if they are the smallest; empty tables give empty archives and no rows; extra
columns are ignored. Archives are cut by bytes (TARGET_BYTES on average), as a reader's task holds one whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batch, map_rows, read, scratch_path, stash

MIN_REVISIT = 100
#: Payload bytes that an archive holds on average, far below the 2 GB that one row can.
TARGET_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000" + "0000")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


# Writer


def revisits(pages: DataFrame, payload: str = "html", key: str = "page_id", least: int = MIN_REVISIT) -> DataFrame:
    """(warc_key, warc_digest, warc_owner) of the pages that revisit an earlier one; joins carry no payloads."""
    value = F.coalesce(F.col(payload), F.lit(""))
    d = pages.where(F.octet_length(value) >= least).select(F.col(key).alias("warc_key"), F.sha2(value, 256).alias("warc_digest"))
    d = stash(d, "warc-digests")
    owners = stash(d.groupBy("warc_digest").agg(F.min("warc_key").alias("warc_owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-owners")
    return stash(d.join(owners, "warc_digest").where("warc_key <> warc_owner").select("warc_key", "warc_digest", "warc_owner").distinct(), "warc-revisits")


def records(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", least: int = MIN_REVISIT) -> DataFrame:
    """One column ``value``: a record per row, without its closing empty lines."""
    value = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("warc_key"), F.regexp_replace(F.col(url), r"[\s]+", "%20").alias("u"), value.alias("p"), F.sha2(value, 256).alias("d"))
    seen = revisits(pages, payload, key, least).hint("shuffle_hash")
    rows = rows.join(seen, (rows.warc_key == seen.warc_key) & (rows.d == seen.warc_digest), "left").drop(seen.warc_key)
    again = F.col("warc_owner").isNotNull()
    line = lambda name, v: F.coalesce(F.concat(F.lit(f"{name}: "), v.cast("string"), F.lit("\r\n")), F.lit(""))
    block = F.concat(F.lit(HTTP_HEAD), F.when(again, "").otherwise(F.col("p")))
    record_id = lambda k: F.concat(F.lit("<urn:page:"), k.cast("string"), F.lit(":"), F.col("d"), F.lit(">"))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(again, "revisit").otherwise("response")),
            line("WARC-Record-ID", F.coalesce(record_id(F.col("warc_key")), F.concat(F.lit("<urn:page::"), F.col("d"), F.lit(">")))),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Target-URI", F.col("u")),
            line("WARC-Refers-To", F.when(again, record_id(F.col("warc_owner")))),
            line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("d"))),
            line("X-Payload-Length", F.octet_length("p")),
            line("X-Page-Id", F.col("warc_key")),
            line("X-Refers-To-Page", F.col("warc_owner")),
            F.lit("Content-Type: application/http;msgtype=response\r\n"),
            line("Content-Length", F.octet_length(block)),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def gzip_member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record + END) + c.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield pa.RecordBatch.from_arrays([pa.array([gzip_member(x.encode()) for x in rows[0].to_pylist()], pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, compress: bool = True, target_bytes: int = TARGET_BYTES, **columns) -> None:
    """Write archives below path, plain or with a gzip member per record."""
    mean = pages.agg(F.avg(F.octet_length(columns.get("payload", "html")))).first()[0] or 0
    rows = records(pages, **columns)
    if compress:  # the sink writes a string's bytes as they are
        rows = map_rows(rows, _members, T.StructType([T.StructField("value", T.BinaryType())])).select(F.col("value").cast("string"))
    separator = EMPTY_MEMBER if compress else END
    sink = rows.write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1"))
    sink.option("maxRecordsPerFile", max(1, int(target_bytes / (mean + 1000)))).text(path)


# Reader


@dataclass
class Record:
    """A record at ``offset`` of the archive, or of the member that holds it; verified by its digest or its member's checksum."""

    offset: int
    headers: dict[str, str]
    block: bytes = field(repr=False)
    verified: bool = True

    @property
    def payload(self) -> bytes:
        if self.headers.get("content-type", "").startswith("application/http"):
            head, _, body = self.block.partition(END)
            return body if head.startswith(b"HTTP/") else self.block
        return self.block


@dataclass
class Gap:
    """Quarantined bytes [offset, end) and the check that failed; of the archive, or of what the member at ``member`` holds."""

    offset: int
    end: int
    reason: str
    member: int | None = None


def _parse(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record at ``at`` and the place after it, or the reason why there is none."""
    m = _VERSION.match(data, at)
    if not m:
        return "no version line"
    stop = data.find(END, m.end() - 2)
    if stop < 0:
        return "headers do not end"
    headers: dict[str, str] = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "header without a colon"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    n = headers.get("content-length", "")
    if not (n.isascii() and n.isdigit()):
        return "no content length"
    begin = stop + len(END)
    end = begin + int(n)
    if data[end : end + len(END)] != END:
        return "block does not end where its length says"
    record = Record(at, headers, data[begin:end])
    stated = headers.get("warc-payload-digest", "")
    record.verified = stated.startswith("sha256:") and headers.get("warc-type") != "revisit"
    if record.verified and hashlib.sha256(record.payload).hexdigest() != stated[7:].lower():
        return "payload digest differs"
    return record, end + len(END)


def _plain(data: bytes, at: int = 0) -> Iterator[Record | Gap]:
    """Records and gaps of plain bytes from ``at`` to their end."""
    while at < len(data):
        got = _parse(data, at)
        if isinstance(got, str):
            nxt = _VERSION.search(data, at + 1)
            while nxt and isinstance(_parse(data, nxt.start()), str):  # a version line inside a damaged block
                nxt = _VERSION.search(data, nxt.start() + 1)
            end = nxt.start() if nxt else len(data)
            yield Gap(at, end, got)
            at = end
        else:
            yield got[0]
            at = got[1]


def _content(data: bytes, at: int) -> int:
    """Where the deflate stream of the gzip member at ``at`` begins; -1 if its header is not whole."""
    flags, end = data[at + 3] if at + 10 <= len(data) else 0xFF, at + 10
    if flags & 0xE0:
        return -1
    if flags & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for named in (8, 16):  # a file name, a comment
        if flags & named:
            end = data.find(b"\0", end) + 1 or len(data) + 1
    end += 2 if flags & 2 else 0
    return end if end <= len(data) else -1


def _member(data: bytes, at: int, step: int = 1 << 15) -> tuple[bytes, int, int, str]:
    """(content, stop, after, problem) of the gzip member at ``at``: bytes [stop, after) could not be used."""
    at = _content(data, at)
    if at < 0:
        return b"", 0, 0, "gzip header is not whole"
    d, out = zlib.decompressobj(-15), []
    while at < len(data) and not d.eof:
        before = d.copy()
        try:
            out.append(d.decompress(data[at : at + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), at, at, f"gzip: {e}"
            d, step = before, max(1, step // 32)  # narrow the fault down to its byte; all before it counts
            continue
        at += min(step, len(data) - at)
    inner = b"".join(out)
    if not d.eof:
        return inner, at, at, "gzip member is cut short"
    stop = at - len(d.unused_data)
    after = min(stop + 8, len(data))
    if data[stop:after] == struct.pack("<II", zlib.crc32(inner), len(inner) & 0xFFFFFFFF):
        return inner, after, after, ""
    return inner, stop, after, "gzip member is cut short" if after < stop + 8 else "gzip: checksum differs"


def _opens(data: bytes, at: int) -> bool:
    """Whether a member starts at ``at`` that is empty or holds a version line."""
    inner, _, _, problem = _member(data, at)
    return bool(_VERSION.search(inner)) or not (inner or problem)


def _next_start(data: bytes, at: int) -> int:
    """The first place from ``at`` with a record that passes its checks or a member that opens into one; else the end."""
    spots = []
    line = _VERSION.search(data, at)
    while line and isinstance(_parse(data, line.start()), str):
        line = _VERSION.search(data, line.start() + 1)
    if line:
        spots.append(line.start())
    z = data.find(GZIP, at)
    while 0 <= z < min(spots, default=len(data)):
        if _opens(data, z):
            spots.append(z)
        z = data.find(GZIP, z + 1)
    return min(spots, default=len(data))


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive in order; a record of a member has the member's offset."""
    at = 0
    while at < len(data):
        if data[at : at + 3] == GZIP:
            inner, stop, after, problem = _member(data, at)
            if problem and not _VERSION.search(inner):
                after = _next_start(data, at + 1)
                yield Gap(at, after, problem)
                at = after
                continue
            for x in _plain(inner):
                if isinstance(x, Gap):
                    yield Gap(x.offset, x.end, x.reason, member=at)
                else:
                    x.offset, x.verified = at, x.verified or not problem
                    yield x
            if problem:
                after = _next_start(data, at + 1)  # not from stop: a fault may have led past the next member
                if stop < after:
                    yield Gap(stop, after, problem)
            at = after
            continue
        got = _parse(data, at)
        if isinstance(got, str):
            after = _next_start(data, at + 1)
            yield Gap(at, after, got)
            at = after
        else:
            got[0].verified = True
            yield got[0]
            at = got[1]


_READ = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("gap_end", T.LongType()),
        T.StructField("gap_member", T.LongType()),
        T.StructField("gap_reason", T.StringType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _number(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch(r"-?\d{1,18}", x) else None


def _row(path: str, x: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(x, Gap):
        return (path, x.offset, x.end, x.member, x.reason, *[None] * 8)
    h, payload = x.headers, x.payload
    again = h.get("warc-type") == "revisit"
    n = _number(h.get("x-payload-length")) if again else len(payload)
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if again else hashlib.sha256(payload).hexdigest()
    names = (h.get("warc-type"), h.get("warc-target-uri"), _number(h.get("x-page-id")))
    return (path, x.offset, None, None, None, x.verified, *names, n, digest, _number(h.get("x-refers-to-page")), payload if with_payload else None)


def _walked(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                path, data = rows[0][i].as_py(), rows[1][i].as_py()
                out: dict[str, list] = {n: [] for n in _READ.names}
                size = 0
                for x in salvage(data):
                    for name, v in zip(_READ.names, _row(path, x, with_payload), strict=True):
                        out[name].append(v)
                    size += len(out["payload"][-1] or b"")
                    if len(out["archive"]) >= 1000 or size > 8 << 20:
                        yield batch(out, _READ)
                        out, size = {n: [] for n in _READ.names}, 0
                yield batch(out, _READ)

    return run


def scan(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps (gap_reason not null) of the archives below path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_rows(files, _walked(with_payload), _READ, 1)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back; a gap in an archive just written is an error, not a lost page."""
    path = scratch_path(spark, "warc")
    write(read(spark, sf_dir, "pages"), path)
    found = scan(spark, path, with_payload=False)
    gap = F.concat(F.lit("gap in "), F.col("archive"), F.lit(": "), F.col("gap_reason"))
    whole = F.when(F.col("gap_reason").isNotNull(), F.raise_error(gap).cast("string")).otherwise(F.col("record_type"))
    return found.select("page_id", "payload_bytes", "payload_digest", whole.alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS digest FROM p),
o AS (SELECT digest, min(page_id) AS owner FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM d LEFT JOIN o ON d.digest = o.digest
"""
