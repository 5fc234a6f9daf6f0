"""Media columns: ISO base media containers.

``write_container`` stores a payload losslessly as unsigned 8-bit PCM (sample entry ``raw ``) in an ISO
file: access units of UNIT bytes, chunks of CHUNK units, a sync unit every SYNC. ``walk`` descends the
nested boxes (32- and 64-bit sizes, size 0 to the end) and ``describe`` decodes the sample tables (stts,
stsc, stsz, stco / co64, stss) into codec, duration and the byte range of every keyframe; payload bytes
are only located, never decoded. ``stored_bytes`` then fetches a track's samples by those ranges. Samples of
movie fragments (moof / traf / trun with the defaults of trex and tfhd) follow those of the sample tables.

Defined cases: a null text is an empty payload, stored as one unit of zeros; a damaged container gives
nulls with the reason, and no count it states is trusted beyond the bytes that are there; empty tables give
no rows; equal texts and repeated rows give equal values; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batch, map_rows, read

UNIT = 64
CHUNK = 256
SYNC = 32
RATE = 8000
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"])


class BadContainer(ValueError):
    pass


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_container(payload: bytes) -> bytes:
    """An ISO file with one audio track that holds payload, whose length is a positive multiple of UNIT."""
    units = len(payload) // UNIT
    chunks = -(-units // CHUNK)
    scale = RATE // UNIT
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    stsc = [(1, CHUNK, 1)] if units % CHUNK == 0 or chunks == 1 else [(1, CHUNK, 1), (chunks, units % CHUNK, 1)]
    if chunks == 1:
        stsc = [(1, units, 1)]
    syncs = np.arange(1, units + 1, SYNC, dtype=">u4")

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * UNIT)
        wide = first + len(payload) >= 1 << 32
        offsets = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, 1)),
            _full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            offsets,
            _full(b"stss", struct.pack(">I", len(syncs)), syncs.tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, units, 0x55C4, 0))
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, units), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, scale, units, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    big = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if big else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(ftyp) + len(moov(0 if not big else 1 << 33)) + len(head)
    return ftyp + moov(first) + head + payload


@dataclass
class Box:
    kind: bytes
    start: int
    body: int
    end: int
    children: list["Box"]

    def find(self, *path: bytes) -> list["Box"]:
        found = [c for c in self.children if c.kind == path[0]]
        return found if len(path) == 1 else [x for c in found for x in c.find(*path[1:])]


def walk(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[Box]:
    """The boxes of data[at:end], containers opened."""
    end = len(data) if end is None else end
    if depth > 16:
        raise BadContainer("boxes are nested too deeply")
    out = []
    while at < end:
        if end - at < 8:
            raise BadContainer("box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise BadContainer("box header is cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise BadContainer(f"box {kind!r} does not fit its parent")
        out.append(Box(kind, at, body, at + size, walk(data, body, at + size, depth + 1) if kind in CONTAINERS else []))
        at += size
    return out


def _table(data: bytes, box: Box, columns: int, skip: int = 0, wide: bool = False) -> np.ndarray:
    """The rows of a counted table of big-endian integers that starts skip bytes after version and flags."""
    at = box.body + 4 + skip
    if at + 4 > box.end:
        raise BadContainer(f"table {box.kind!r} is cut short")
    (n,) = struct.unpack_from(">I", data, at)
    width = 8 if wide else 4
    if at + 4 + n * columns * width > box.end:
        raise BadContainer(f"table {box.kind!r} is cut short")
    return np.frombuffer(data, ">u8" if wide else ">u4", n * columns, at + 4).astype(np.int64).reshape(n, columns)


@dataclass
class Track:
    handler: str
    codec: str
    timescale: int
    duration: float
    offsets: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    sync: np.ndarray

    @property
    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges [start, end) of the sync samples."""
        i = self.sync
        return list(zip(self.offsets[i].tolist(), (self.offsets[i] + self.sizes[i]).tolist(), strict=True))


def describe(data: bytes) -> list[Track]:
    """The tracks of a container from its boxes and sample tables."""
    tracks, top = [], walk(data)
    more = _fragments(data, top)
    for trak in [t for m in top if m.kind == b"moov" for t in m.children if t.kind == b"trak"]:
        stbl = trak.find(b"mdia", b"minf", b"stbl")
        if not stbl:
            raise BadContainer("track without sample tables")
        table = {b.kind: b for b in stbl[0].children}
        mdhd, hdlr = trak.find(b"mdia", b"mdhd"), trak.find(b"mdia", b"hdlr")
        if missing := {b"stsd", b"stts", b"stsc", b"stsz"} - set(table) or not mdhd or not ({b"stco", b"co64"} & set(table)):
            raise BadContainer(f"missing boxes: {missing}")
        scale, ticks = struct.unpack_from(">IQ", data, mdhd[0].body + 20) if data[mdhd[0].body] == 1 else struct.unpack_from(">II", data, mdhd[0].body + 12)
        codec = data[table[b"stsd"].body + 12 : table[b"stsd"].body + 16].decode("latin-1")
        fixed, n = struct.unpack_from(">II", data, table[b"stsz"].body + 4)
        if fixed and n > len(data) // fixed:
            raise BadContainer("stsz states more bytes than the file has")
        sizes = np.full(n, fixed, np.int64) if fixed else _table(data, table[b"stsz"], 1, 4)[:, 0]
        stts = _table(data, table[b"stts"], 2)
        if stts[:, 0].sum() != n:
            raise BadContainer("stts and stsz differ in samples")
        times = np.concatenate([[0], np.cumsum(np.repeat(stts[:, 1], stts[:, 0]))[:-1]]) if n else np.empty(0, np.int64)
        chunk = _table(data, table[b"co64"], 1, wide=True)[:, 0] if b"co64" in table else _table(data, table[b"stco"], 1)[:, 0]
        stsc = _table(data, table[b"stsc"], 3)
        runs = np.diff(np.append(stsc[:, 0], len(chunk) + 1))
        if (runs < 0).any() or (len(stsc) and stsc[0, 0] != 1):
            raise BadContainer("stsc runs are out of order")
        per = np.repeat(stsc[:, 1], runs)
        if per.sum() != n:
            raise BadContainer("stsc and stsz differ in samples")
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.empty(0, np.int64)
        first = np.concatenate([[0], np.cumsum(per)[:-1]]) if len(per) else np.empty(0, np.int64)
        own = np.repeat(np.arange(len(per)), per)
        offsets = chunk[own] + before - before[first[own]] if n else before
        if n and (offsets + sizes).max() > len(data):
            raise BadContainer("samples lie beyond the file")
        sync = _table(data, table[b"stss"], 1)[:, 0] - 1 if b"stss" in table else np.arange(n)
        if len(sync) and (sync.min() < 0 or sync.max() >= n):
            raise BadContainer("stss names a sample that is not there")
        kind = data[hdlr[0].body + 8 : hdlr[0].body + 12].decode("latin-1") if hdlr else ""
        if extra := more.get(_track_id(data, trak)):
            begin = int(stts.prod(axis=1).sum())
            place, size, span, key = (np.array(x, np.int64) for x in zip(*extra, strict=True))
            if (place < 0).any() or (place + size).max() > len(data):
                raise BadContainer("samples lie beyond the file")
            sync = np.concatenate([sync, n + np.flatnonzero(key)])
            offsets, sizes = np.concatenate([offsets, place]), np.concatenate([sizes, size])
            times = np.concatenate([times, begin + np.cumsum(span) - span])
            ticks = max(ticks, begin + int(span.sum()))
        tracks.append(Track(kind, codec, scale, ticks / scale if scale else 0.0, offsets, sizes, times, sync))
    return tracks


def _track_id(data: bytes, trak: Box) -> int | None:
    tkhd = trak.find(b"tkhd")
    return struct.unpack_from(">I", data, tkhd[0].body + (20 if data[tkhd[0].body] == 1 else 12))[0] if tkhd else None


#: Flags of tfhd, in the order of their fields, and of trun's fields of a sample.
_TFHD = ((0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I"))
_TRUN = (0x100, 0x200, 0x400, 0x800)
_DEFAULT_BASE_IS_MOOF, _NOT_SYNC = 0x20000, 0x10000


def _fields(data: bytes, box: Box, at: int, layout: tuple) -> tuple[dict[int, int], int]:
    """The optional fields that a box's flags announce, and the place after them."""
    flags, out = int.from_bytes(data[box.body + 1 : box.body + 4], "big"), {}
    for flag, form in layout:
        if flags & flag:
            if at + struct.calcsize(form) > box.end:
                raise BadContainer(f"box {box.kind!r} is cut short")
            out[flag] = struct.unpack_from(form, data, at)[0]
            at += struct.calcsize(form)
    return out, at


def _fragments(data: bytes, top: list[Box]) -> dict[int, list[tuple[int, int, int, bool]]]:
    """Per track id the (offset, size, duration, sync) of the samples in movie fragments, in file order."""
    defaults = {}
    for trex in [x for m in top if m.kind == b"moov" for x in m.find(b"mvex", b"trex")]:
        track, _, span, size, flags = struct.unpack_from(">5I", data, trex.body + 4)
        defaults[track] = span, size, flags
    out: dict[int, list[tuple[int, int, int, bool]]] = {}
    for moof in [x for x in top if x.kind == b"moof"]:
        after = moof.start
        for traf in moof.find(b"traf"):
            tfhd = traf.find(b"tfhd")
            if not tfhd:
                raise BadContainer("track fragment without a header")
            (track,) = struct.unpack_from(">I", data, tfhd[0].body + 4)
            own, _ = _fields(data, tfhd[0], tfhd[0].body + 8, _TFHD)
            flags = int.from_bytes(data[tfhd[0].body + 1 : tfhd[0].body + 4], "big")
            base = own.get(0x1, moof.start if flags & _DEFAULT_BASE_IS_MOOF else after)
            span, size, how = (own.get(f, d) for f, d in zip((0x8, 0x10, 0x20), defaults.get(track, (0, 0, 0)), strict=True))
            at = base
            for trun in traf.find(b"trun"):
                (n,) = struct.unpack_from(">I", data, trun.body + 4)
                first, place = _fields(data, trun, trun.body + 8, ((0x1, ">i"), (0x4, ">I")))
                at = base + first[0x1] if 0x1 in first else at
                has = [f for f in _TRUN if int.from_bytes(data[trun.body + 1 : trun.body + 4], "big") & f]
                if has and place + 4 * n * len(has) > trun.end or not has and size and n > len(data) // size:
                    raise BadContainer("trun states more samples than there are")
                if not (has or size):
                    raise BadContainer("samples of a fragment have no size")
                rows = np.frombuffer(data, ">u4", n * len(has), place).reshape(n, len(has)).tolist()
                for k, row in enumerate(rows):
                    value = dict(zip(has, row, strict=True))
                    own_flags = value.get(0x400, first.get(0x4, how) if k == 0 else how)
                    one = value.get(0x200, size)
                    out.setdefault(track, []).append((at, one, value.get(0x100, span), not own_flags & _NOT_SYNC))
                    at += one
            after = at
    return out


def stored_bytes(data: bytes, track: Track) -> bytes:
    """A track's samples in order, by their byte ranges; adjacent ranges are fetched together."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts, stops = track.offsets[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


def to_payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


_RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_MEDIA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("samples", T.LongType()),
        T.StructField("keyframes", T.ArrayType(_RANGE)),
        T.StructField("problem", T.StringType()),
    ]
)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out: dict[str, list] = {n: [] for n in _MEDIA.names}
        for doc_id, text in zip(rows[0].to_pylist(), rows[1].to_pylist(), strict=True):
            payload, n = to_payload(text)
            media = write_container(payload)
            del payload
            (track,) = describe(media)
            back = stored_bytes(media, track)
            ranges = [{"start": a, "end": b} for a, b in track.keyframes]
            row = (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), track.codec, track.duration, len(track.sizes), ranges, None)
            for name, v in zip(_MEDIA.names, row, strict=True):
                out[name].append(v)
        yield batch(out, _MEDIA)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out: dict[str, list] = {n: [] for n in _TRACK.names}
        for key, data in zip(rows[0].to_pylist(), rows[1].to_pylist(), strict=True):
            try:
                found = [(key, i, t.handler, t.codec, t.duration, len(t.sizes), [{"start": a, "end": b} for a, b in t.keyframes], None) for i, t in enumerate(describe(data or b""))]
                found = found or [(key, *[None] * 6, "no track")]
            except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:
                found = [(key, None, None, None, None, None, None, str(e))]
            for row in found:
                for name, v in zip(_TRACK.names, row, strict=True):
                    out[name].append(v)
        yield batch(out, _TRACK)


_TRACK = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("track", T.IntegerType()),
        T.StructField("handler", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("samples", T.LongType()),
        T.StructField("keyframes", T.ArrayType(_RANGE)),
        T.StructField("problem", T.StringType()),
    ]
)


def media_columns(files: DataFrame) -> DataFrame:
    """(path, content) to a row per track: codec, duration, samples and keyframe byte ranges, or the problem."""
    return map_rows(files.select("path", "content"), _described, _TRACK)


def store_texts(docs: DataFrame) -> DataFrame:
    """Every text stored in a container, read back and described."""
    return map_rows(docs.select("doc_id", "text"), _stored, _MEDIA)


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store_texts(read(spark, sf_dir, "documents"))
    ranges = F.concat_ws(",", F.transform("keyframes", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))))
    feature = F.concat(F.col("codec"), F.lit(";"), F.format_string("%.3f", "duration"), F.lit("s;"), F.col("samples").cast("string"), F.lit(" samples;"), F.size("keyframes").cast("string"), F.lit(" keyframes;"), F.sha2(ranges, 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
