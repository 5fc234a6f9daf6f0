"""Stated counts are not trusted; movie fragments; the query against a plain version of itself."""

import hashlib
import random
import struct
import zlib

import pytest

from eventloom.llm import media


def patched(data: bytes, kind: bytes, skip: int, value: int) -> bytes:
    at = data.index(kind) + 4 + skip
    return data[:at] + struct.pack(">I", value) + data[at + 4 :]


@pytest.mark.parametrize("kind, skip", [(b"stsz", 8), (b"stsz", 4), (b"stts", 4), (b"stts", 8), (b"stsc", 4), (b"stsc", 12), (b"stco", 4), (b"stss", 4)])
def test_huge_counts_give_a_problem_not_a_crash(spark, kind, skip):
    data = patched(media.write_container(bytes(range(256)) * 8), kind, skip, 0xFFFFFFFF)
    (row,) = media.media_columns(spark.createDataFrame([("x", data)], "path string, content binary")).collect()
    assert row["problem"] and row["samples"] is None


def fragmented(parts: list[bytes], sizes_given: bool, moof_base: bool) -> bytes:
    """An empty movie, then a fragment per part whose samples are 10 bytes each, the first of each part a sync sample."""
    box, full = media._box, media._full
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(20))), *(full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")), full(b"stsz", struct.pack(">II", 0, 0)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 0, 0, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(70)), mdia)
    out = box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 5, 0 if sizes_given else 10, 0x10000))))
    for p in parts:
        n = len(p) // 10

        def moof(first, n=n):
            tfhd = full(b"tfhd", struct.pack(">I", 7), flags=0x20000 if moof_base else 0)
            rows = struct.pack(f">{n}I", *[10] * n) if sizes_given else b""
            return box(b"moof", box(b"traf", tfhd, full(b"trun", struct.pack(">IiI", n, first, 0), rows, flags=0x5 | (0x200 if sizes_given else 0))))

        out += moof(len(moof(0)) + 8) + box(b"mdat", p)
    return out


@pytest.mark.parametrize("sizes_given", [True, False])
@pytest.mark.parametrize("moof_base", [True, False])
def test_fragments_are_located(sizes_given, moof_base):
    r = random.Random(1)
    parts = [bytes(r.randrange(256) for _ in range(10 * n)) for n in (4, 1, 6)]
    data = fragmented(parts, sizes_given, moof_base)
    (track,) = media.describe(data)
    assert media.stored_bytes(data, track) == b"".join(parts)
    assert (track.codec, track.handler, len(track.sizes), track.duration) == ("avc1", "vide", 11, 11 * 5 / 100)
    assert [data[a:b] for a, b in track.keyframes] == [p[:10] for p in parts]
    assert track.times.tolist() == list(range(0, 55, 5))


def test_damaged_fragments_never_crash(spark):
    data = fragmented([bytes(40), bytes(60)], True, True)
    r = random.Random(5)
    rows = [(str(i), data[:k] + bytes([r.randrange(256)]) + data[k + 1 :]) for i, k in enumerate(range(0, len(data), 3))]
    assert media.media_columns(spark.createDataFrame(rows, "path string, content binary")).count() >= len(rows)


def test_query_equals_a_plain_version(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in media.op4_iso_media(spark, str(tmp_path)).collect())
    want = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        whole = media.write_container(payload)
        n = len(payload) // 64
        at = len(whole) - len(payload)
        keys = [(at + 64 * i, at + 64 * i + 64) for i in range(0, n, 32)]
        ranges = hashlib.sha256(",".join(f"{a}-{b}" for a, b in keys).encode()).hexdigest()
        feature = f"raw ;{n * 64 / 8000:.3f}s;{n} samples;{len(keys)} keyframes;{ranges}"
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest(), feature))
    assert got == sorted(want)
    assert media.op4_iso_media(spark, str(tmp_path)).columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
