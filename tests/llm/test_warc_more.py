"""Salvage inside members: what is damaged is named, what is whole is kept."""

import hashlib
import random

import pytest

from eventloom.llm import warc

HEAD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n"


def record(body: bytes, digest: bool = True) -> bytes:
    if not digest:
        return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return HEAD % (hashlib.sha256(body).hexdigest().encode(), len(body)) + body


def bodies(n: int, seed: int = 0) -> list[bytes]:
    r = random.Random(seed)
    return [bytes(r.choice(b"abcdefgh ") for _ in range(r.randint(20, 90))) + b" %d" % i for i in range(n)]


def member(parts: list[bytes]) -> bytes:
    return warc.gzip_member(warc.END.join(parts))


def walked(data):
    found = list(warc.salvage(data))
    return [x for x in found if isinstance(x, warc.Record)], [x for x in found if isinstance(x, warc.Gap)]


def covers(data, records, gaps):
    """Every byte of a member's content, and of the archive, is in one place: no gap overlaps another."""
    for m in {g.member for g in gaps}:
        own = sorted((g.offset, g.end) for g in gaps if g.member == m)
        assert all(a < b for a, b in own) and all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("digest", [True, False])
def test_member_cut_at_its_end(digest):
    own = bodies(200)
    data = member([record(b, digest) for b in own])
    records, gaps = walked(data[:-3])
    assert [r.payload for r in records] == own
    assert [(g.offset, g.end, g.member) for g in gaps] == [(len(data) - 8, len(data) - 3, None)]  # what is left of the checksum
    assert all(r.verified is digest for r in records)
    records, gaps = walked(data[: len(data) // 2])
    assert [r.payload for r in records] == own[: len(records)] and 80 < len(records) < 120
    covers(data, records, gaps)
    assert [g.member for g in gaps] == [0]


def test_member_damaged_near_its_end():
    own = bodies(200)
    data = bytearray(member([record(b) for b in own]))
    data[-40] ^= 0x10
    records, gaps = walked(bytes(data) + warc.gzip_member(record(b"after")))
    assert [r.payload for r in records][:190] == own[:190] and records[-1].payload == b"after"
    assert {r.payload for r in records} <= {*own, b"after"}
    covers(data, records, gaps)


def test_first_record_of_a_member_is_damaged():
    own = bodies(200)
    parts = [record(b) for b in own]
    parts[0] = b"XARC" + parts[0][4:]
    records, gaps = walked(member(parts))
    assert [r.payload for r in records] == own[1:]
    assert [(g.offset, g.end, g.member) for g in gaps] == [(0, len(parts[0]) + 4, 0)]


def test_damaged_record_amid_a_member_is_the_only_gap():
    own = bodies(200)
    parts = [record(b) for b in own]
    at = sum(len(p) + 4 for p in parts[:77])
    parts[77] = parts[77][:-3] + b"zzz"
    head = warc.gzip_member(record(b"before"))
    records, gaps = walked(head + member(parts))
    assert [r.payload for r in records] == [b"before", *own[:77], *own[78:]]
    assert [(g.offset, g.end, g.member, g.reason) for g in gaps] == [(at, at + len(parts[77]) + 4, len(head), "payload digest differs")]


def test_any_damaged_byte_of_members_of_several_records():
    own = bodies(12, 3)
    groups = [[record(b) for b in own[i : i + 4]] for i in (0, 4, 8)]
    packed = [member(g) for g in groups]
    data = b"".join(packed)
    for at in range(0, len(data), 3):
        bad = bytearray(data)
        bad[at] ^= 0xA5
        records, gaps = walked(bytes(bad))
        found = [r.payload for r in records]
        hit = next(i for i in range(3) if at < sum(map(len, packed[: i + 1])))
        assert {r.payload for r in records if r.verified} <= set(own), at
        others = [b for i in range(3) if i != hit for b in own[4 * i : 4 * i + 4]]
        assert others == [b for b in found if b in others], at
        covers(data, records, gaps)


def test_very_long_record_and_archives_cut_by_bytes(spark, tmp_path):
    rows = [(i, "u", ("long %d " % i) * (200_000 if i == 3 else 40)) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"{tmp_path}/a", target_bytes=100_000)
    found = warc.scan(spark, f"{tmp_path}/a")
    assert found.select("archive").distinct().count() > 5
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in found.collect()}
    assert got == {i: h for i, _, h in rows}


def test_query_fails_on_a_gap(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc(spark, str(tmp_path)).count() == 1
    monkeypatch.setattr(warc, "EMPTY_MEMBER", b"junk")
    with pytest.raises(Exception, match="gap in"):
        warc.op1_warc(spark, str(tmp_path)).collect()
