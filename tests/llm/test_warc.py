import hashlib

from eventloom.llm import warc

RECORDS = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(b) + b for b in (b"one", b"two WARC/1.0\r\n inside", b"three\r\n\r\nfour", b"five")]


def bodies(data):
    return [x.payload for x in warc.salvage(data) if isinstance(x, warc.Record)]


def gaps(data):
    return [(x.offset, x.end) for x in warc.salvage(data) if isinstance(x, warc.Gap)]


def test_whole_archives():
    for pack in (lambda r: r + warc.END, warc.gzip_member, lambda r: warc.gzip_member(r) + warc.EMPTY_MEMBER):
        data = b"".join(map(pack, RECORDS))
        assert bodies(data) == [b"one", b"two WARC/1.0\r\n inside", b"three\r\n\r\nfour", b"five"] and not gaps(data)


def test_every_byte_is_a_record_or_a_gap_after_damage():
    for pack in (lambda r: r + warc.END, warc.gzip_member):
        parts = list(map(pack, RECORDS))
        data = b"".join(parts)
        for at in range(len(data)):
            bad = bytearray(data)
            bad[at] ^= 0x55
            found = bodies(bytes(bad))
            hit = next(i for i in range(len(parts)) if at < sum(map(len, parts[: i + 1])))
            for i, want in enumerate((b"one", b"two WARC/1.0\r\n inside", b"three\r\n\r\nfour", b"five")):
                assert i == hit or want in found, (at, i)


def test_junk_and_cut_ends():
    data = b"junk" + warc.gzip_member(RECORDS[0]) + b"more junk" + RECORDS[1] + warc.END + warc.gzip_member(RECORDS[3])[:-4]
    assert bodies(data)[:2] == [b"one", b"two WARC/1.0\r\n inside"]
    g = gaps(data)
    assert g[0] == (0, 4) and g[-1][1] == len(data)
    assert bodies(b"") == [] and gaps(b"abc") == [(0, 3)]


def test_wrong_digest_is_quarantined():
    r = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: 3\r\n\r\n"
    good, bad = r % hashlib.sha256(b"abc").hexdigest().encode() + b"abc", r % hashlib.sha256(b"abd").hexdigest().encode() + b"abc"
    data = bad + warc.END + good + warc.END
    assert bodies(data) == [b"abc"] and gaps(data) == [(0, len(bad) + 4)]


def test_round_trip(spark, tmp_path):
    big = "é" * 60
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nshort"), (None, "u", "x"), (2, None, big), (6, "u", big + "\r\n\r\n" * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS warc_key", "2 AS d", "3 AS value")
    for compress in (True, False):
        path = f"{tmp_path}/{compress}"
        warc.write(pages, path, compress)
        found = warc.scan(spark, path)
        got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"])) for r in found.collect()))
        e = big.encode()
        assert got == [(0, "response", None, 1, b"x"), (1, "response", None, 120, e), (2, "revisit", 1, 120, b""), (2, "revisit", 1, 120, b""), (3, "response", None, 0, b""), (4, "response", None, 0, b""), (5, "response", None, len(b"WARC/1.1\r\n\r\nshort"), b"WARC/1.1\r\n\r\nshort"), (6, "response", None, 132, e + b"\r\n\r\n" * 3)]
    warc.write(pages.limit(0), f"{tmp_path}/none")
    assert warc.scan(spark, f"{tmp_path}/none").count() == 0
