"""Each operator against a plain version of itself, on texts with the awkward cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventloom.llm import linededup, lmscore, media, mixing, neardup, packing, quality

from .conftest import make_docs, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality


def plain_stats(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {i + j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(lines), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x0b\xa0", max_size=120))
def test_text_stats(text):
    assert quality.text_stats(text) == plain_stats(text)


def test_host_rules(docs, empty):
    out = {r["doc_id"]: r for r in quality.judge_hosts(docs).collect()}
    assert not out[24]["kept"] and out[24]["n_words"] == 0 and out[0]["kept"]
    assert quality.judge_hosts(docs).count() == docs.count() and quality.judge_hosts(empty).count() == 0


def test_bad_host_is_blocked_but_its_clean_documents_stay(spark):
    good = [" ".join(words(i, 40)) for i in range(120)]
    bad = [" ".join(w + "#" for w in words(900 + i, 40)) for i in range(40)]
    rows = [(i, t, "good") for i, t in enumerate(good)] + [(1000 + i, t, "bad") for i, t in enumerate(bad)] + [(2000, good[0], "bad"), (2001, bad[0], "good")]
    out = {r["doc_id"]: r["kept"] for r in quality.judge_hosts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not out[1000] and out[2000] and out[2001] and out[5]


# Line dedup


def plain_dedup(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    own = defaultdict(set)
    last = 1 << 62
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                own[key(x)].add(last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(own[key(x)]) < 2 or min(own[key(x)]) == (last if i is None else i)]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_line_dedup(docs, empty, batches):
    out = linededup.dedup_lines(docs, n_batches=batches, fan_in=2)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["line_n"], r["line_dropped"], r["text"] or "") for r in out.collect())
    assert got == plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert out.columns == [c for c in docs.columns if c != "_gone"] + ["line_n", "line_dropped"]
    assert linededup.dedup_lines(empty).count() == 0


def test_runs_compact_by_level(spark, tmp_path):
    store = linededup.LineRuns(spark, f"file://{tmp_path}/runs", fan_in=2)
    for b in range(4):
        lines = spark.createDataFrame([(b, 0, 7, 7), (b, 1, b, b)], linededup._KEYS)
        dropped = [tuple(r) for r in store.add(lines).collect()]
        assert dropped == ([] if b == 0 else [(b, 0)])
    assert [len(x) for x in store.levels] == [0, 0, 1]


# Near-dedup


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_dedup_awkward_cases(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = neardup.cluster(docs).collect()
    want = plain_components([(i, t) for i, t in rows if i is not None])
    assert len(got) == len(rows)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert neardup.cluster(empty).count() == 0
    assert neardup.keep_one(docs).columns == docs.columns


def test_near_dedup_groups_chains_and_a_common_passage(spark):
    r = random.Random(5)
    passage = words(77, 40)
    rows = []
    for i in range(80):  # documents that share a passage and no more
        rows.append(words(200 + i, r.randint(20, 60)) + passage)
    base = words(1, 150)
    for i in range(80):  # near copies of one text, most of them not similar to each other
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append(w)
    chain = words(3, 60)
    for i in range(25):  # each similar to the next only
        rows.append(chain)
        chain = chain[3:] + words(4000 + i, 3)
    rows += [passage, passage + ["tail"], words(9, 3), words(9, 3), words(8, 7)]
    order = r.sample(range(len(rows)), len(rows))
    pairs = [(n * 10, " ".join(rows[i])) for n, i in enumerate(order)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.cluster(make_docs(spark, [t for _, t in pairs], [i for i, _ in pairs])).collect()}
    assert got == plain_components(pairs)


# Mixing


def test_mixing(spark, docs, empty):
    big = spark.range(6000).selectExpr("id AS doc_id", "concat('w', id, ' b c d') AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('s', id % 4) END AS source", "'x' AS rate", "1 AS copies")
    plan = mixing.mix_plan(big).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in plan:
        size[r["mix_source"]] += r["mix_size"]
        taken[r["mix_source"]] += r["mix_size"] * r["copies"]
        target[r["mix_source"]] = r["target"]
        assert r["copies"] <= 2
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, 1.5 * sum(size.values())
    while True:  # the rule as stated: cap and reshare until none is above
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 2 * size[s]
        left = 1.5 * sum(size.values()) - sum(fixed.values())
    want = fixed | share
    assert all(target[s] == pytest.approx(want[s]) for s in names)
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in names)
    mixed = mixing.mix(big)
    assert mixed.columns == big.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_mixing_beyond_the_broadcast_bound(docs, monkeypatch):
    key = lambda df: sorted(map(str, df.collect()))
    want = key(mixing.mix_plan(docs).drop("mix_source", "mix_draw"))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 0)
    assert key(mixing.mix_plan(docs).drop("mix_source", "mix_draw")) == want


# Packing


def test_encoder_gives_the_tokenizers_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.encoder()
    special = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>  \n", "<|endof", "x<|endoftext|>y  <|endoftext|"]
    for text in [*texts[:6], *special, "", "it's  <|endoftext|> \n\n  x'LL é漢字　🙂 1234 ", "\r\n\t  a\xa0b", "'s 're\x00"]:
        assert own(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert own("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def check_packing(rows, texts_by_id, length):
    fill = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for parts in fill.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= length
    own = packing.encoder()
    for i, text in texts_by_id.items():
        ids = np.append(own(text or ""), 0).astype("<u4")
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == length
            at += r["length"]
        assert at == len(ids)
    return len(fill)


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(spark, texts, empty, length):
    out = packing.pack(make_docs(spark, texts), length=length, group=16).collect()
    check_packing(out, dict(enumerate(texts)), length)
    assert packing.pack(empty).count() == 0


def test_repeated_rows_are_packed_each(docs):
    assert packing.pack(docs).where("doc_id = 3").count() == 2


def decreasing(sizes, capacity):
    return len(packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), capacity))


def fewest_bins(sizes, capacity):
    """The optimum, by trying every bin for every piece in turn."""
    best = len(sizes)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= capacity and bins[k] not in bins[:k]:
                place(rest[1:], (*bins[:k], bins[k] + rest[0], *bins[k + 1 :]))
        place(rest[1:], (*bins, rest[0]))

    place(sorted(sizes, reverse=True), ())
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60))
def test_local_search_keeps_everything_and_fits(sizes):
    found = packing.pack_lengths(sizes, 100)
    assert sorted(i for b in found.bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= 100 for b in found.bins)
    assert len(found.bins) <= min(found.began, decreasing(sizes, 100))


def test_search_against_the_optimum():
    r, above = random.Random(2), 0
    for _ in range(150):
        sizes = [r.randint(8, 70) for _ in range(r.randint(6, 12))]
        n, best = len(packing.pack_lengths(sizes, 100).bins), fewest_bins(sizes, 100)
        assert best <= n <= decreasing(sizes, 100)
        above += n > best
    assert above <= 3


def test_search_finds_what_decreasing_order_does_not():
    sizes = [44, 27, 27, 44, 27, 27, 56, 23, 23, 56, 20, 22] * 3  # decreasing order leaves gaps that an exchange fills
    r, better, steps = random.Random(3), 0, 0
    for _ in range(20):
        mixed = [max(1, s + r.randint(-3, 3)) for s in sizes]
        found = packing.pack_lengths(mixed, 100)
        better += len(found.bins) < decreasing(mixed, 100)
        steps += found.steps
    assert better and steps > 100


def test_every_step_raises_squared_fill():
    r = random.Random(1)
    for _ in range(100):
        sizes = [r.randint(5, 60) for _ in range(14)]
        search = packing.Search(sizes, packing.best_fit(sizes, range(14), 100), 100)
        for donor in range(len(search.bins)):
            before = int((search.fill**2).sum())
            if search.bins[donor] and search.step(donor):
                assert int((search.fill**2).sum()) > before and search.fill.max() <= 100
                assert [sum(sizes[i] for i in b) for b in search.bins] == search.fill.tolist()


def test_search_runs_on_the_documents(spark, sf):
    rows = packing.op9_best_fit_packing(spark, sf).collect()
    short = [r for r in rows if r["length"] < packing.LENGTH]
    used = len({r["sequence_id"] for r in short})
    assert {r["group_steps"] > 0 for r in short} == {True}
    assert used < short[0]["group_bins_began"] and used <= decreasing([r["length"] for r in short], packing.LENGTH)


# Media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=70_000))
def test_container_round_trip(raw):
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    data = media.write_container(payload)
    (track,) = media.describe(data)
    assert media.stored_bytes(data, track) == payload
    assert (track.codec, track.handler, len(track.sizes)) == ("raw ", "soun", len(payload) // 64)
    assert track.duration == pytest.approx(len(payload) / 8000)
    assert [data[a:b] for a, b in track.keyframes] == [payload[i : i + 64] for i in range(0, len(payload), 64 * 32)]


def test_damaged_containers_are_reported(spark):
    data = media.write_container(bytes(range(256)) * 8)
    r = random.Random(3)
    bad = [b"", data[:100], data[:-10], b"\x00\x00\x00\x05moov", *(data[:i] + bytes([r.randrange(256)]) + data[i + 1 :] for i in r.sample(range(700), 200))]
    rows = [(str(i), x) for i, x in enumerate([data, *bad, None])]
    out = media.media_columns(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r["path"] for r in out} >= {"0"} and next(r for r in out if r["path"] == "0")["problem"] is None
    assert any(r["problem"] for r in out)


def test_store_texts(docs, empty):
    for r in media.store_texts(docs).collect():
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= max(64, r["n_bytes"])
    got = {r["doc_id"]: r["payload_sha256"] for r in media.store_texts(docs).collect()}
    assert got[24] == got[25] == hashlib.sha256(bytes(64)).hexdigest()
    assert media.store_texts(empty).count() == 0


# Language model


def test_log_bilinear(docs, empty):
    out = lmscore.score_texts(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tok = lambda t: [*WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)})), None]
    c = Counter()
    for i, t in rows:
        if not lmscore.held_out(i):
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, len(tok(t)), sum(c[w] > 0 for w in tok(t)), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n}
    assert lmscore.score_texts(empty).count() == 0
