"""The whole job: verdicts that decide, rows without an id, words of any rank."""

from eventloom.llm import linededup, quality, toxicity

from .conftest import make_docs, words
from .test_operators import plain_dedup


def test_host_far_above_the_others_is_blocked_below_half(spark):
    """19 hosts with 2 of 40 texts full of symbols, one with 14: far from half, yet far from the others."""
    rows = []
    for h in range(20):
        for i in range(40):
            dirty = i < (14 if h == 7 else 2)
            rows.append((len(rows), " ".join(w + "#" * dirty for w in words(len(rows), 40)), f"h{h}", dirty))
    out = quality.judge_hosts(spark.createDataFrame(rows, "doc_id long, text string, source string, dirty boolean")).collect()
    assert not any(r["base_failed"] for r in out) and max(r["symbols_rate"] for r in out) < 0.5
    dirty = {i for i, _, _, d in rows if d}
    gone = {r["doc_id"] for r in out if not r["kept"]}
    assert gone == {i for i, _, h, _ in rows if h == "h7"} & dirty and len(gone) == 14


def test_hosts_that_differ_by_chance_alone_are_not_blocked(spark):
    rows = []
    for h in range(20):
        for i in range(40):
            rows.append((len(rows), " ".join(w + "#" * (i < 3 + h % 2) for w in words(len(rows), 40)), f"h{h}"))
    assert all(r["kept"] for r in quality.judge_hosts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_rows_without_an_id_or_of_one_id_lose_their_own_lines_only(spark):
    held = "a line that document one holds"
    texts = [held, f"{held}\nfirst line of one row", f"first line of another row\n{held}", "no line of this row is held", f"an early text of seven\n{held}", f"{held}\na later text of seven", f"{held}\nfirst line of one row"]
    ids = [1, None, None, None, 7, 7, None]
    for n in (1, 4):
        out = linededup.dedup_lines(make_docs(spark, texts, ids), n_batches=n, fan_in=2).collect()
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["line_n"], r["line_dropped"], r["text"]) for r in out)
        assert got == plain_dedup(list(zip(ids, texts, strict=True)))


def test_dictionary_learns_from_whole_texts_of_all_documents(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", lambda size, samples: seen.append(samples) or toxicity.zstandard.ZstdCompressionDict(b"x" * 9))
    texts = [" ".join(words(n, 4000)) for n in range(100)]  # 500 windows each
    own = [set(toxicity.windows(t)) for t in texts]
    toxicity._ordinary_dictionary(texts[:3])
    assert set(seen[0]) == own[0] | own[1] | own[2]
    toxicity._ordinary_dictionary(texts)
    share = [len(o & set(seen[1])) / len(o) for o in own]
    assert len(seen[1]) == 40_000 and min(share) > 0.6 and max(share) < 0.95


def test_hosts_beyond_the_broadcast_bound(docs, monkeypatch):
    key = lambda df: sorted(map(str, df.drop("host").collect()))
    want = key(quality.judge_hosts(docs))
    monkeypatch.setattr(quality, "MAX_HOSTS", 0)
    assert key(quality.judge_hosts(docs)) == want


def test_host_rules_on_repeated_rows_and_a_null_host(spark):
    long = " ".join(words(5, 50_000))
    rows = [(1, long, None, 1, 2), (1, long, None, 1, 2), (2, None, None, 1, 2), (3, "", "h", 1, 2), (None, "few words", "h", 1, 2)]
    out = quality.judge_hosts(spark.createDataFrame(rows, "doc_id long, text string, source string, docs long, n_words long")).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["docs"], r["kept"]) for r in out)
    assert got == [(0, 2, 2, False), (1, 50_000, 3, True), (1, 50_000, 3, True), (2, 0, 3, False), (3, 0, 2, False)]
