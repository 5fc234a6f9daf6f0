"""Counting by batches: the tokens of a plain version, and the work per distinct word."""

import random
import zlib
from collections import Counter

import pyarrow as pa
import xxhash

from eventloom.llm import lmscore


def counted(rows):
    """What a task gives out for some batches of rows: (count in training, count in all, class) by hash."""
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in b], pa.int64()), pa.array([t for _, t in b], pa.string())], ["doc_id", "text"]) for b in rows]
    out, classes = Counter(), {}
    for b in lmscore._counted(iter(batches)):
        for r in b.to_pylist():
            if r["lag"] == 0:
                out[r["h"]] += r["c"] + 1j * r["c_all"]
                classes[r["h"]] = r["cls"]
    return out, classes


def test_tokens_of_odd_texts(monkeypatch):
    monkeypatch.setattr(lmscore, "CACHE", 500)
    r, letters = random.Random(1), " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0aAbÀé.,;:!?|\x00日😀Zz"
    texts = [None, "", "  ", " \n", ".,", "a.", *("".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(600))]
    rows = [*enumerate(texts), (None, "a B")]
    want, classes = Counter(), {}
    for i, text in rows:
        for w in [*(text or "").encode().lower().split(), None]:
            h = lmscore.END_HASH if w is None else xxhash.xxh3_64_intdigest(w) - (1 << 63) or 1
            want[h] += 1j + (not lmscore.held_out(i))
            classes[h] = 0 if w is None else zlib.crc32(w.rstrip(b".,;:!?|")[-2:]) & 0x7FFFFFFF
    assert counted([rows[:100], [], rows[100:101], rows[101:]]) == (want, classes)


def test_classes_are_told_once_an_ending(monkeypatch):
    calls, real = [], lmscore.word_class
    monkeypatch.setattr(lmscore, "word_class", lambda w: calls.append(w) or real(w))
    out, classes = counted([[(0, " ".join(f"w{i}{e}" for i in range(2000) for e in ("ka", "lo.")))]])
    assert len(out) == 4001 and len(set(classes.values())) == 3  # 4,000 words and the end
    assert len(calls) == 2


def test_scores_of_long_and_empty_texts_beside_each_other(spark):
    texts = ["", None, "x " * 70_000 + "once", " \n ", "x once\tX"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in lmscore.score_texts(docs).collect()}
    train = [i for i in range(5) if not lmscore.held_out(i)]
    c = Counter(w for i in train for w in [*(texts[i] or "").lower().split(), None])
    for i, text in enumerate(texts):
        own = [*(text or "").lower().split(), None]
        assert got[i]["n_tokens"] == len(own) and got[i]["n_known"] == sum(c[w] > 0 for w in own) and got[i]["train_tokens"] == sum(c.values())
