"""The log-bilinear model against a plain version of itself: probabilities, scores, what it learns."""

import copy
import math
import random
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import lmscore

from .test_operators import WORD


def tokens(text):
    return [*WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)})), None]


@pytest.fixture(scope="module")
def corpus(spark):
    """Two invented languages whose words follow their own kind, so that context tells much."""
    r, rows = random.Random(4), []
    for i in range(500):
        ending = ("ka", "lo")[i % 2]
        rows.append((i, " ".join(f"w{min(r.randrange(60), r.randrange(60))}{ending}" for _ in range(60)) + f" only{i}{ending}"))
    rows += [(500, None), (501, ""), (None, "w1ka w2ka"), (3, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS row", "2 AS h").cache()


@pytest.fixture(scope="module")
def fitted(corpus):
    counts = lmscore.count_tokens(corpus)
    lex = lmscore.lexicon(counts)
    return lex, lmscore.fit(corpus, lex, lmscore.coarse_counts(counts))


def plain_log_prob(model, lex, context, unit, member):
    """By loops in double precision: the first step, and for a class its member."""
    p = sum(model.q[w].astype(float) @ model.c[i].astype(float) for i, w in enumerate(context))
    first = [math.exp(float(r.astype(float) @ p) + float(b)) for r, b in zip(model.r1, model.b1, strict=True)]
    out = math.log(first[unit] / sum(first))
    if member >= 0:
        mine = [m for m in range(len(lex.member_class)) if lex.member_class[m] == lex.member_class[member]]
        within = {m: math.exp(float(model.r2[m].astype(float) @ p) + float(model.b2[m])) for m in mine}
        out += math.log(within[member] / sum(within.values()))
    return out


def test_score_equals_a_plain_version(corpus, fitted):
    lex, model = fitted
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    c, place = Counter(), {}
    for i, t in rows:
        if not lmscore.held_out(i):
            c.update(tokens(t))
    codes = lmscore.Codes()
    for _, t in rows:
        codes.tokens(t)
    symbol, unit, member = (lex.tables(codes)[k] for k in ("symbol", "unit", "member"))
    in_vocabulary = {w for w, k in codes.items() if 0 < symbol[k] <= lex.words}
    assert len(in_vocabulary) == lex.words <= math.isqrt(sum(c.values())) and min(c[w] for w in in_vocabulary) >= max(c[w] for w in codes if w not in in_vocabulary)
    known, rare = Counter(), Counter()
    place = {w.decode(): k for w, k in codes.items()}
    cls = {w: lmscore.word_class(w.encode()) % lex.classes for w in place}
    for w in place:
        if w.encode() not in in_vocabulary:
            rare[cls[w]] += c[w]
            known[cls[w]] += c[w] > 0
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in lmscore.score_texts(corpus).collect())
    want = []
    for i, t in rows:
        total, before = 0.0, [0] * lmscore.CONTEXT
        for w in tokens(t):
            k = place[w] if w else 0
            total += plain_log_prob(model, lex, before, unit[k], member[k]) / math.log(10)
            if w and w.encode() not in in_vocabulary:
                total += math.log10((c[w] + 1) / (rare[cls[w]] + known[cls[w]] + 1))
            before = [symbol[k], *before[:-1]]
        want.append((-1 if i is None else i, total))
    for (i, a), (j, b) in zip(got, sorted(want), strict=True):
        assert i == j and a == pytest.approx(b, rel=1e-4, abs=1e-3)


def test_probabilities_sum_to_one(fitted):
    lex, model = fitted
    contexts = np.array([[0, 0, 0], [1, 2, 0], [lex.words + 3, 1, 5]])[:, : lmscore.CONTEXT]
    units = np.arange(len(model.p1))
    for context in contexts:
        first = np.exp(model.log_probs(np.tile(context, (len(units), 1)), units, np.full(len(units), -1)))
        assert first.sum() == pytest.approx(1, abs=1e-5)
        rows = np.arange(len(lex.member_class))
        every = np.exp(model.log_probs(np.tile(context, (len(rows), 1)), 1 + lex.singles + lex.member_class, rows))
        assert every.sum() + first[: 1 + lex.singles].sum() == pytest.approx(1, abs=1e-5)


def test_context_is_learnt(corpus, fitted):
    out = lmscore.score_texts(corpus).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"] + 0.2 * out["sum(n_tokens)"]
    lex, model = fitted
    assert not np.allclose(model.c[1], 0) and model.c.shape[0] == lmscore.CONTEXT


def test_noise_is_drawn(fitted, monkeypatch):
    lex, model = fitted
    drawn = []
    trainer = lmscore.Trainer(copy.deepcopy(model), 0)
    real = trainer.rng
    monkeypatch.setattr(trainer, "rng", type("R", (), {"random": lambda self, n: drawn.append(n) or real.random(n)})())
    trainer.step(np.zeros((5, lmscore.CONTEXT), int), np.array([0, 1, 1, 2, 1 + lex.singles]), np.array([-1, -1, -1, -1, 0]))
    assert drawn == [lmscore.NOISE, (lex.classes, lmscore.MEMBER_NOISE)]


def test_copies_are_averaged_in_a_tree(corpus, fitted, monkeypatch):
    lex, model = fitted
    counts = lmscore.count_tokens(corpus)
    monkeypatch.setattr(lmscore, "FAN_IN", 2)
    again = lmscore.fit(corpus, lex, lmscore.coarse_counts(counts))
    for name in model.ROWS:
        assert np.allclose(getattr(model, name), getattr(again, name), atol=1e-5)
