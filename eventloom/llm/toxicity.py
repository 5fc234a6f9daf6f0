"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text: an ordinary one, trained on windows of ordinary
documents, and a toxic one, which is the ordinary one preceded by the spans that mark toxic documents
(chosen greedily: the span with the highest log-likelihood ratio, then the words it explains are taken
out). Since both end alike, an ordinary window compresses to the same length under either, and a toxic
one is shorter under the toxic dictionary. A document's features are the largest gains over its windows;
a logistic curve fitted on training rows that the dictionaries did not see turns them into a score.

The fit uses at most MAX_TOXIC + MAX_ORDINARY labelled training documents of MAX_BYTES together, chosen by
hash; near copies among them count once. The ordinary dictionary is trained on all windows of their whole texts, or on the
MAX_WINDOWS with the smallest hashes if there are more. Scoring covers every window of every whole text.

Defined cases: null and empty texts have one empty window, no gain, and get the score of that; without
labels of both kinds, or without telling spans, every score is the labels' share of toxic rows (0 if
none); ties and repeated rows score alike; null labels are no labels; empty tables give no rows; extra columns pass
through ``score``, which replaces one named toxic_score.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_rows, read

MAX_TOXIC, MAX_ORDINARY = 2000, 4000
#: Bytes of their texts together; texts that would pass it are left out, in the order of their hash.
MAX_BYTES = 64 << 20
#: Windows of ordinary texts on which the ordinary dictionary is trained.
MAX_WINDOWS = 40_000
FOLDS = 5
WINDOW_WORDS = 8
MIN_SPAN, MAX_SPAN = 5, 14
#: Least log-likelihood ratio of a span, and how much likelier toxic text must hold it.
MIN_G, MIN_RATIO = 24.0, 20.0
ORDINARY_BYTES = 4096
#: zstandard starts no match in a window's last bytes.
PAD = b" " * 9


def windows(text: str | None) -> list[bytes]:
    w = (text or "").encode().lower().split()
    return [b" " + b" ".join(w[i : i + WINDOW_WORDS]) + PAD for i in range(0, len(w), WINDOW_WORDS)] or [PAD]


def distinct_texts(texts: list[str]) -> list[str]:
    """texts less those that share one of their four smallest shingle hashes with an earlier one."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        h = sorted({xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:4]
        if w and seen.isdisjoint(h):
            out.append(t)
        seen.update(h)
    return out


def _word_counts(texts: list[str]) -> Counter:
    c: Counter = Counter()
    for t in texts:
        c.update(set(t.encode().lower().split()))
    return c


def _spans(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[a : a + n] for n in range(MIN_SPAN, min(len(w), MAX_SPAN) + 1) for a in range(len(w) - n + 1)}


def telling_spans(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Spans of words that mark toxic texts, the most telling first."""
    one, zero = _word_counts(toxic), _word_counts(ordinary)
    n1, n0 = max(1, len(toxic)), max(1, len(ordinary))
    c1: Counter = Counter()
    holders: dict[bytes, list[bytes]] = defaultdict(list)
    for w, k in one.items():
        for s in _spans(w):
            c1[s] += k
    c1 = Counter({s: k for s, k in c1.items() if k >= 4})
    for w in one:
        for s in _spans(w):
            if s in c1:
                holders[s].append(w)
    c0: Counter = Counter()
    for w, k in zero.items():
        for s in _spans(w):
            if s in c1:
                c0[s] += k

    def g(s: bytes) -> float:
        k, o = c1[s], c0[s]
        if k < 4 or k / n1 < MIN_RATIO * (o + 0.5) / n0:
            return 0.0
        e = (k + o) * n1 / (n1 + n0)
        return 2 * (k * math.log(k / e) + (o * math.log(o / (k + o - e)) if o else 0))

    live = {s: v for s in c1 if (v := g(s)) > MIN_G}
    out: list[bytes] = []
    gone: set[bytes] = set()
    while live:
        best = max(live, key=lambda s: (round(live[s], 6), len(s), s))
        out.append(best)
        for w in holders[best]:
            if w not in gone:
                gone.add(w)
                for s in _spans(w) & live.keys():
                    c1[s] -= one[w]
                    live[s] = g(s)
        live = {s: v for s, v in live.items() if v > MIN_G}
    return out


class Model:
    """Two dictionaries and a logistic curve; small enough to be sent to every task."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: list[float]):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self._own: tuple | None = None

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def _compressors(self):
        if self._own is None:
            how = zstandard.ZstdCompressionParameters(window_log=15, hash_log=14, chain_log=14, search_log=4, min_match=5, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)

            def build(data: bytes):
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                return zstandard.ZstdCompressor(dict_data=d, compression_params=how)

            self._own = build(self.ordinary), build(self.toxic)
        return self._own

    def features(self, text: str | None) -> list[float]:
        a, b = (c.compress for c in self._compressors())
        gains = sorted((len(a(w)) - len(b(w)) for w in windows(text)), reverse=True)
        top = [max(0, x) for x in gains[:3]] + [0, 0]
        return [1.0, min(top[0], 6), min(top[1], 6), min(top[2], 6), float(top[0] >= 2), math.log1p(len(gains))]

    def score(self, text: str | None) -> float:
        if len(self.toxic) <= len(self.ordinary):
            return self.weights[0]
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _ordinary_dictionary(texts: list[str], most: int | None = None) -> bytes:
    every = ((xxhash.xxh3_64_intdigest(w), n, w) for n, w in enumerate(w for t in texts for w in windows(t)))
    chosen = heapq.nsmallest(MAX_WINDOWS if most is None else most, every)
    samples = [w for _, _, w in sorted(chosen, key=lambda x: x[1])]
    try:
        return zstandard.train_dictionary(4 * ORDINARY_BYTES, samples).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:  # too few samples to train on: their own bytes
        return b"".join(samples)[-ORDINARY_BYTES:] or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """rows: (text, toxic) in a fixed order; share: of toxic rows among all labelled training rows."""
    split = [[], []], [[], []]
    for text, y in rows:
        split[zlib.crc32((text or "").encode()) % 3 == 0][y].append(text or "")
    ordinary, toxic = (distinct_texts(t) for t in split[0])
    spans = telling_spans(toxic, ordinary)
    base = _ordinary_dictionary(ordinary)
    if not spans or not split[1][0] or not split[1][1]:
        return Model(base, b"", [share])
    model = Model(base, b"".join(reversed(spans)) + base, [])
    x, y, weight = [], [], []
    for k, texts in enumerate(split[1]):
        texts = distinct_texts(texts)
        x += [model.features(t) for t in texts]
        y += [float(k)] * len(texts)
        weight += [(share if k else 1 - share) * 1000 / max(1, len(texts))] * len(texts)
    model.weights = _logistic(np.array(x), np.array(y), np.array(weight)).tolist()
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows whose crc32(doc_id) mod FOLDS is not 0."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    n = dict(known.groupBy("toxic").count().collect())
    pick = lambda y, most: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = pick(1, MAX_TOXIC).union(pick(0, MAX_ORDINARY))  # bounded by the limits, so it may be broadcast
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))  # a row per chosen document, however many rows share its id
    sizes = labelled.groupBy("doc_id").agg(size.alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total = list(itertools.accumulate(r["size"] for r in sizes))
    kept = [r["doc_id"] for r, t in zip(sizes, total, strict=True) if t <= MAX_BYTES]
    if len(kept) < len(sizes):
        labelled = labelled.where(F.col("doc_id").isin(kept))
    rows = sorted(labelled.select("text", "toxic", "doc_id").collect(), key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))
    return fit([(r["text"], r["toxic"]) for r in rows], n.get(1, 0) / max(1, sum(n.values())))


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score, from the text alone."""
    docs = docs.drop("toxic_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            scores = pa.array([model.score(t) for t in rows["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns, scores], names=[f.name for f in schema])

    return map_rows(docs, run, schema)


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))

