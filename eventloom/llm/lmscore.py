"""Scoring texts with a log-bilinear language model.

Every token of the corpus is counted. The vocabulary is the most frequent words, as many as the square root
of the training tokens, so it and what is gathered grow with the corpus. The model predicts a token from the
CONTEXT tokens before it: with context vectors q and a matrix C_i per position, p = sum of q[w_i] C_i, and a
unit's score is r . p + b. A token is told in two steps, each a softmax of such scores: first its unit (the
end, one of the SINGLES most frequent words, or a class of words by a hash of their last two bytes), then for
a class its member: a word of the vocabulary, or "rare" for all other words of the class. A rare word has its
add-one share within its class, one unseen word included, so the probabilities of all known words and of one
unseen word of each class sum to one, as in the base. Products of whole batches of contexts with the vectors
give these normalised log-probabilities.

The model is trained in numpy by noise-contrastive estimation on all training documents, in two rounds. The
first is on the driver and on COARSE classes alone: their counts at each distance up to CONTEXT, summed over
the corpus, give the vectors from which every word of a class starts. In the second every task trains a copy
on its own documents by Adagrad, with noise units drawn from the unigrams of units and noise members from
those of their class; the copies' rows are then averaged, each row weighted by the tokens that moved it, in
a tree of groups of FAN_IN copies.

Tokens are known by a 64-bit hash. The TOP most frequent ones travel with the tasks; counts of rarer ones are
joined, and as they are rare no join key is hot. Both bounds are turned into a least count by a histogram of
counts, so no task sorts or holds all distinct words.

Defined cases: a null or empty text is its end alone; a null doc_id counts as the empty text for the
split; repeated rows count each; an empty table gives no rows; extra columns are ignored; ties in count are
in the vocabulary together or not at all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batch, map_rows, read, stash

FOLDS, HELD = 7, 2
CONTEXT, DIM, SINGLES, COARSE = 2, 16, 64, 128
#: Noise samples in the first and the second step; tokens of a training step and of a scoring slice.
NOISE, MEMBER_NOISE, STEP, SLICE = 16, 2, 2048, 1024
RATE, FAN_IN, BLOCK = 0.03, 64, 512
#: Steps on the coarse counts, and noise samples drawn for each context class in one of them.
COARSE_STEPS, COARSE_NOISE = 300, 64
#: Tokens whose classes are gathered at a time when scoring.
CHUNK = 1 << 16
TOP = 200_000
#: Distinct words kept by a task before it starts its table anew.
CACHE = 400_000
END_HASH = 0
#: Characters at a word's end that its class leaves out.
STOPS = b".,;:!?|"
PAIRS = (COARSE + 1) ** 2


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def _training(ids: pa.Array) -> np.ndarray:
    return np.array([not held_out(i) for i in ids.to_pylist()], bool)


def word_class(word: bytes) -> int:
    """A 31-bit hash of a word's end; classes are its remainders."""
    return zlib.crc32(word.rstrip(STOPS)[-2:]) & 0x7FFFFFFF


class Codes(dict):
    """Words to small numbers, with each number's hash and class; number 0 is the end."""

    def __init__(self):
        super().__init__()
        self.hashes, self.classes = np.array([END_HASH], np.int64), np.zeros(1, np.int64)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of some distinct words; new ones are taken in, the empty word has -1."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.binary())), b"\n")
        texts = joined[0].as_py().split(b"\n") if len(words) else []  # no word has a line break; faster than to_pylist
        numbers = np.array([*map(self.get, texts, repeat(-1))], np.int64)
        empty = pc.index(words, pa.scalar("", words.type)).as_py()
        new = np.flatnonzero(numbers < 0)
        new = new[new != empty]
        if len(new):
            numbers[new] = len(self.hashes) + np.arange(len(new))
            added = [texts[i] for i in new.tolist()]
            self.update(zip(added, count(len(self.hashes))))
            h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, added)), ">u8").astype(np.uint64)
            h = (h ^ np.uint64(1 << 63)).view(np.int64)
            self.hashes = np.concatenate([self.hashes, np.where(h == END_HASH, 1, h)])
            ends = pc.ascii_rtrim(words.take(pa.array(new)), characters=STOPS.decode()).cast(pa.binary())
            ends = pc.binary_slice(ends, -2).dictionary_encode()  # few: each class is told once
            self.classes = np.concatenate([self.classes, np.array([*map(word_class, ends.dictionary.to_pylist())], np.int64)[ends.indices.to_numpy()]])
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of texts in a row, and how many each text has; Arrow splits them and tells distinct words
        apart, so each of these is looked up once."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # at the characters of bytes.split()
        words = lists.flatten().dictionary_encode()
        length = pc.list_value_length(lists).to_numpy().astype(np.int64) + 1
        flat, word = np.zeros(length.sum(), np.int64), np.ones(length.sum(), bool)
        word[np.cumsum(length) - 1] = False
        flat[word] = self._numbers(words.dictionary)[words.indices.to_numpy()]
        real = flat >= 0  # white space at a text's ends leaves empty words
        return flat[real], np.add.reduceat(real, np.cumsum(length) - length, dtype=np.int64)

    def tokens(self, text: str | None) -> np.ndarray:
        return self.encode(pa.array([text], pa.string()))[0]


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


_COUNT = T.StructType([T.StructField("h", T.LongType()), T.StructField("cls", T.IntegerType()), *_longs("c", "c_all"), T.StructField("lag", T.IntegerType())])
_ROWS = T.StructType([*_longs("copy", "block"), T.StructField("sums", T.BinaryType())])
_SCORED = T.StructType(
    [
        *_longs("row", "doc_id"),
        T.StructField("held_out", T.BooleanType()),
        *_longs("n_tokens", "known"),
        T.StructField("seen", T.DoubleType()),
        T.StructField("model", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
    ]
)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts, and counts of pairs of coarse classes at each distance in training documents."""
    codes, sums = Codes(), np.zeros((2, 1024), np.int64)
    pairs, coarse = np.zeros((CONTEXT, PAIRS), np.int64), np.zeros(1, np.int64)

    def out():
        n = len(codes.hashes)
        some = np.flatnonzero(sums[1, :n])
        for i in range(0, len(some), 20_000):
            j = some[i : i + 20_000]
            own = {"h": codes.hashes[j], "cls": codes.classes[j].astype(np.int32), "c": sums[0, j], "c_all": sums[1, j]}
            yield batch(own | {"lag": np.zeros(len(j), np.int32)}, _COUNT)

    for rows in batches:
        flat, length = codes.encode(rows[1])
        kept, n = _training(rows[0]), len(codes.hashes)
        if n > sums.shape[1]:
            sums = np.concatenate([sums, np.zeros((2, n + sums.shape[1]), np.int64)], axis=1)
        sums[1, :n] += np.bincount(flat, minlength=n)
        if kept.any():
            coarse = np.concatenate([coarse, 1 + codes.classes[len(coarse) :] % COARSE])
            flat = flat[np.repeat(kept, length)]
            contexts = _contexts(flat, length[kept])
            sums[0, :n] += np.bincount(flat, minlength=n)
            for i in range(CONTEXT):
                pairs[i] += np.bincount(coarse[contexts[:, i]] * (COARSE + 1) + coarse[flat], minlength=PAIRS)
        if len(codes.hashes) > CACHE:
            yield from out()
            codes, sums, coarse = Codes(), np.zeros((2, 1024), np.int64), np.zeros(1, np.int64)
    yield from out()
    for i in range(CONTEXT):
        some = np.flatnonzero(pairs[i])
        n = np.zeros(len(some), np.int32)
        yield batch({"h": some, "cls": n, "c": pairs[i, some], "c_all": pairs[i, some], "lag": n + i + 1}, _COUNT)


@dataclass
class Lexicon:
    """Counts of the TOP tokens (sorted by hash), the vocabulary's place in the model, and classes of the rest."""

    hashes: np.ndarray
    counts: np.ndarray
    rank: np.ndarray  # place in the vocabulary from 1; 0: not in it
    word_class: np.ndarray  # class of each word of the vocabulary
    end: int  # count of ends in training documents
    classes: int
    member_class: np.ndarray  # class of each member row; a class's last row is "rare"
    member_row: np.ndarray  # by rank: the member row, -1 for a single
    member_count: np.ndarray
    unit_count: np.ndarray
    rare_room: np.ndarray  # by class: tokens + distinct words + 1 of the rare words
    total: int
    distinct: int

    @property
    def words(self) -> int:
        return len(self.member_row) - 1

    @property
    def singles(self) -> int:
        return min(SINGLES, self.words)

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into the table, and whether the hash is there."""
        i = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        return i, (self.hashes[i] == h) if len(self.hashes) else np.zeros(len(h), bool)

    def tables(self, codes: Codes, first: int = 0) -> dict[str, np.ndarray]:
        """Per code from ``first`` on; code 0 is the end. symbol: as a context; unit; member: its row, -1 for none;
        there: whether its count is known here; count; seen: log10(count + 1), 0 if not known here; share: a rare
        word's share of its class without that of counts that are not known here."""
        h = codes.hashes[first:]
        i, there = self.place(h)
        rank = np.where(there, self.rank[i], 0) if len(self.hashes) else np.zeros(len(h), np.int64)
        count = np.where(there, self.counts[i], 0) if len(self.hashes) else np.zeros(len(h), np.int64)
        cls = codes.classes[first:] % self.classes
        symbol = np.where(rank > 0, rank, 1 + self.words + cls)
        member = np.where(rank > 0, self.member_row[rank], self.rare_rows()[cls])
        unit = np.where((rank > 0) & (member < 0), rank, 1 + self.singles + cls)
        if first == 0:
            symbol[0], unit[0], member[0], there[0], count[0], rank[0] = 0, 0, -1, True, self.end, 1
        seen = np.log10(count + 1.0) * there
        share = np.where(rank > 0, 0.0, seen - np.log10(self.rare_room[cls]))
        return {"symbol": symbol, "unit": unit, "member": member, "there": there, "count": count, "seen": seen, "share": share}

    def rare_rows(self) -> np.ndarray:
        return np.searchsorted(self.member_class, np.arange(self.classes), side="right") - 1


class Tables:
    """A lexicon's tables of a growing set of codes; starts anew when the words kept are too many."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self._anew()

    def _anew(self) -> None:
        self.codes, self.known, self.own = Codes(), 0, None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.known > CACHE:
            self._anew()
        out = self.codes.encode(texts)
        if len(self.codes.hashes) > self.known:
            new = self.lex.tables(self.codes, self.known)
            self.own = new if self.own is None else {k: np.concatenate([v, new[k]]) for k, v in self.own.items()}
            self.known = len(self.codes.hashes)
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        return self.own[name]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, cls, c, c_all, lag): a token's count in training documents and in all; with a lag, of a pair of coarse classes."""
    raw = map_rows(docs.select("doc_id", "text"), _counted, _COUNT)
    summed = raw.groupBy("h", "lag").agg(F.first("cls").alias("cls"), F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))
    return stash(summed.select(*_COUNT.names), "lm-counts")


def coarse_counts(counts: DataFrame) -> np.ndarray:
    """How often a coarse class stands at each distance before another; class 0 is the end."""
    found = counts.where("lag > 0").select("lag", "h", "c").toArrow()  # CONTEXT * PAIRS rows at most
    out = np.zeros((CONTEXT, PAIRS))
    out[found["lag"].to_numpy() - 1, found["h"].to_numpy()] = found["c"].to_numpy()
    return out.reshape(CONTEXT, COARSE + 1, COARSE + 1)


def _bucket(count: F.Column) -> F.Column:
    """64 buckets for each doubling of a count."""
    return F.floor(F.log2(count.cast("double")) * 64)


def _at_least(words: DataFrame, count: str, most: int) -> DataFrame:
    """The words of the highest counts, at most ``most`` of them, by whole buckets of counts."""
    words = words.where(F.col(count) > 0)
    room, low = most, None
    for r in sorted(words.groupBy(_bucket(F.col(count)).alias("b")).count().collect(), reverse=True):  # 64 rows a doubling
        room -= r["count"]
        if room < 0:
            break
        low = r["b"]
    return words.where(F.lit(False) if low is None else _bucket(F.col(count)) >= low)


def lexicon(counts: DataFrame) -> Lexicon:
    counts = counts.where("lag = 0")
    total, distinct = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = int(total or 0), int(distinct or 0)
    end = counts.where(F.col("h") == END_HASH).agg(F.sum("c")).first()[0] or 0
    words = counts.where(F.col("h") != END_HASH)
    vocabulary = _at_least(words, "c", math.isqrt(total)).select("h", "cls", "c").toArrow()
    h, cls, c = (vocabulary[n].to_numpy() for n in ("h", "cls", "c"))
    order = np.lexsort((h, -c))
    h, cls, c = h[order], cls[order].astype(np.int64), c[order]
    classes = max(COARSE, 1 << round(math.log2(max(1, len(h))) / 2))
    cls = cls % classes
    rest_total, rest_distinct = np.zeros(classes), np.zeros(classes)
    grouped = words.groupBy(F.pmod(F.col("cls"), F.lit(classes)).alias("k")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"))
    for r in grouped.collect():  # a row a class
        rest_total[r["k"]], rest_distinct[r["k"]] = r["n"], r["v"]
    np.subtract.at(rest_total, cls, c)
    np.subtract.at(rest_distinct, cls, 1)

    singles = min(SINGLES, len(h))
    inside = np.arange(singles, len(h))  # vocabulary words told by class and member
    owner = np.append(cls[inside], np.arange(classes))
    rank = np.append(inside + 1, np.full(classes, len(h) + 1))  # the rare row comes last
    by = np.lexsort((rank, owner))
    member_row = np.full(len(h) + 1, -1)
    member_row[rank[by][rank[by] <= len(h)]] = np.flatnonzero(rank[by] <= len(h))
    member_count = np.append(c[inside], rest_total)[by] + 0.5
    unit_count = np.concatenate([[end], c[:singles], np.bincount(owner, np.append(c[inside], rest_total), classes)]) + 0.5

    top = _at_least(words, "c_all", TOP).select("h", "c").toArrow()
    some = pd.concat([pd.DataFrame({"h": top["h"].to_numpy(), "c": top["c"].to_numpy()}), pd.DataFrame({"h": h, "c": c})]).drop_duplicates("h").sort_values("h")
    place = np.zeros(len(some), np.int64)
    place[np.searchsorted(some["h"].to_numpy(), h)] = np.arange(1, len(h) + 1)
    return Lexicon(some["h"].to_numpy(np.int64), some["c"].to_numpy(np.int64), place, cls, int(end), classes, owner[by], member_row, member_count, unit_count, rest_total + rest_distinct + 1, total, distinct)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(-x, 80)))


def _order(rows: np.ndarray) -> np.ndarray:
    """A stable order of small numbers; numpy sorts 16-bit ones by radix, several times faster."""
    return np.argsort(rows.astype(np.uint16) if rows.size and rows.max() < 1 << 16 else rows, kind="stable")


def _log_softmax_at(scores: np.ndarray, at: np.ndarray, bound: float) -> np.ndarray:
    """Row by row, the logarithm of one column's share of the exponentials; changes scores.

    Scores whose magnitude is bound to have finite exponentials need no shift by their maximum.
    """
    if not bound < 60:
        scores -= scores.max(axis=1, keepdims=True)
    own = scores[np.arange(len(at)), at].astype(np.float64)
    np.exp(scores, out=scores)
    return own - np.log((scores @ np.ones(scores.shape[1], np.float32)).astype(np.float64))


def coarse_vectors(n: np.ndarray, dim: int = DIM, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, r, c) of the coarse classes: noise-contrastive estimation on their counts n[distance, context, next].

    For each position the pair counts stand for all tokens at once; noise is drawn anew in every step. The
    positions' evidence adds up when the model is used, so each position is trained for its own share of it.
    """
    rng = np.random.default_rng(seed)
    size = n.shape[1]
    q, r = rng.normal(0, 0.3, (size, dim)), rng.normal(0, 0.3, (size, dim))
    c = np.stack([np.eye(dim)] * CONTEXT)
    uni = n[0].sum(axis=0) + 0.5
    uni /= uni.sum()
    data = n / max(1.0, n[0].sum())
    params = [q, r, c]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for t in range(1, COARSE_STEPS + 1):
        grads = [np.zeros_like(x) for x in params]
        drawn = rng.multinomial(COARSE_NOISE, uni, size) / COARSE_NOISE  # for each context class
        for i in range(CONTEXT):
            qc = q @ c[i]
            shift = np.log(NOISE * uni)
            p = _sigmoid(qc @ r.T + np.log(uni) - shift)
            g = data[i] * (1 - p) - NOISE * data[i].sum(axis=1, keepdims=True) * drawn * p
            grads[0] += g @ r @ c[i].T
            grads[1] += g.T @ qc
            grads[2][i] = q.T @ (g @ r)
        for k, (x, d) in enumerate(zip(params, grads, strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            x += 0.03 * (1 - t / (COARSE_STEPS + 1)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-10)
    return q, r, c / CONTEXT


class LogBilinear:
    """q: context vectors; c: a matrix per position; r1, b1: units; r2, b2: members. float32 but for the counts."""

    def __init__(self, lex: Lexicon, start: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.lex = lex
        self.p1 = lex.unit_count / lex.unit_count.sum()
        class_sum = np.bincount(lex.member_class, lex.member_count, lex.classes)
        self.p2 = lex.member_count / class_sum[lex.member_class]
        self.cumulative = np.cumsum(self.p2)  # a class's members end at its number + 1
        q, r, c = (x.astype(np.float32) for x in start)
        own = 1 + np.concatenate([lex.word_class, np.arange(lex.classes)]) % COARSE
        self.q = q[np.append(0, own)]
        self.r1 = r[np.concatenate([[0], 1 + lex.word_class[: lex.singles] % COARSE, 1 + np.arange(lex.classes) % COARSE])]
        self.r2 = np.zeros((len(self.p2), r.shape[1]), np.float32)
        self.c = c.copy()
        self.b1, self.b2 = np.log(self.p1).astype(np.float32), np.log(self.p2).astype(np.float32)

    #: The arrays whose rows are trained and averaged, in a fixed order; a member's bias stays its unigram within the class.
    ROWS = ("q", "r1", "b1", "r2", "c")

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """The vector that each row of contexts (the latest token first) predicts."""
        return sum(self.q.take(contexts[:, i], axis=0) @ self.c[i] for i in range(CONTEXT))

    def log_probs(self, contexts: np.ndarray, unit: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of units and, where there is one, of members within their class."""
        dim = self.c.shape[1]
        found, p = np.empty(len(unit)), np.ones((len(unit), dim + 1), np.float32)  # the last column meets the biases
        first, second = np.column_stack([self.r1, self.b1]), np.column_stack([self.r2, self.b2])
        bounds = [float(np.sqrt((r * r).sum(axis=1).max()) * 1.01) for r in (self.r1, self.r2)]
        widest = [float(np.abs(b).max()) for b in (self.b1, self.b2)]
        longest = 0.0
        for a in range(0, len(unit), SLICE):  # small enough for a core's cache
            z = slice(a, a + SLICE)
            p[z, :dim] = vector = self.predicted(contexts[z])
            own = math.sqrt(float(np.einsum("td,td->t", vector, vector).max()))
            longest = max(longest, own)
            found[z] = _log_softmax_at(p[z] @ first.T, unit[z], own * bounds[0] + widest[0])
        within = np.flatnonzero(member >= 0)
        cls = self.lex.member_class[member[within]]
        order = _order(cls)
        within, cls = within[order], cls[order]
        for run in np.split(np.arange(len(cls)), np.flatnonzero(np.diff(cls)) + 1) if len(cls) else ():
            k = cls[run[0]]
            rows = slice(*np.searchsorted(self.lex.member_class, (k, k + 1)))
            step = max(1, (SLICE << 8) // (rows.stop - rows.start))
            for a in range(0, len(run), step):
                i = within[run[a : a + step]]
                found[i] += _log_softmax_at(p[i] @ second[rows].T, member[i] - rows.start, longest * bounds[1] + widest[1])
        return found


class Trainer:
    """Noise-contrastive estimation by Adagrad; counts how many tokens moved each row."""

    def __init__(self, model: LogBilinear, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.squares = {n: np.full(len(getattr(model, n)), 1e-3, np.float32) for n in model.ROWS}
        self.moved = {n: np.zeros(len(getattr(model, n)), np.float64) for n in model.ROWS}
        self.shift1 = np.log(NOISE * model.p1).astype(np.float32)
        self.shift2 = np.log(MEMBER_NOISE * model.p2).astype(np.float32)
        self.cumulative1, self.class_start = np.cumsum(model.p1), np.arange(model.lex.classes)[:, None]

    def _add(self, name: str, rows: np.ndarray, gradients: np.ndarray) -> None:
        """A step along the gradients, those of one row summed."""
        order = _order(rows)
        rows, gradients = rows[order], gradients.take(order, axis=0)
        starts = np.append(0, np.flatnonzero(np.diff(rows)) + 1)
        own, g = rows[starts], np.add.reduceat(gradients, starts, axis=0)
        flat = g.reshape(len(g), -1)
        mean = np.einsum("rd,rd->r", flat, flat) / flat.shape[1]
        self.squares[name][own] += mean
        step = RATE / np.sqrt(self.squares[name][own])
        getattr(self.m, name)[own] += step.reshape(-1, *[1] * (g.ndim - 1)) * g
        self.moved[name][own] += np.diff(np.append(starts, len(rows)))

    def step(self, contexts: np.ndarray, unit: np.ndarray, member: np.ndarray) -> None:
        m = self.m
        q = [m.q.take(contexts[:, i], axis=0) for i in range(CONTEXT)]
        p = sum(x @ m.c[i] for i, x in enumerate(q))
        noise = np.searchsorted(self.cumulative1, self.rng.random(NOISE)).clip(max=len(m.p1) - 1)
        shift1, shift2 = self.shift1, self.shift2
        r = m.r1.take(unit, axis=0)
        gt = 1 - _sigmoid(np.einsum("td,td->t", p, r) + m.b1[unit] - shift1[unit])
        gn = -_sigmoid(p @ m.r1[noise].T + m.b1[noise] - shift1[noise])
        gp = gt[:, None] * r + gn @ m.r1[noise]
        rows1 = np.concatenate([unit, noise])
        grad1 = np.concatenate([gt[:, None] * p, gn.T @ p])
        bias1 = np.concatenate([gt, gn.sum(axis=0)])

        within = np.flatnonzero(member >= 0)
        rows2 = member[within]
        if len(within):
            cls, pw, r = m.lex.member_class[rows2], p.take(within, axis=0), m.r2.take(rows2, axis=0)
            drawn = np.searchsorted(m.cumulative, self.class_start + self.rng.random((m.lex.classes, MEMBER_NOISE)))
            drawn = drawn.clip(max=len(m.p2) - 1)
            gm = 1 - _sigmoid(np.einsum("td,td->t", pw, r) + m.b2[rows2] - shift2[rows2])
            other = m.r2[drawn].take(cls, axis=0)
            gd = -_sigmoid(np.einsum("td,tkd->tk", pw, other) + (m.b2[drawn] - shift2[drawn])[cls])
            gp[within] += gm[:, None] * r + np.einsum("tk,tkd->td", gd, other)
            order = _order(cls)
            starts = np.append(0, np.flatnonzero(np.diff(cls[order])) + 1)
            mine = cls[order][starts]
            per_class = np.add.reduceat((gd[:, :, None] * pw[:, None, :]).take(order, axis=0), starts, axis=0)
            noisy = drawn[mine].ravel()
            self._add("r2", np.concatenate([rows2, noisy]), np.concatenate([gm[:, None] * pw, per_class.reshape(len(noisy), -1)]))
        self._add("r1", rows1, grad1)
        self._add("b1", rows1, bias1)
        turned = [gp @ m.c[i].T for i in range(CONTEXT)]
        self._add("c", np.arange(CONTEXT), np.stack([q[i].T @ gp for i in range(CONTEXT)]))
        self.moved["c"] += len(unit) - 1
        self._add("q", contexts.T.ravel(), np.concatenate(turned))


def _contexts(flat: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each token of texts in a row the CONTEXT tokens before it (ends before a text's first)."""
    at = np.arange(len(flat))
    begin = np.repeat(np.cumsum(length) - length, length)
    return np.stack([np.where(at - i >= begin, flat[np.maximum(at - i, 0)], 0) for i in range(1, CONTEXT + 1)], axis=1)


def _blocks(trainer: Trainer) -> Iterator[tuple[int, bytes]]:
    """The trained rows weighted by the tokens that moved them, with these weights; a block for each BLOCK rows."""
    at = 0
    for name in trainer.m.ROWS:
        rows, weight = getattr(trainer.m, name), trainer.moved[name]
        for a in range(0, len(rows), BLOCK):
            w = weight[a : a + BLOCK]
            if w.any():
                x = rows[a : a + BLOCK].reshape(len(w), -1).astype(np.float64) * w[:, None]
                yield at, np.column_stack([w, x]).astype(np.float64).tobytes()
            at += 1


def _summed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float64) for x in frame.sort_values(["copy", "sums"])["sums"])
    return pd.DataFrame({"copy": [key[1]], "block": [key[0]], "sums": [total.tobytes()]})


def fit(docs: DataFrame, lex: Lexicon, coarse: np.ndarray) -> LogBilinear:
    """A model trained on every training document of docs, from the coarse counts of all of them."""
    start = coarse_vectors(coarse)
    shared = docs.sparkSession.sparkContext.broadcast((lex, start))  # bounded by TOP and the root of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, start = shared.value
        tables = Tables(lex)
        trainer = Trainer(LogBilinear(lex, start), TaskContext.get().partitionId())
        used = False
        for rows in batches:
            kept = _training(rows[0])
            if not kept.any():
                continue
            used = True
            flat, length = tables.encode(rows[1].filter(pa.array(kept)))
            contexts = _contexts(flat, length)
            for a in range(0, len(flat), STEP):
                z = slice(a, a + STEP)
                trainer.step(tables["symbol"][contexts[z]], tables["unit"][flat[z]], tables["member"][flat[z]])
        if used:
            found = list(_blocks(trainer))
            copy = TaskContext.get().partitionId()
            yield batch({"copy": [copy] * len(found), "block": [b for b, _ in found], "sums": [x for _, x in found]}, _ROWS)

    parts = stash(map_rows(docs.select("doc_id", "text"), run, _ROWS), "lm-copies")
    copies = (parts.agg(F.max("copy")).first()[0] or 0) + 1
    while copies > 1:
        parts = parts.withColumn("copy", F.floor(F.col("copy") / FAN_IN)).groupBy("block", "copy").applyInPandas(_summed, _ROWS)
        copies = -(-copies // FAN_IN)
    sums = {r["block"]: np.frombuffer(r["sums"], np.float64) for r in parts.collect()}  # one model
    model, at = LogBilinear(lex, start), 0
    for name in model.ROWS:
        rows = getattr(model, name)
        for a in range(0, len(rows), BLOCK):
            if at in sums:
                part = rows[a : a + BLOCK]
                x = sums[at].reshape(len(part), -1)
                hit = x[:, 0] > 0
                part[hit] = (x[hit, 1:] / x[hit, :1]).reshape(-1, *part.shape[1:])
            at += 1
    return model


def score_texts(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    counts = count_tokens(docs)
    lex = lexicon(counts)
    model = fit(docs, lex, coarse_counts(counts))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        model = shared.value
        row = TaskContext.get().partitionId() << 33
        tables = Tables(model.lex)
        for rows in batches:
            ids, (flat, length) = rows[0].to_pylist(), tables.encode(rows[1])
            if not ids:
                continue
            contexts = _contexts(flat, length)
            each = tables["share"][flat]
            for a in range(0, len(flat), CHUNK):
                z = slice(a, a + CHUNK)
                each[z] += model.log_probs(tables["symbol"][contexts[z]], tables["unit"][flat[z]], tables["member"][flat[z]]) / math.log(10)
            begin = np.cumsum(length) - length
            scores, seen, known = (np.add.reduceat(x, begin) for x in (each, tables["seen"][flat], (tables["count"][flat] > 0).astype(np.int64)))
            rare = np.flatnonzero(~tables["there"][flat])
            pair = np.repeat(np.arange(len(ids)), length)[rare] * tables.known + flat[rare]
            pair, times = np.unique(pair, return_counts=True)  # by document
            begin = np.searchsorted(pair, np.arange(len(ids) + 1) * tables.known).astype(np.int32)
            lists = [pa.ListArray.from_arrays(begin, x) for x in (tables.codes.hashes[pair % tables.known], times.astype(np.int32))]
            values = (row + np.arange(len(ids)), ids, [held_out(i) for i in ids], length, known, seen, scores)
            row += len(ids)
            schema = to_arrow_schema(_SCORED)
            yield pa.RecordBatch.from_arrays([*map(pa.array, values, schema.types[: len(values)]), *(x.cast(f) for x, f in zip(lists, schema.types[len(values) :], strict=True))], schema=schema)

    scored = stash(map_rows(docs.select("doc_id", "text"), run, _SCORED), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where("lag = 0").select("h", "c"), "h").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_seen"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    out = scored.drop("rare", "times").join(rare, "row", "left")
    seen = F.coalesce("rare_seen", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("seen") + seen - F.col("n_tokens") * math.log10(lex.total + lex.distinct + 1)).alias("base_score"),
        (F.col("model") + seen).alias("score"),
    )


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
