"""Best-fit packing with a swap-based local search.

Documents become pieces of at most ``length`` tokens. Full pieces are sequences by themselves. The others
are dealt by a hash of their place into groups of about GROUP pieces. Each group starts from an online
best-fit packing in its arrival order and is improved by local search: pieces of the emptiest bin move to
other underfull bins, or one of them is exchanged for one or two smaller pieces of another bin. Every step
raises the sum of squared fills, so the search ends; a bin whose pieces have all left is gone. The search
ends at the group's lower bound, or when a pass over all underfull bins finds no step. A group that ends
above its bound is searched once more from best-fit decreasing and the fewer bins count, so no group has
more bins than best-fit decreasing gives. As a group has thousands of pieces, the partly filled bin that
each group ends with costs little.

Defined cases: a null text is empty and gives the end id alone; repeated rows are packed each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batch, map_rows, read, stash

LENGTH = 2048
GROUP = 2048
_encoders: dict[str, object] = {}
_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
_PACKED = T.StructType(
    [*_PIECES.fields, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "group_bins_began", "group_steps"))]
)


def encoder(name: str = "byte_bpe_50k.json"):
    """text -> numpy uint32 ids, those of ``tokenizers`` for the named file with add_special_tokens=False.

    The file's added tokens are matched first, as that library does; the text between them is encoded by the
    vocabulary's rank file, which gives the same ids several times faster than the JSON file's own library
    (a test holds the two against each other at their defaults). One encoder is kept per worker.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    own = _encoders[name]
    return lambda text: own.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def _cut(length: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for rows in batches:
            out: dict[str, list] = {n: [] for n in _PIECES.names}
            for doc_id, text in zip(rows[0].to_pylist(), rows[1].to_pylist(), strict=True):
                ids = np.append(encode(text or ""), 0).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    n = length if at or len(ids) % length == 0 else len(ids) % length
                    for name, v in zip(_PIECES.names, (doc_id, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())), strict=True):
                        out[name].append(v)
                    at, piece = at + n, piece + 1
            yield batch(out, _PIECES)

    return run


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); a document over ``length`` starts with its shorter piece."""
    return map_rows(docs.select("doc_id", "text"), _cut(length, tokenizer), _PIECES)


@dataclass
class Packed:
    """Bins as lists of indexes into the sizes; how many bins the search began with and the steps it took."""

    bins: list[list[int]]
    began: int
    steps: int


def best_fit(sizes: Sequence[int], order: Sequence[int], capacity: int) -> list[list[int]]:
    """Each piece in order goes to the fullest open bin that has room for it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by their free room
    mask = 0  # which rooms have bins
    for i in order:
        n = sizes[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        room[r - n].append(b)
        mask |= 1 << (r - n)
    return bins


class Search:
    """Local search over bins: moves and one-for-one or two-for-one exchanges that raise the squared fill.

    Pieces are kept in one array sorted by bin and size (bin * scale + size), so that the best step of a piece
    is found among all bins by a few array operations. A step changes three places of it at most; a bin that
    is full leaves the array for good, as no step can touch it.
    """

    def __init__(self, sizes: Sequence[int], bins: list[list[int]], capacity: int):
        self.sizes = np.asarray(sizes, np.int64)
        self.capacity, self.scale = capacity, capacity + 1
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(self.sizes[b].sum()) for b in bins], np.int64)
        self.live, self.steps = len(bins), 0
        self.least = -(-int(self.sizes.sum()) // capacity)
        self.bin_of = np.empty(len(self.sizes), np.int64)
        for n, b in enumerate(bins):
            self.bin_of[b] = n
        self.piece = np.arange(len(self.sizes))
        self._sort()

    def _sort(self) -> None:
        self.piece = self.piece[self.fill[self.bin_of[self.piece]] < self.capacity]
        key = self.bin_of[self.piece] * self.scale + self.sizes[self.piece]
        order = key.argsort(kind="stable")  # nearly sorted but at the start
        self.piece, self.key = self.piece[order], key[order]
        self.owner, self.size = self.bin_of[self.piece], self.sizes[self.piece]
        self.filled = self.fill[self.owner]
        self.room = self.capacity - self.filled
        self.floor = self.owner * self.scale - self.room - self.size
        self.next = np.arange(1, len(self.key) + 1)

    def _move(self, donor: int, n: int) -> int | None:
        """The fullest other bin with room for n, if the move raises the squared fill."""
        fits = (self.fill + n <= self.capacity) & (self.fill + n > self.fill[donor]) & (self.fill > 0)
        fits[donor] = False
        to = int(np.where(fits, self.fill, 0).argmax())
        return to if fits[to] else None

    def _exchange(self, donor: int, n: int) -> tuple[int, int, list[int]] | None:
        """(gain, bin, pieces that come back) of the best exchange of a piece of size n."""
        least = np.maximum(self.fill[donor] - self.filled, 0)  # a gain above it raises the squared fill
        allowed = np.where(self.owner == donor, -1, self.room)
        gain = n - self.size
        k = int(np.where((gain > least) & (gain <= allowed), gain, 0).argmax())
        best, what = 0, None
        if least[k] < gain[k] <= allowed[k]:
            best, what = int(gain[k]), (int(gain[k]), int(self.owner[k]), [int(self.piece[k])])
        # two pieces of one bin: for each first piece the smallest second one that leaves the bin within its room
        second = np.searchsorted(self.key, np.maximum(self.floor + n, self.owner * self.scale))
        second = np.maximum(second, self.next)  # each pair from its smaller piece
        there = np.minimum(second, len(self.key) - 1)
        gain = gain - self.size[there]
        ok = (gain > np.maximum(least, best)) & (gain <= allowed) & (self.owner[there] == self.owner) & (second == there)
        k = int(np.where(ok, gain, 0).argmax())
        if ok[k]:
            what = int(gain[k]), int(self.owner[k]), [int(self.piece[k]), int(self.piece[there[k]])]
        return what

    def step(self, donor: int) -> bool:
        """One step that takes from donor, a move or else an exchange of its largest piece that has one; False if there is none."""
        mine = sorted(self.bins[donor], key=lambda i: -self.sizes[i])
        others = np.where(self.fill > 0, self.fill, self.capacity)
        others[donor] = self.capacity
        roomiest = self.capacity - int(others.min())
        for x in mine:
            if self.sizes[x] <= roomiest and (to := self._move(donor, int(self.sizes[x]))) is not None:
                return self._do(donor, x, to, [])
        for n, x in {int(self.sizes[i]): i for i in mine}.items():
            if len(self.key) > 1 and (found := self._exchange(donor, n)):
                return self._do(donor, x, found[1], found[2])
        return False

    def _do(self, donor: int, x: int, to: int, back: list[int]) -> bool:
        self.bins[donor].remove(x)
        for i in back:
            self.bins[to].remove(i)
        self.bins[donor] += back
        self.bins[to].append(x)
        self.bin_of[back], self.bin_of[x] = donor, to
        gain = int(self.sizes[x] - self.sizes[back].sum()) if back else int(self.sizes[x])
        self.fill[donor] -= gain
        self.fill[to] += gain
        self.live -= not self.bins[donor]
        self.steps += 1
        self._sort()
        return True

    def run(self) -> "Search":
        """Until the lower bound is met, or a pass over every underfull bin changes nothing."""
        changed = True
        while changed and self.live > self.least:
            changed = False
            under = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            for donor in under[np.argsort(self.fill[under], kind="stable")].tolist():
                while self.live > self.least and self.bins[donor] and self.step(donor):
                    changed = True
                if self.live <= self.least:
                    break
        return self


def pack_lengths(sizes: Sequence[int], capacity: int) -> Packed:
    """Bins of sizes given in arrival order: best fit, then the local search."""
    began = best_fit(sizes, range(len(sizes)), capacity)
    found = Search(sizes, began, capacity).run()
    steps, bins = found.steps, [b for b in found.bins if b]
    if len(bins) > found.least:
        again = Search(sizes, best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), capacity), capacity).run()
        steps += again.steps
        other = [b for b in again.bins if b]
        bins = other if len(other) < len(bins) else bins
    return Packed(bins, len(began), steps)


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = "byte_bpe_50k.json", group: int = GROUP) -> DataFrame:
    """Every piece with its sequence_id and offset; group_bins_began and group_steps tell of its group's search."""
    cut = stash(pieces(docs, length, tokenizer), "pack-pieces")
    short = cut.where(F.col("length") < length)
    groups = max(1, round(short.count() / group))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ids_crc32", "doc_id", "piece", "length"], ignore_index=True)  # a fixed arrival order
        sizes = frame["length"].tolist()
        packed = pack_lengths(sizes, length)
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for n, members in enumerate(packed.bins):
            at = 0
            for i in members:
                seq[i], off[i] = (int(key[0]) + 1 << 32) + n, at
                at += sizes[i]
        return frame.assign(sequence_id=seq, offset=off, group_bins_began=packed.began, group_steps=packed.steps)[_PACKED.names]

    dealt = short.withColumn("group_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # by row, so that copies spread
    packed = dealt.groupBy("group_").applyInPandas(one, _PACKED)
    none = F.lit(0).cast("long")
    full = cut.where(F.col("length") == length).withColumn("sequence_id", -F.monotonically_increasing_id() - 1)
    full = full.withColumn("offset", none).withColumn("group_bins_began", none).withColumn("group_steps", none)
    return full.unionByName(packed)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
