"""MinHash near-dedup with bottom-k sketches.

One hash function over 5-word shingles; a document's sketch is the K smallest hashes of its set.
Documents with equal sets form a class first, so copies cost nothing more. Two sets of Jaccard
similarity >= 0.75 share, among the k smallest hashes of their union, a Binomial(k, 0.75) number of
values: for k = 48 fewer than 20 with probability 2.1e-7, and for
k = 256 fewer than 154 with probability 6.2e-8. The
first is used for candidates: of a document's 48 smallest values only the 29 rarest go to the inverted
lists, because the rarest of 20 shared values is among them on both sides. So a passage that many
documents share makes long lists only for documents that consist of it. The second is the union-sketch
estimate that filters pairs; if both sets fit their sketches it is exact.

Lists are worked off without expanding them into pairs. First each list is compared with two of its
members (stars: the smallest id, and the member whose values are the most common, which is the text that
others were copied from if that is there); links are confirmed on full shingle sets and contracted to
components. Lists whose other members still lie in several components are compared block by block in
numpy: first each member names its best partner outside its component, and after those links are
confirmed and contracted, all pairs between components that pass the estimate are given out. So no link
is lost but for the probabilities above, and a group of m near copies makes no m * m rows.

Defined cases: null text or text without words has an empty set, is linked with nothing and is its own
component; fewer than five words make one shingle; rows that share a doc_id are one document; a null
doc_id joins the component of its copies but never names it; empty tables and extra columns are fine.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BROADCAST_ROWS, batch, map_rows, read, stash
from ._graph import components

WORDS = 5
PERCENT = 75
K, NEED = 256, 154
K_LIST, NEED_LIST = 48, 20
#: Members of a list compared with each other in one go.
BLOCK = 2048
#: Rows of blocks handled by one call.
BUCKET = 4096

_SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
_SET = T.StructType([T.StructField("doc", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes (as signed integers) of the 5-word shingles of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - size + 1 + j]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return np.unique(h.view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out: dict[str, list] = {n: [] for n in _SKETCH.names}
        for doc_id, text in zip(rows[0].to_pylist(), rows[1].to_pylist(), strict=True):
            s = shingle_set(text)
            out["doc_id"].append(doc_id)
            out["n"].append(len(s))
            out["set_id"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["sketch"].append(s[:K_LIST])
        yield batch(out, _SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield batch({"doc": rows[0].to_pylist(), "shingles": [shingle_set(t) for t in rows[1].to_pylist()]}, _SET)


def _need(n, k: int, need: int) -> F.Column:
    """Values a set of n shingles must share with a similar one, among its k smallest."""
    return F.when(n <= k, F.least(F.lit(need), F.ceil(n * PERCENT / 100))).otherwise(F.lit(need)).cast("int")


def _wide(sets: DataFrame) -> DataFrame:
    return sets.select("doc", F.size("shingles").cast("long").alias("n"), F.slice("shingles", 1, K).alias("sketch"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that pass the sketch estimate and then the exact test."""
    narrow = _wide(sets)
    p = pairs.join(narrow.toDF("a", "na", "ka"), "a").join(narrow.toDF("b", "nb", "kb"), "b")
    union = F.slice(F.sort_array(F.array_union("ka", "kb")), 1, K)
    p = p.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    p = p.withColumn("u", union).withColumn("s", F.size(F.array_intersect("u", F.array_intersect("ka", "kb"))))
    p = p.where(F.when(F.size("u") < K, F.col("s") * 100 >= F.size("u") * PERCENT).otherwise(F.col("s") >= NEED))
    p = stash(p.select("a", "b", "na", "nb"), "near-estimated")
    p = p.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return p.where(both * 100 >= (F.col("na") + F.col("nb") - both) * PERCENT).select("a", "b")


def _overlap(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values lists a and lists b share, as a matrix."""
    flat = np.concatenate(lists)
    values, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(seen > 1) - 1  # a value of one list alone is shared by no pair
    row, keep = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), seen[code] > 1
    hit = np.zeros((len(lists), int((seen > 1).sum())), np.float32)
    hit[row[keep], column[code[keep]]] = 1
    return hit[a] @ hit[b].T


def _block(value: int, n, comp, doc, side, sketch: list[np.ndarray], keys: list[np.ndarray], best: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block that cross components and pass the estimate: all, or each member's best."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(b):  # a block against itself
        b = a
    ok = comp[a][:, None] != comp[b][None, :]
    ok &= np.minimum.outer(n[a], n[b]) * 100 >= np.maximum.outer(n[a], n[b]) * PERCENT
    if not ok.any():
        return doc[:0], doc[:0]
    share = _overlap(sketch, a, b)
    need = np.minimum(NEED, -(-n * PERCENT // 100))
    exact = share * 100 >= (np.add.outer(n[a], n[b]) - share) * PERCENT
    ok &= np.where((n[a] <= K)[:, None] & (n[b] <= K)[None, :], exact, share >= np.maximum.outer(need[a], need[b]))
    if not ok.any():
        return doc[:0], doc[:0]
    if best:
        share = np.where(ok, share / np.add.outer(n[a], n[b]), -1)
        x, y = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        x, y = np.append(x, share[:, y].argmax(axis=0)), np.append(share[x].argmax(axis=1), y)
    else:
        ok &= _overlap([k[k < value] for k in keys], a, b) == 0  # the pair's first list alone gives it out
        x, y = np.nonzero(ok)
    return doc[a[x]], doc[b[y]]


def _blocks(best: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["value", "x", "y"], ignore_index=True)
        sketch, keys = ([np.asarray(s) for s in frame[c]] for c in ("sketch", "keys"))
        value, x, y, n, comp, side, doc = (frame[c].to_numpy() for c in ("value", "x", "y", "n", "comp", "side", "doc"))
        cut = np.flatnonzero((value[1:] != value[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        left, right = [doc[:0]], [doc[:0]]
        for i, j in zip(np.append(0, cut).tolist(), np.append(cut, len(doc)).tolist(), strict=True):
            if j - i > 1:
                p, q = _block(value[i], n[i:j], comp[i:j], doc[i:j], side[i:j], sketch[i:j], keys[i:j], best)
                left.append(p)
                right.append(q)
        p, q = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)}).drop_duplicates()

    return run


def _largest_lists(open_lists: DataFrame) -> DataFrame:
    """The lists that are the largest of one of their members: enough to name a best partner."""
    size = stash(open_lists.groupBy("value").agg(F.count("*").alias("m")), "near-list-size")
    named = open_lists.join(size, "value").groupBy("doc").agg(F.max_by("value", F.struct("m", "value")).alias("value"))
    return stash(open_lists.join(stash(named.select("value").distinct(), "near-largest"), "value", "left_semi"), "near-largest-lists")


def _list_blocks(open_lists: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of the members of lists (value, doc, comp), compared in blocks of about BLOCK members."""
    size = stash(open_lists.groupBy("value").agg(F.count("*").alias("m")), "near-list-size")
    keys = open_lists.groupBy("doc").agg(F.collect_list("value").alias("keys"))
    members = stash(_wide(sets).join(keys, "doc"), "near-members")
    p = open_lists.join(size, "value").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    p = p.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p = stash(p.select("value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc", "comp"), "near-blocks")
    buckets = max(1, p.count() // BUCKET)
    p = p.withColumn("bucket", F.pmod(F.xxhash64("value", "x", "y"), F.lit(buckets)))
    return p.join(members, "doc").groupBy("bucket").applyInPandas(_blocks(best), _PAIR).distinct()


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs; component_id null only for null ids without copies."""
    spark = docs.sparkSession
    text = docs.select("doc_id", "text")
    all_rows = stash(map_rows(text, _sketches, _SKETCH), "near-sketches")
    classes = stash(all_rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc")), "near-classes")
    one = all_rows.where("n > 0").join(classes, "set_id").where("doc_id = doc").dropDuplicates(["set_id"])
    one = stash(one.select("doc", "n", "sketch", _need(F.col("n"), K_LIST, NEED_LIST).alias("need")), "near-class-sketches")

    # Inverted lists: values held by one class go; a class left with too few values has no partner.
    values = one.select("doc", "need", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    common = stash(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "near-values")
    shared = values.join(common, "value").groupBy("doc", "need", "held").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    # Of the held values in order of rarity the first held - need + 1 go to lists; those of df 1 come first.
    room = F.col("held") - F.col("need") + 1 - (F.col("held") - F.size("shared"))
    weight = F.aggregate("shared", F.lit(0.0), lambda t, v: t + F.log2(v["df"].cast("double")))
    lists = shared.where((F.size("shared") >= F.col("need")) & (room > 0)).select("doc", weight.alias("weight"), F.explode(F.slice("shared", F.lit(1), room)).alias("v"))
    lists = stash(lists.select(F.col("v.value").alias("value"), "doc", "weight"), "near-lists")

    label = None
    if not lists.isEmpty():
        ids = stash(lists.select("doc").distinct(), "near-candidates")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        sets = stash(map_rows(text.join(ids, F.col("doc_id") == F.col("doc"), "left_semi"), _sets, _SET).groupBy("doc").agg(F.min("shingles").alias("shingles")), "near-sets")  # of one id's texts always the same

        centres = lists.groupBy("value").agg(F.min("doc").alias("c1"), F.max_by("doc", F.struct("weight", -F.col("doc"))).alias("c2"), F.count("*").alias("m"))
        centres = stash(centres.where("m > 1").select("value", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("centre")), "near-centres")
        stars = lists.join(centres, "value").where("doc <> centre").select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
        label = components(_verified(stars, sets))

        rest = lists.select("value", "doc").join(centres.withColumnRenamed("centre", "doc"), ["value", "doc"], "left_anti")  # all pairs with a centre are done
        for best in (True, False):
            labelled = stash(rest.join(label.toDF("doc", "comp"), "doc", "left").select("value", "doc", F.coalesce("comp", "doc").alias("comp")), "near-labelled")
            several = stash(labelled.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("value"), "near-open")
            rest = stash(labelled.join(several, "value", "left_semi"), "near-open-lists")
            if rest.isEmpty():
                break
            lists_now = _largest_lists(rest) if best else rest
            more = _verified(_list_blocks(lists_now, sets, best), sets)
            label = components(more.unionByName(label.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
            rest = rest.select("value", "doc")
    per_class = classes if label is None else classes.join(label.withColumnRenamed("node", "doc"), "doc", "left").select("set_id", F.coalesce("comp", "doc").alias("doc"))
    per_class = stash(per_class.select("set_id", F.col("doc").alias("comp")), "near-class-components")
    found = all_rows.select("doc_id", "n", "set_id").join(per_class, "set_id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs less the near-duplicates of a document with a smaller id."""
    gone = stash(cluster(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [hash(array_to_string(ws, ' '))]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i + 4], ' '))) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_n >= 75 * (na.n + nb.n - both_n)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
m AS (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
