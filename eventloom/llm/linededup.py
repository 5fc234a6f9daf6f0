"""Line dedup over levelled sorted runs.

A store holds the hashes of every line seen so far as sorted runs, grouped in levels. Batches arrive in
document order. Each batch is anti-joined with the runs: keys not yet held form a new run with the
smallest document that holds them, and once a level has ``fan_in`` runs they are merged into one run of
the next level, so a key is rewritten a logarithmic number of times. A line survives exactly if its
(key, document) pair is in the runs, so that join is on key and document, no common line makes a hot
partition, and one join serves any number of batches once they are added.

The places of a document's dropped lines are told by its id and a 128-bit hash of its text, so each row is
rewritten by its own lines, however many rows share an id or have none.

Defined cases: a null or empty text is one empty line; rows that share a doc_id are one document; all rows
with a null doc_id are one document after all others; empty tables give empty results; extra columns pass,
but columns named line_n, line_dropped, _doc or _gone are replaced or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batch, delete_path, map_rows, read, scratch_path, stash

MIN_CHARS = 10
N_BATCHES = 4
FAN_IN = 3
_LAST = (1 << 63) - 1
_KEYS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
_ROWS = T.StructType([*_KEYS, T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType())])
_RUN = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("owner", T.LongType())])


def line_keys(text: str | None) -> list[bytes | None]:
    """The key of each line; None for lines too short to be dropped."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip().lower()
        out.append(key if len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode()) >= MIN_CHARS) else None)
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        doc, place, h1, h2, t1, t2 = [], [], [], [], [], []
        for i, text, a, b in zip(*(rows[c].to_pylist() for c in range(4)), strict=True):
            for n, key in enumerate(dict.fromkeys(k for k in line_keys(text) if k is not None)):
                d = xxhash.xxh3_128_intdigest(key)
                doc.append(_LAST if i is None else i)
                place.append(n)
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & (1 << 64) - 1) - (1 << 63))
                t1.append(a)
                t2.append(b)
        yield batch({"doc": doc, "ord": place, "h1": h1, "h2": h2, "t1": t1, "t2": t2}, _ROWS)


def _text_hash() -> list[F.Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def hash_lines(docs: DataFrame) -> DataFrame:
    """(doc, ord, h1, h2, t1, t2): the 128-bit hash of each distinct key of a row, ord its place among them, and the text's hash."""
    return map_rows(docs.select("doc_id", "text", *_text_hash()), _hashed, _ROWS)


class LineRuns:
    """Levelled sorted runs of (h1, h2, owner), as Parquet folders below ``path``."""

    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*paths) if paths else self.spark.createDataFrame([], _RUN)

    def _write(self, df: DataFrame, level: int) -> str:
        """Range-partitioned and sorted, so that a file's footer bounds its keys."""
        self._made += 1
        path = f"{self.path}/run-{self._made}-level-{level}"
        df.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch (doc, ord, h1, h2) whose documents follow all earlier ones; returns its ``drops``."""
        new = lines.groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
        if held := self.runs():
            new = new.join(self._read(held).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(new, 0))
        self._compact()
        return self.drops(lines)

    def drops(self, lines: DataFrame) -> DataFrame:
        """lines of added batches that another document holds, less their hashes; lazy, so read it before adding more."""
        kept = self._read(self.runs()).withColumnRenamed("owner", "doc")
        return lines.join(kept, ["h1", "h2", "doc"], "left_anti").drop("h1", "h2")

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            old = self.levels[level]
            if len(old) >= self.fan_in:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self._read(old), level + 1))
                self.levels[level] = []
                for p in old:
                    delete_path(self.spark, p)
            level += 1


def _rewritten(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, lines, dropped = [], [], []
            for text, gone in zip(rows["text"].to_pylist(), rows["_gone"].to_pylist(), strict=True):
                n = text.count("\n") + 1 if text else 1
                if gone:
                    place: dict[bytes, int] = {}
                    bad, kept = set(gone), []
                    for line, key in zip(text.split("\n"), line_keys(text), strict=True):
                        if key is None or place.setdefault(key, len(place)) not in bad:
                            kept.append(line)
                    text, lost = "\n".join(kept), n - len(kept)
                else:
                    lost = 0
                texts.append(text)
                lines.append(n)
                dropped.append(lost)
            own = {"text": pa.array(texts, pa.string()), "line_n": pa.array(lines, pa.int64()), "line_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([own.get(f.name, None) if f.name in own else rows[f.name] for f in schema], names=[f.name for f in schema])

    return run


def dedup_lines(docs: DataFrame, n_batches: int = N_BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """docs with ``text`` less its repeated lines, and line_n (lines before) and line_dropped."""
    spark = docs.sparkSession
    docs = docs.drop("line_n", "line_dropped", "_doc", "_gone")
    lines = stash(hash_lines(docs), "line-keys")
    # batches of like size, whatever the ids
    shares = [i / n_batches for i in range(1, n_batches)]
    ids = docs.select(F.col("doc_id").cast("double").alias("id")).where("id IS NOT NULL")
    cuts = sorted({min(int(x), _LAST - 1) for x in ids.approxQuantile("id", shares, 0.01)}) if shares else []
    store = LineRuns(spark, scratch_path(spark, "line-runs"), fan_in)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        here = F.lit(True) if low is None else F.col("doc") >= low
        store.add(lines.where(here if high is None else here & (F.col("doc") < high)))
    gone = store.drops(lines).groupBy(F.struct("doc", "t1", "t2").alias("_doc")).agg(F.collect_set("ord").alias("_gone"))
    keyed = docs.withColumn("_doc", F.struct(F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("doc"), *_text_hash()))
    wide = keyed.join(gone.hint("shuffle_hash"), "_doc", "left").drop("_doc")
    schema = T.StructType([*docs.schema.fields, T.StructField("line_n", T.LongType()), T.StructField("line_dropped", T.LongType())])
    return map_rows(wide, _rewritten(schema), schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_n").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
