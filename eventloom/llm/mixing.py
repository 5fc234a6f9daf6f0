"""Mixing sources to target weights.

Tokens are summed per source; a target share per source gives a repetition rate; each document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a null
doc_id draws as an empty id; rows that share a doc_id share their draw; an empty table gives no rows;
extra columns of any name pass through ``mix`` untouched, as it carries each row as one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bounded, n_words, read, stash

SEED = "mix-1"
#: Sources up to which the rate table is broadcast.
MAX_SOURCES = 50_000
#: Copies of each rate beyond that, so that a hot source is spread over so many tasks.
SALTS = 32


def targets(sizes: DataFrame, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), max_rate: float = 2.0) -> DataFrame:
    """Water-filled targets of a table (mix_source, mix_size): one row per source with source_size, target and rate.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all sizes;
    a target stops at max_rate times its source's size and the excess is reshared by weight. The fixed
    point is min(cap, level * weight); sorted by cap / weight the capped sources are a prefix, so running
    sums find the level without iterating. The windows see one row per source, never the documents.
    """
    per_source = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    place = Window.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    t = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_rate)
    everything = Window.partitionBy()
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    t = (
        t.withColumn("rank", F.row_number().over(rank))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct("rank", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")))
    )
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(max_rate))).otherwise(0.0)
    return t.select("mix_source", "source_size", "target", rate.alias("rate"))


def draw(doc_id, seed: str = SEED) -> F.Column:
    """Uniform in [0, 1): the first 52 bits of an MD5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(16**13)


def mix_plan(docs: DataFrame, whole_rows: bool = False, seed: str = SEED, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), max_rate: float = 2.0) -> DataFrame:
    """Per row of docs: mix_row (the row, or its doc_id alone), mix_source, mix_size, source_size, target, rate and copies."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if whole_rows else F.col("doc_id")
    sized = docs.select(row.alias("mix_row"), F.col("source").alias("mix_source"), n_words(F.col("text")).alias("mix_size"), draw(F.col("doc_id"), seed).alias("mix_draw"))
    if not whole_rows:  # a few bytes a row: write them once instead of counting words twice
        sized = stash(sized, "mix-sizes")
    rates = stash(targets(sized.select("mix_source", "mix_size"), share, weights, max_rate), "mix-rates")
    if rates.count() <= MAX_SOURCES:
        joined = sized.join(bounded(rates, MAX_SOURCES), sized.mix_source.eqNullSafe(rates.mix_source), "left").drop(rates.mix_source)
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = sized.withColumn("salt_", (F.col("mix_draw") * SALTS).cast("int"))
        joined = left.join(salted, left.mix_source.eqNullSafe(salted.mix_source) & (left.salt_ == salted.salt), "left").drop(salted.mix_source, "salt", "salt_")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (F.col("mix_draw") < F.col("rate") - whole).cast("long")).cast("int"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: docs' own columns, a row per copy taken."""
    plan = mix_plan(docs, whole_rows=True, **how).where("copies > 0")
    return plan.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("mix_row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read(spark, sf_dir, "documents"))
    return plan.select(F.col("mix_row").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS sz FROM d GROUP BY source),
w AS (SELECT source, sz, 2 * sz AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS wt FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / wt, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (1.5 * (SELECT sum(sz) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(wt) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r),
t AS (SELECT source, sz, CASE WHEN lv * wt >= cap THEN cap ELSE (SELECT arg_min(lv, k) FROM l WHERE lv * wt < cap) * wt END AS target FROM l),
q AS (SELECT *, CASE WHEN sz > 0 THEN least(target / sz, 2.0) ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size::BIGINT AS size, q.sz::BIGINT AS source_size, q.target::DOUBLE AS target,
       (d.size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
