"""Sequence variants, coverage and the log's profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog


#: Activities at a trace's start by which equally frequent variants are told apart before they are ranked.
PREFIX = 3


def trace_counts(log: EventLog) -> tuple[DataFrame, DataFrame]:
    """(case, trace) and (trace, n), without ranks."""
    traces = log.traces()
    return traces, traces.groupBy("trace").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame) -> DataFrame:
    """(trace, n, rank, covered): ranks by descending count, then by trace; covered: cases of the variants up to it.

    Offsets come from a histogram by count and first activities; only variants that share both are numbered
    by a window of their own, so no task sees all distinct traces.
    """
    keys = [F.col("n"), F.slice("trace", 1, PREFIX).alias("prefix")]
    place = Window.orderBy(F.desc("n"), "prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.groupBy(*keys).agg(F.count("*").alias("m"))
    before = before.select("n", "prefix", F.coalesce(F.sum("m").over(place), F.lit(0)).alias("ranks"), F.coalesce(F.sum(F.col("m") * F.col("n")).over(place), F.lit(0)).alias("cases"))
    own = F.row_number().over(Window.partitionBy("n", "prefix").orderBy("trace"))
    t = counts.withColumn("prefix", F.slice("trace", 1, PREFIX)).withColumn("own", own).join(before, ["n", "prefix"])
    return t.select("trace", "n", (F.col("ranks") + F.col("own")).cast("int").alias("rank"), (F.col("cases") + F.col("own") * F.col("n")).alias("covered"))


def case_variants(log: EventLog) -> tuple[DataFrame, DataFrame]:
    """(case, trace) and (trace, n, rank), ranks by descending count, then by trace."""
    traces, counts = trace_counts(log)
    return traces, ranked(counts).drop("covered")


def variants(log: EventLog) -> DataFrame:
    """(variant, rank, n, text)."""
    _, v = case_variants(log)
    return v.select(F.concat(F.lit("v"), F.col("rank").cast("string")).alias("variant"), "rank", "n", F.concat_ws(" → ", "trace").alias("text"))


def coverage(log: EventLog) -> DataFrame:
    """(rank, n, cumulative): the percentage of cases that the variants up to a rank cover, to a tenth."""
    _, counts = trace_counts(log)
    total = counts.agg(F.sum("n")).first()[0] or 1
    return ranked(counts).select("rank", "n", F.round(100.0 * F.col("covered") / F.lit(total), 1).alias("cumulative"))


def profile(log: EventLog) -> DataFrame:
    """One row: events, cases, activities, sequence variants, median and longest trace, variants per case."""
    t = log.traces().withColumn("len", F.size("trace"))
    one = t.agg(F.sum("len").alias("events"), F.count("*").alias("cases"), F.count_distinct(F.xxhash64("trace")).alias("variants"), F.percentile("len", 0.5).alias("median_len"), F.max("len").alias("max_len"))
    acts = log.df.agg(F.count_distinct("act")).first()[0]
    return one.withColumn("activities", F.lit(acts).cast("long")).withColumn("variant_ratio", F.try_divide(F.col("variants"), F.col("cases")))


#: Beyond these a model is slow to mine.
RISK_VARIANTS, RISK_ACTIVITIES = 2000, 50


def mining_risk(log: EventLog) -> dict:
    p = profile(log).first().asDict()
    reasons = [f"{p['variants']} variants"] * (p["variants"] > RISK_VARIANTS) + [f"{p['activities']} activities"] * (p["activities"] > RISK_ACTIVITIES)
    return p | {"risky": bool(reasons), "reasons": reasons}
