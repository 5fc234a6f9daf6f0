"""Filters on the raw log that go before mining, applied in one fixed order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formula
from ..log import EventLog, epoch_s
from .metrics import Cases
from .variants import case_variants


def rename(log: EventLog, names: dict[str, str]) -> EventLog:
    """Relabel activities; two names may become one."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else None
    return log if table is None else log.replace(log.df.withColumn("act", F.coalesce(F.element_at(table, F.col("act")), F.col("act"))))


def activities_by_rank(log: EventLog) -> DataFrame:
    """(act, n, rank) by descending frequency, then name."""
    return log.df.groupBy("act").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "act")))


def activity_ranks(log: EventLog, lo: int, hi: int) -> EventLog:
    """Only events whose activity's frequency rank is in [lo, hi]."""
    return log.replace(log.df.join(activities_by_rank(log).where(F.col("rank").between(lo, hi)).select("act"), "act", "left_semi"))


def activities(log: EventLog, keep: list[str] | None = None, exclude: list[str] = ()) -> EventLog:
    df = log.df if keep is None else log.df.where(F.col("act").isin(keep))
    return log.replace(df.where(~F.col("act").isin(list(exclude))) if exclude else df)


def variant_ranks(log: EventLog, lo: int, hi: int) -> EventLog:
    """Only cases of the variants ranked lo to hi by count."""
    traces, v = case_variants(log)
    return log.keep_cases(traces.join(v.where(F.col("rank").between(lo, hi)), "trace", "left_semi"))


def attr_expr(log: EventLog, text: str) -> EventLog:
    """Only cases for which the formula is 1; null is no match."""
    cases = Cases(log)
    value = cases.formula(formula.parse(text))
    return log.keep_cases(cases.table().where(value == 1.0))


def case_times(log: EventLog) -> DataFrame:
    """(case, start_s, end_s) with a bad start counting as its completion."""
    start = F.when(F.col("start_ts") <= F.col("ts"), F.col("start_ts")).otherwise(F.col("ts")) if log.interval else F.col("ts")
    return log.df.groupBy("case").agg(F.min(epoch_s(start)).alias("start_s"), F.max(epoch_s(F.col("ts"))).alias("end_s"))


def _first(t: DataFrame, k: int, value: str, ties: list[str]) -> Column:
    """Whether a row is among the first k by value, then by ties. Needs a column ``tied``: the place among equal values.

    The value at the border is found by two histograms, of buckets of values and of the values of one bucket.
    """
    bucket = F.signum(value) * F.floor(F.log2(F.abs(F.col(value).cast("double")) + 1) * 64)
    before, at = 0, None
    for r in sorted(t.groupBy(bucket.alias("b")).count().collect()):  # 64 rows a doubling
        if before + r["count"] >= k:
            at = r["b"]
            break
        before += r["count"]
    if at is None or k <= 0:
        return F.lit(k > 0)
    for r in t.where(bucket == at).groupBy(value).count().orderBy(value).toLocalIterator():
        if before + r["count"] >= k:
            return (F.col(value) < r[value]) | ((F.col(value) == r[value]) & (F.col("tied") <= k - before))
        before += r["count"]
    return F.lit(True)


def duration_pct(log: EventLog, lo: float, hi: float) -> EventLog:
    """Cases at positions floor(lo n / 100) to ceil(hi n / 100) in order of duration, then of their first event's seq."""
    t = case_times(log).join(log.df.groupBy("case").agg(F.min("seq").alias("first_seq")), "case")
    t = t.select("case", "first_seq", (F.col("end_s") - F.col("start_s")).alias("seconds"))
    n = t.count()
    ties = ["first_seq", "case"]
    t = t.withColumn("tied", F.row_number().over(Window.partitionBy("seconds").orderBy(*ties)))
    upper, lower = _first(t, math.ceil(hi * n / 100), "seconds", ties), _first(t, math.floor(lo * n / 100), "seconds", ties)
    return log.keep_cases(t.where(upper & ~lower))


def time_window(log: EventLog, begin: str | None, end: str | None, contained: bool = False) -> EventLog:
    """Cases that lie in [begin, end], or that meet it; an open side is the log's own."""
    t = log.df.groupBy("case").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    lo, hi = (None if x is None else F.to_timestamp(F.lit(x)) for x in (begin, end))
    cond: Column = F.lit(True)
    if lo is not None:
        cond = cond & ((F.col("a") >= lo) if contained else (F.col("b") >= lo))
    if hi is not None:
        cond = cond & ((F.col("b") <= hi) if contained else (F.col("a") <= hi))
    return log.keep_cases(t.where(cond))


def drop_cases(log: EventLog, cases: DataFrame) -> EventLog:
    return log.keep_cases(cases, "left_anti")


def apply(log: EventLog, o: dict) -> EventLog:
    """All filters that o names, in their order: rename_map, variant_cap, activity_ranks, activity_cap and
    exclude_activities, attr_expr, duration_pct, variant_ranks, time_from / time_to."""
    if o.get("rename_map"):
        log = rename(log, o["rename_map"])
    if o.get("variant_cap"):
        lo, hi, *base = o["variant_cap"]
        log = log.keep_cases(variant_ranks(apply(log, base[0]) if base and base[0] else log, lo, hi).df.select("case").distinct())
    if o.get("activity_ranks"):
        log = activity_ranks(log, *o["activity_ranks"])
    if o.get("activity_cap") is not None or o.get("exclude_activities"):
        log = activities(log, o.get("activity_cap"), o.get("exclude_activities", ()))
    if o.get("attr_expr"):
        log = attr_expr(log, o["attr_expr"])
    if o.get("duration_pct"):
        log = duration_pct(log, *o["duration_pct"])
    if o.get("variant_ranks"):
        log = variant_ranks(log, *o["variant_ranks"])
    if o.get("time_from") or o.get("time_to"):
        log = time_window(log, o.get("time_from"), o.get("time_to"), o.get("time_mode") == "traces_contained")
    return log
