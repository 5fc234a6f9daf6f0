"""What a dashboard of a log should show: the data behind it and the rules over it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import EventLog
from . import families, widgets
from .performance import pair_stats
from .variants import case_variants

#: Least share of cases for a decision point and for each of its branches.
MIN_BRANCH_SHARE = 0.1
#: Segments that an axis must have to be charted, and points of a trend.
MIN_SEGMENTS, MAX_SEGMENTS, MIN_PERIODS = 2, 24, 3
#: Least score of an attribute that tells cases apart; variants beyond the first TOP_VARIANTS count as one.
MIN_ATTRIBUTE_SCORE, TOP_VARIANTS = 0.05, 30
WARN_FACTOR, TARGET_DIGITS = 1.2, 3


def time_share(log: EventLog) -> DataFrame:
    """(act, seconds, share, reach, repeats): share of all time that passes up to an activity's completions; the
    cases that reach it and those that do so twice or more."""
    gap = F.greatest(F.col("end_s") - F.col("prev_end_s"), F.lit(0))
    per = log.events().groupBy("case", "act").agg(F.sum(gap).alias("s"), F.count("*").alias("n"))
    t = per.groupBy("act").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("seconds"), F.count("*").alias("reach"), F.count_if(F.col("n") > 1).alias("repeats"))
    total = t.agg(F.sum("seconds")).first()[0] or 0
    return t.select("act", "seconds", (F.col("seconds") / float(total) if total else F.lit(0.0)).alias("share"), "reach", "repeats")


def _steps(log: EventLog) -> DataFrame:
    """(case, a, b): the steps that each case takes, however often."""
    e = log.events().where("next_act IS NOT NULL")
    return e.select("case", F.col("act").alias("a"), F.col("next_act").alias("b")).distinct()


def edge_cases(log: EventLog) -> DataFrame:
    """(a, b, cases)."""
    return _steps(log).groupBy("a", "b").agg(F.count("*").alias("cases"))


def both_ways(log: EventLog) -> DataFrame:
    """(a, b, forth, back, both, interleaved): steps whose reverse is taken too, in both directions.

    Cases that return b to a after a to b are a loop's; if under half of the returning cases also went forth, the
    two steps are orders of a parallel pair.
    """
    way = _steps(log).where("a <> b").select("case", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") < F.col("b")).alias("forth"))
    per = way.groupBy("case", "x", "y").agg(F.bool_or("forth").alias("f"), F.bool_or(~F.col("forth")).alias("g"))
    n = per.groupBy("x", "y").agg(F.count_if("f").alias("f"), F.count_if("g").alias("g"), F.count_if(F.col("f") & F.col("g")).alias("both"))
    n = n.where("f > 0 AND g > 0")
    ways = n.selectExpr("x AS a", "y AS b", "f AS forth", "g AS back", "both").union(n.selectExpr("y", "x", "g", "f", "both"))
    return ways.withColumn("interleaved", F.col("both") < 0.5 * F.col("back"))


def interleaving(log: EventLog) -> DataFrame:
    """(a, b, forth, back, both): steps a to b that are one order of a parallel pair, by the cases that return."""
    return both_ways(log).where("interleaved").drop("interleaved")


def decision_points(log: EventLog, least: float = MIN_BRANCH_SHARE) -> DataFrame:
    """(act, b, cases, share): activities that a tenth of the cases reach and that are left by two or more branches,
    each taken by a tenth of the cases reaching it. A step to itself is rework; a successor that interleaves with
    the activity is no branch, and two successors that interleave with each other are halves of a parallel split."""
    par = interleaving(log).select("a", "b").persist()
    per = log.df.groupBy("case", "act").agg(F.lit(1).alias("one"))
    reach = per.groupBy("act").agg(F.count("*").alias("reach"))
    n = log.df.agg(F.count_distinct("case")).first()[0]
    reach = reach.where(F.col("reach") >= least * n).withColumnRenamed("act", "a")
    out = edge_cases(log).where("a <> b").join(reach, "a").withColumn("share", F.col("cases") / F.col("reach"))
    out = out.where(F.col("share") >= least).join(par, ["a", "b"], "left_anti")
    pairs = out.select("a", "b").join(out.select("a", F.col("b").alias("other")), "a").where("b <> other")  # successors of one activity
    halves = pairs.join(par.toDF("b", "other"), ["b", "other"], "left_semi").select("a", "b").distinct()
    out = out.join(halves, ["a", "b"], "left_anti")
    many = out.groupBy("a").agg(F.count("*").alias("branches")).where("branches >= 2")
    return out.join(many, "a").select(F.col("a").alias("act"), "b", "cases", "share")


def period_axis(log: EventLog) -> str | None:
    """The finest of month, quarter and year with 3 to 24 segments."""
    d = F.timestamp_seconds("start_s")
    t = log.events().groupBy("case").agg(F.min("start_s").alias("start_s"))
    quarter = F.concat(F.year(d), F.lit("-"), F.quarter(d))
    n = t.agg(F.count_distinct(F.date_format(d, "yyyy-MM")).alias("month"), F.count_distinct(quarter).alias("quarter"), F.count_distinct(F.year(d)).alias("year")).first()
    return next((k for k in ("month", "quarter", "year") if MIN_PERIODS <= n[k] <= MAX_SEGMENTS), None)


def _percent(share: float) -> str:
    return f"{share * 100:.0f}%"


def attribute_scores(log: EventLog) -> DataFrame:
    """(attribute, segments, coverage, balance, divergence, effect, score, strong, reason), best first.

    Scored on the labels that an axis would draw. Only attributes with 2 to 24 segments, known for half of the
    cases or more and not nearly constant; divergence is the normalised mutual information with the variant,
    effect the share of the duration's variance between segments.
    """
    spark = log.df.sparkSession
    schema = "attribute string, segments int, coverage double, balance double, divergence double, effect double, score double, strong boolean, reason string"
    if log.attrs is None:
        return spark.createDataFrame([], schema)
    traces, v = case_variants(log)
    code = traces.join(v.select("trace", F.least("rank", F.lit(TOP_VARIANTS + 1)).alias("variant")), "trace").select("case", "variant")
    times = log.events().groupBy("case").agg((F.max("end_s") - F.min("start_s")).cast("double").alias("seconds"))
    names = [c for c in log.attrs.columns if c != "case"]
    labels = [widgets.attribute_label(log, c).alias(f"l{i}") for i, c in enumerate(names)]
    t = code.join(times, "case").join(log.attrs, "case", "left").select("variant", "seconds", *labels).persist()
    rows = []
    for i, name in enumerate(names):  # a row per attribute of the log
        counts = t.groupBy(f"l{i}").agg(F.count("*").alias("n")).orderBy(F.col(f"l{i}").isNull(), F.desc("n")).limit(MAX_SEGMENTS + 2).collect()
        known = [r["n"] for r in counts if r[0] is not None]
        if not MIN_SEGMENTS <= len(known) <= MAX_SEGMENTS:
            continue
        total = sum(r["n"] for r in counts)
        coverage, balance = sum(known) / total, 1 - max(known) / sum(known)
        if coverage < 0.5 or balance < 0.05:
            continue
        divergence = families.mutual_information(t, f"l{i}", "variant").first()[0]
        effect = families.eta_squared(t, f"l{i}", "seconds").first()[0]
        score = 0.6 * divergence + 0.4 * effect
        if score < MIN_ATTRIBUTE_SCORE:
            reason = f"its {len(known)} values hardly tell behaviour or duration apart"
        elif divergence >= 0.15 and effect >= 0.1:
            reason = f"tells behaviour ({_percent(divergence)} of the variants' variation) and duration apart"
        elif divergence >= effect:
            reason = f"tells behaviour apart: {_percent(divergence)} of the variants' variation"
        else:
            reason = f"tells durations apart: {_percent(effect)} of their variance"
        numbers = (round(x, 6) for x in (coverage, balance, divergence, effect, score))
        rows.append((name, len(known), *numbers, score >= MIN_ATTRIBUTE_SCORE, reason))
    t.unpersist()
    return spark.createDataFrame(rows, schema).orderBy(F.desc("score"), "attribute")


def significant(value: float, digits: int = TARGET_DIGITS) -> float:
    """value to so many significant figures; 0 if it is not finite."""
    if not value or not math.isfinite(value):
        return 0.0
    return round(value, digits - 1 - math.floor(math.log10(abs(value))))


def baseline_target(value: float | None) -> dict | None:
    """A target of "no worse than today", switched off; none without a positive value."""
    if value is None or value <= 0:
        return None
    return {"on": False, "dir": "max", "value": significant(value), "warn": significant(value * WARN_FACTOR)}


def draws(log: EventLog, spec: dict) -> bool:
    """Whether a chart has enough to show: two bars, three points of a line, a table of two by two."""
    viz, seg = spec.get("viz", "kpi"), spec.get("segment", {})
    if viz not in ("bar", "line", "table", "pie") or not seg:
        return True
    out = widgets.compute_widget(log, spec)
    if viz == "table":
        live = out.where("r IS NOT NULL AND c IS NOT NULL").agg(F.count_distinct("r"), F.count_distinct("c")).first()
        return min(live) >= 2
    key = next(k for k in ("r", "c") if k in out.columns)
    return out.where(F.col(key).isNotNull() & F.col("value").isNotNull()).count() >= (MIN_PERIODS if viz == "line" else MIN_SEGMENTS)


def suggest_dashboards(log: EventLog, max_widgets: int = 10) -> list[dict]:
    """Dashboards as widget specs: overview, bottlenecks, rework and flow, segments, variants; charts that would be
    nearly empty are left out, and the overview's targets start from today's values."""
    period = period_axis(log)
    shares = time_share(log).persist()
    slow = [r["act"] for r in shares.orderBy(F.desc("seconds"), "act").limit(3).collect()]
    again = [r["act"] for r in shares.where("repeats > 0").orderBy(F.desc("repeats"), "act").limit(3).collect()]
    shares.unpersist()
    edges = [(r["a"], r["b"]) for r in pair_stats(log.events()).orderBy(F.desc("wait_total"), "a", "b").limit(3).collect()]
    splits = decision_points(log).orderBy(F.desc("cases"), "act", "b").limit(4).collect()
    attrs = [r["attribute"] for r in attribute_scores(log).collect()]
    trend = [{"metric": "duration", "agg": "avg", "segment": {"rows": period}, "viz": "line"}] if period else []

    def with_target(spec: dict) -> dict:
        goal = baseline_target(widgets.compute_widget(log, spec).first()["value"])
        return spec | ({"baseline": goal} if goal else {})

    boards = {
        "overview": [
            *map(with_target, ({"metric": "duration", "agg": "median"}, {"metric": "duration", "agg": "p90"}, {"metric": "rework"})),
            {"metric": "eventCount", "agg": "avg"},
            *trend,
            {"metric": "arrivalRate", "agg": "avg"},
            {"metric": "wip", "agg": "avg"},
        ],
        "bottlenecks": [
            *({"metric": "actSojourn", "params": {"activity": a}, "agg": "median"} for a in slow),
            *({"metric": "edgeTime", "params": {"from": a, "to": b}, "agg": "median"} for a, b in edges),
        ],
        "rework and flow": [
            {"metric": "rework"},
            *({"metric": "actRepeats", "params": {"activity": a}, "agg": "avg"} for a in again),
            *({"metric": "edgeShare", "params": {"from": r["act"], "to": r["b"]}} for r in splits),
        ],
        "segments": [{"metric": "duration", "agg": "median", "segment": {"rows": f"attr:{a}"}, "viz": "bar"} for a in attrs],
        "variants": [
            {"metric": "duration", "agg": "median", "segment": {"rows": "variant"}, "viz": "bar"},
            {"metric": "eventCount", "agg": "avg", "segment": {"rows": "variant"}, "viz": "bar"},
        ],
    }
    found = {n: [w for w in ws[:max_widgets] if draws(log, w)] for n, ws in boards.items()}
    return [{"name": n, "widgets": ws} for n, ws in found.items() if ws]
