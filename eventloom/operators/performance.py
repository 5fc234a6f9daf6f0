"""Event-weighted statistics of activities, directly-follows pairs and case ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog


#: The statistics of a time, in order.
TIME_STATS = ("mean", "median", "min", "max", "total", "std", "p90", "p95")
NODE_METRICS = ("frequency", "case_coverage", "relative_frequency", "repeat_frequency", "start_frequency", *(f"{k}_{n}" for k in ("service", "sojourn") for n in TIME_STATS))
EDGE_METRICS = ("frequency", "case_frequency", "relative_frequency", "repeat_frequency", "percentage", "and_inflow", *(f"wait_{n}" for n in TIME_STATS))


def time_stats(v: Column, prefix: str = "") -> list[Column]:
    """Mean, median, min, max, total, standard deviation and 90th / 95th percentile of seconds; null without values."""
    q = F.percentile(v, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))  # one map of values serves all three
    stats = {"mean": F.avg(v), "median": q[0], "min": F.min(v), "max": F.max(v), "total": F.sum(v), "std": F.stddev_samp(v), "p90": q[1], "p95": q[2]}
    return [c.cast("double").alias(f"{prefix}{n}") for n, c in stats.items()]


def _with_stats(rows: DataFrame, keys: list[str], cases: str, values: dict[str, Column]) -> DataFrame:
    """Per keys: frequency, distinct cases under the name given, and the time statistics of whole-second values.

    One pass: a case is counted by its first row of the keys, which a window tells where the case lies already; the
    statistics come from counts of equal values, so a repeated value is one row.
    """
    own = Window.partitionBy("case", *keys).orderBy(F.lit(0))
    marked = rows.select("case", *keys, *(v.cast("long").alias(f"_{k}") for k, v in values.items()))
    marked = marked.withColumn("first", (F.row_number().over(own) == 1).cast("long"))
    lead = next(iter(values))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("v"), (F.col("first") if k == lead else F.lit(0).cast("long")).alias("first")) for k in values)))
    equal = marked.select(*keys, each.alias("x")).groupBy(*keys, "x.kind", "x.v").agg(F.count("*").alias("n"), F.sum("x.first").alias("cases"))
    v, n = F.col("v").cast("double"), F.when(F.col("v").isNotNull(), F.col("n"))
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)), F.coalesce(n, F.lit(0)))
    many, total, squares = F.sum(n), F.sum(v * n), F.sum(v * v * n)
    std = F.when(many > 1, F.sqrt(F.greatest(squares - total * total / many, F.lit(0.0)) / (many - 1)))
    stats = {"mean": total / many, "median": q[0], "min": F.min(v), "max": F.max(v), "total": total, "std": std, "p90": q[1], "p95": q[2]}
    per = equal.groupBy(*keys, "kind").agg(F.sum("n").alias("frequency"), F.sum("cases").alias(cases), *(c.cast("double").alias(k) for k, c in stats.items()))
    of = lambda k, name: F.max(F.when(F.col("kind") == k, F.col(name)))
    return per.groupBy(*keys).agg(of(lead, "frequency").alias("frequency"), of(lead, cases).alias(cases), *(of(k, name).alias(f"{k}_{name}") for k in values for name in TIME_STATS))


def _share(df: DataFrame, by: list[str]) -> DataFrame:
    """relative_frequency: of all events, or of those of the same cell."""
    return df.withColumn("relative_frequency", F.col("frequency") / F.sum("frequency").over(Window.partitionBy(*by)))


def activity_stats(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per activity: frequency, case coverage, repeats; service time (own start to completion, bad starts kept) and sojourn."""
    times = {"service": F.col("end_s") - F.col("own_start_s"), "sojourn": F.col("end_s") - F.col("prev_end_s")}
    out = _with_stats(events, [*by, "act"], "case_coverage", times)
    return _share(out, list(by)).withColumn("repeat_frequency", F.col("frequency") - F.col("case_coverage"))


def pair_stats(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per directly-follows pair: frequency, cases, waiting from completion to the next start (or completion)."""
    steps = events.where("next_act IS NOT NULL").withColumnRenamed("act", "a").withColumnRenamed("next_act", "b")
    return _share(_with_stats(steps, [*by, "a", "b"], "case_frequency", {"wait": F.col("next_start_s") - F.col("end_s")}), list(by))


def combined_segment(pairs: DataFrame) -> DataFrame:
    """Several pairs as one segment: sums, frequency-weighted mean, extremes."""
    return pairs.agg(F.sum("frequency").alias("frequency"), F.sum("wait_total").alias("total"), (F.sum(F.col("wait_mean") * F.col("frequency")) / F.sum("frequency")).alias("mean"), F.min("wait_min").alias("min"), F.max("wait_max").alias("max"))


def start_end_activities(log: EventLog) -> DataFrame:
    """(act, starts, ends): cases that start and end with each activity."""
    order = F.struct("ts", "seq")
    ends = log.df.groupBy("case").agg(F.min_by("act", order).alias("first"), F.max_by("act", order).alias("last"))
    both = ends.select(F.explode(F.array(F.struct(F.col("first").alias("act"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("last").alias("act"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x"))
    return both.groupBy(F.col("x.act").alias("act")).agg(F.sum("x.s").alias("starts"), F.sum("x.e").alias("ends"))


def branch_shares(counts: DataFrame, fork: str = "fork", branch: str = "branch") -> DataFrame:
    """Percentage of a fork's cases that each branch takes."""
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(fork)))


def and_inflow(counts: DataFrame, node: str = "node", n: str = "n") -> DataFrame:
    """(node, inflow): what flows into a parallel join: the most of its branches, not their sum, as all belong to one run."""
    return counts.groupBy(node).agg(F.max(n).alias("inflow"))


def segment_pairs(tree, pairs: DataFrame) -> DataFrame:
    """The directly-follows pairs that lie on each segment of a model: (segment, a, b, ...) for the segments of a tree.

    A segment is a place between two children of a sequence, or from a loop's end to its beginning; its pairs go
    from an activity that can end what is before to one that can start what is after. Models are small: sets of
    activities are found on the driver and joined as rows.
    """
    from .tree import AND, LOOP, SEQ, XOR, node, numbered

    ids = {id(t): i for i, t in numbered(tree).items()}

    def empty(t) -> bool:
        kids = t.children
        return t.label is None if t.op is None else any(map(empty, kids)) if t.op == XOR else empty(kids[0]) if t.op == LOOP else all(map(empty, kids))

    def edge(t, last: bool) -> set[str]:
        kids = t.children
        if t.op is None:
            return {t.label} - {None}
        if t.op in (XOR, AND):
            return set().union(*(edge(k, last) for k in kids))
        if t.op == LOOP:
            return edge(kids[0], last) | (set().union(*(edge(k, last) for k in kids[1:])) if empty(kids[0]) else set())
        out: set[str] = set()
        for k in reversed(kids) if last else kids:
            out |= edge(k, last)
            if not empty(k):
                break
        return out

    rows = []

    def go(t) -> None:
        kids = t.children
        if t.op == SEQ:
            for k in range(len(kids) - 1):
                before, after = node(SEQ, *kids[: k + 1]), node(SEQ, *kids[k + 1 :])
                rows.extend((f"{ids[id(t)]}.{k}", a, b) for a in sorted(edge(before, True)) for b in sorted(edge(after, False)))
        if t.op == LOOP:
            again = set().union(*(edge(k, False) for k in kids[1:])) | (edge(kids[0], False) if any(map(empty, kids[1:])) else set())
            rows.extend((f"{ids[id(t)]}.back", a, b) for a in sorted(edge(kids[0], True)) for b in sorted(again))
        for k in kids:
            go(k)

    go(tree)
    return pairs.join(pairs.sparkSession.createDataFrame(rows, "segment string, a string, b string"), ["a", "b"])
