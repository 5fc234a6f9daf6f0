"""Per-case metrics: a case table in one aggregation over the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formula
from ..log import EventLog

DAY = 86400.0
TIME, COUNT, PERCENT, RATE = "time", "count", "percent", "rate"
#: Metric names, their types and parameters.
CATALOG = {
    "duration": (TIME, ()), "timeBetween": (TIME, ("from", "to")), "eventCount": (COUNT, ()), "rework": (PERCENT, ()),
    "actFreq": (COUNT, ("activity",)), "actPresence": (PERCENT, ("activity",)), "actRepeats": (COUNT, ("activity",)), "actRework": (PERCENT, ("activity",)),
    "actSojourn": (TIME, ("activity",)), "actService": (TIME, ("activity",)), "actWaiting": (TIME, ("activity",)),
    "edgeFreq": (COUNT, ("from", "to")), "edgeTime": (TIME, ("from", "to")), "edgeShare": (PERCENT, ("from", "to")),
    "wip": (RATE, ()), "arrivalRate": (RATE, ()), "completionRate": (RATE, ()), "custom": (None, ("formula",)),
}
SERIES = ("wip", "arrivalRate", "completionRate")
#: What may be aggregated how, by type; metrics that need start times.
AGGREGATIONS = {
    TIME: ("avg", "median", "p90", "sum", "min", "max"),
    COUNT: ("avg", "median", "p90", "sum", "min", "max"),
    PERCENT: ("share",),
    RATE: ("avg", "median", "p90", "max"),
}
NEED_STARTS = ("actService", "actWaiting")


def catalog(log: EventLog) -> list[dict]:
    """Every metric with its parameters, type, allowed aggregations, and why the log cannot have it, if it cannot."""
    lacking = {m: "the log has no start times" for m in NEED_STARTS if not log.interval}
    every = tuple(dict.fromkeys(a for names in AGGREGATIONS.values() for a in names))  # a formula's type is its own
    return [{"metric": m, "type": kind, "params": params, "aggregations": AGGREGATIONS.get(kind, every), "available": m not in lacking, "reason": lacking.get(m)} for m, (kind, params) in CATALOG.items()]


class Cases:
    """Collects the aggregates that metrics, filters and axes ask for, then builds the case table at once."""

    def __init__(self, log: EventLog):
        self.log, self.aggs, self.windows = log, {}, {}
        self.need("start_s", F.min("start_s"))
        self.need("end_s", F.max("end_s"))
        self.need("n_events", F.count("*"))

    def need(self, name: str, agg: Column) -> Column:
        self.aggs.setdefault(name, agg)
        return F.col(f"`{name}`")

    def window(self, name: str, column: Column) -> Column:
        """A column over all of a case's events, made before the aggregation."""
        self.windows.setdefault(name, column)
        return F.col(f"`{name}`")

    def count_of(self, a: str) -> Column:
        return self.need(f"n:{a}", F.count_if(F.col("act") == a))

    def between(self, a: str, b: str) -> Column:
        """Seconds from the first a to the first b after it, by index."""
        first = self.window(f"first:{a}", F.min(F.when(F.col("act") == a, F.struct("idx", "end_s"))).over(Window.partitionBy("case")))
        after = (F.col("act") == b) & (F.col("idx") > first["idx"])
        end = F.min(F.when(after, F.struct("idx", "end_s")))["end_s"]
        return self.need(f"between:{a}:{b}", end - F.min(first)["end_s"])

    def first_resource(self) -> Column:
        return self.need("first_res", F.min_by("res", F.struct("ts", "seq"))) if "res" in self.log.df.columns else F.lit(None).cast("string")

    def variant(self) -> Column:
        return self.need("trace", F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", "act"))), lambda x: x["act"]))

    def value(self, metric: str, p: dict) -> Column:
        """The metric's per-case value; null: missing. Times in days."""
        a = p.get("activity")
        act = F.col("act") == a if a is not None else None
        seconds = {
            "duration": lambda: F.col("end_s") - F.col("start_s"),
            "timeBetween": lambda: self.between(p["from"], p["to"]),
            "actSojourn": lambda: self.need(f"sojourn:{a}", F.avg(F.when(act, F.col("end_s") - F.col("prev_end_s")))),
            "actService": lambda: self.need(f"service:{a}", F.avg(F.when(act & F.col("ok_start"), F.col("end_s") - F.col("own_start_s")))),
            "actWaiting": lambda: self.need(f"waiting:{a}", F.avg(F.when(act & F.col("ok_start"), F.col("own_start_s") - F.col("prev_end_s")))),
        }
        if metric in seconds:
            return seconds[metric]() / DAY
        if metric == "eventCount":
            return F.col("n_events").cast("double")
        if metric == "rework":
            return (F.col("n_events") > self.need("n_acts", F.count_distinct("act"))).cast("double")
        if metric in ("actFreq", "actPresence", "actRepeats", "actRework"):
            n = self.count_of(a)
            return {"actFreq": n, "actPresence": n > 0, "actRepeats": F.greatest(n - 1, F.lit(0)), "actRework": F.when(n > 0, n > 1)}[metric].cast("double")
        if metric in ("edgeFreq", "edgeTime", "edgeShare"):
            step = (F.col("act") == p["from"]) & (F.col("next_act") == p["to"])
            key = f"{p['from']}:{p['to']}"
            if metric == "edgeTime":
                return self.need(f"edge_s:{key}", F.avg(F.when(step, F.col("next_end_s") - F.col("end_s")))) / DAY
            n = self.need(f"edge:{key}", F.count_if(step))
            return (n if metric == "edgeFreq" else F.when(self.count_of(p["from"]) > 0, n > 0)).cast("double")
        if metric == "custom":
            try:
                return self.formula(formula.parse(p["formula"]))
            except formula.FormulaError:
                return F.lit(None).cast("double")
        raise ValueError(f"unknown metric {metric!r}")

    def formula(self, node: formula.Node) -> Column:
        attrs = self.log.attrs.columns if self.log.attrs is not None else ()

        def call(name: str, *args: str) -> Column:
            if name == "duration":
                return (F.col("end_s") - F.col("start_s")) / DAY
            if name == "contains":
                return (self.count_of(args[0]) > 0).cast("double")
            if name == "count":
                return self.count_of(args[0])
            if name == "time_between":
                return self.between(*args) / DAY
            if name == "timestamp":
                return self.need(f"first_s:{args[0]}", F.min(F.when(F.col("act") == args[0], F.struct("idx", "end_s")))["end_s"])
            return F.col(f"`{args[0]}`") if args[0] in attrs else F.lit(None).cast("string")

        return formula.compile_node(node, call, self.log.numeric)

    def table(self) -> DataFrame:
        e = self.log.events()
        for name, c in self.windows.items():
            e = e.withColumn(name, c)
        return self.log.with_attrs(e.groupBy("case").agg(*(c.alias(n) for n, c in self.aggs.items())))


def result_type(metric: str, p: dict) -> str:
    if metric != "custom":
        return CATALOG[metric][0]
    try:
        return formula.result_type(formula.parse(p["formula"]))
    except formula.FormulaError:
        return COUNT


def series(cases: DataFrame, metric: str) -> DataFrame:
    """(label, value) per month from the first start to the last end of cases (start_s, end_s)."""
    month = lambda s: F.date_trunc("month", F.timestamp_seconds(s))
    span = cases.agg(F.min("start_s").alias("a"), F.max("end_s").alias("b"))
    months = span.where("a IS NOT NULL").select(F.explode(F.sequence(month(F.col("a")), month(F.col("b")), F.expr("interval 1 month"))).alias("m"))
    starts = cases.groupBy(month(F.col("start_s")).alias("m")).agg(F.count("*").alias("n_start"), F.count_if(F.timestamp_seconds("start_s") == month(F.col("start_s"))).alias("at_start"))
    ends = cases.groupBy(month(F.col("end_s")).alias("m")).agg(F.count("*").alias("n_end"), F.count_if(F.timestamp_seconds("end_s") == month(F.col("end_s"))).alias("at_end"))
    t = months.join(starts, "m", "left").join(ends, "m", "left").fillna(0)
    if metric == "wip":  # at a month's boundary: started by then less ended by then
        before = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
        run = lambda n, at: F.coalesce(F.sum(n).over(before), F.lit(0)) + F.col(at)
        value = run("n_start", "at_start") - run("n_end", "at_end")
    else:
        value = F.col("n_start") if metric == "arrivalRate" else F.col("n_end")
    return t.select(F.date_format("m", "yyyy-MM").alias("label"), value.cast("double").alias("value"))
