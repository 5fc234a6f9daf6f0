"""Widgets: filters, axes, aggregation, targets, distributions and scorecards over the case table."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..log import EventLog
from .metrics import CATALOG, DAY, PERCENT, SERIES, Cases, result_type, series

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
HISTOGRAM_BINS, INTEGER_SPAN, MAX_OUTLIERS = 20, 40, 100
#: Quantile bins of a numeric axis; from how many whole levels on they are used.
NUMERIC_BINS, DISCRETE_LEVELS = 4, 10
#: Bars of a categorical axis, slices of a pie with the rest in one.
MAX_BARS, MAX_SLICES = 24, 8
TIME_AXES = ("year", "quarter", "month", "weekday")
STATES = ("met", "risk", "missed")


def start_date() -> Column:
    return F.timestamp_seconds("start_s")


def axis(cases: Cases, name: str) -> Column:
    """The label of a case on an axis; null: on none."""
    d = start_date()
    if name in ("year", "month"):
        return F.date_format(d, "yyyy" if name == "year" else "yyyy-MM")
    if name == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    if name == "weekday":
        return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(d) + 1)
    if name == "resource":
        return cases.first_resource()
    if name == "variant":
        return F.concat_ws(" → ", cases.variant())
    if name.startswith("attr:"):
        return attribute_label(cases.log, name[5:])
    raise ValueError(f"unknown axis {name!r}")


def number_text(x: float) -> str:
    """A level: whole numbers plain, others to four significant figures."""
    return f"{x:.0f}" if float(x).is_integer() else f"{x:.4g}"


def numeric_bins(log: EventLog, name: str, bins: int = NUMERIC_BINS) -> tuple[list[float], list[str]]:
    """Edges and labels of a numeric attribute: a bin per level of few whole numbers, else quantiles without repeats."""
    c = F.col(f"`{name}`").cast("double")
    own = log.attrs.join(log.df.select("case").distinct(), "case", "left_semi")
    known = own.where(c.isNotNull() & ~F.isnan(c)).select(c.alias("v"))
    levels = sorted(r["v"] for r in known.distinct().limit(DISCRETE_LEVELS).collect())  # enough to tell few from many
    if not levels:
        return [], []
    if len(levels) < DISCRETE_LEVELS and all(v.is_integer() for v in levels):
        return [*levels, levels[-1]], [number_text(v) for v in levels]
    quantiles = known.agg(F.percentile("v", F.array(*(F.lit(i / bins) for i in range(bins + 1))))).first()[0]
    edges = sorted(set(quantiles))
    edges = edges if len(edges) > 1 else [edges[0], edges[0] + 1.0]
    return edges, [f"{number_text(a)}–{number_text(b)}" for a, b in zip(edges, edges[1:], strict=False)]


def attribute_label(log: EventLog, name: str) -> Column:
    """A case's label on an attribute's axis: its value, or the bin [lo, hi) of a number, the last closed; null outside."""
    if name not in log.numeric:
        return F.col(f"`{name}`").cast("string")
    edges, labels = numeric_bins(log, name)
    c = F.col(f"`{name}`").cast("double")
    if not edges:
        return F.lit(None).cast("string")
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1])) if len(edges) > 2 else F.expr("cast(array() as array<double>)")
    place = F.size(F.filter(inner, lambda e: e <= c))
    return F.when(c.between(edges[0], edges[-1]), F.get(F.array(*map(F.lit, labels)), place))


def axes(log: EventLog) -> list[str]:
    """The axes that a log offers."""
    own = [f"attr:{c}" for c in log.attrs.columns if c != "case"] if log.attrs is not None else []
    return ["year", "quarter", "month", "weekday", *(["resource"] if "res" in log.df.columns else []), "activity", "variant", *own]


def date_span(log: EventLog) -> DataFrame:
    """One row: the days of the first and the last case start."""
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    starts = log.events().groupBy("case").agg(F.min("start_s").alias("start_s")).agg(F.min("start_s").alias("a"), F.max("start_s").alias("b"))
    return starts.select(day("a").alias("first"), day("b").alias("last"))


def common_endpoints(log: EventLog) -> DataFrame:
    """One row: the activities that most cases start and end with, the first by name of equals."""
    order = F.struct("ts", "seq")
    ends = log.df.groupBy("case").agg(F.min_by("act", order).alias("a"), F.max_by("act", order).alias("b"))
    most = lambda c, name: ends.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(1).select(F.col(c).alias(name))
    return most("a", "first").join(most("b", "last"), F.lit(True))  # one row each


def unbound(log: EventLog, specs: list[dict]) -> list[str]:
    """What widget specs and their filters name that the log does not have: activities, attributes, axes."""
    acts = {r["act"] for r in log.df.select("act").distinct().collect()}  # an alphabet
    have, out = set(axes(log)), []
    for spec in specs:
        named = [v for k, v in spec.get("params", {}).items() if k in ("activity", "from", "to")]
        for f in spec.get("filters", ()):
            named += [f["value"]] if f["field"] == "contains" else []
            if f["field"].startswith("attr:") and f["field"] not in have:
                out.append(f["field"])
        out += [a for a in named if a not in acts]
        out += [a for a in spec.get("segment", {}).values() if a and a not in have]
    return list(dict.fromkeys(out))


def _period(text: str) -> Column:
    """The first second after the period that text (2012, 2012-12 or 2012-12-05) names."""
    y, m, d = (text.split("-") + [None, None])[:3]
    start = F.to_timestamp(F.lit(f"{y}-{m or '01'}-{d or '01'}"))
    return F.unix_timestamp(start + F.expr("interval 1 day" if d else "interval 1 month" if m else "interval 1 year"))


def predicate(cases: Cases, f: dict) -> Column:
    """A dashboard filter as a never-null condition; a missing value passes ``not`` except for numbers."""
    field, op, value = f["field"], f.get("op", "is"), f["value"]

    def chosen(same: Column) -> Column:
        same = F.coalesce(same, F.lit(False))
        return ~same if op == "not" else same

    values = value if isinstance(value, list) else [value]
    if field == "contains":
        return chosen(cases.count_of(value) > 0)
    if field == "date":
        out = F.lit(True)
        if value[0]:
            y, m, d = (value[0].split("-") + ["01", "01"])[:3]
            out = out & (F.col("start_s") >= F.unix_timestamp(F.to_timestamp(F.lit(f"{y}-{m}-{d}"))))
        return out & (F.col("start_s") < _period(value[1])) if value[1] else out
    if field == "resource":
        return chosen(cases.first_resource().isin(values)) if "res" in cases.log.df.columns else F.lit(True)
    if field == "segment":
        return chosen(cases.count_of(value[1]) > 0 if value[0] == "activity" else axis(cases, value[0]) == value[1])
    if field.startswith("attr:"):
        name = field[5:]
        if cases.log.attrs is None or name not in cases.log.attrs.columns:
            return F.lit(True)
        c = F.col(f"`{name}`")
        if name in cases.log.numeric:
            ops = {">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value, "is": c == value, "not": c != value} if not isinstance(value, list) else {"between": c.between(*value)}
            if op not in ops:
                raise ValueError(f"no operation {op!r} on numbers")
            return F.coalesce(ops[op], F.lit(False))
        return chosen(c.cast("string").isin([str(v) for v in values]))
    raise ValueError(f"unknown filter {field!r}")


def aggregate(agg: str, v: Column) -> Column:
    if agg == "share":
        return F.try_divide(100.0 * F.count_if(v != 0), F.count(v))
    if agg in ("median", "p90"):
        return F.percentile(v, 0.5 if agg == "median" else 0.9)
    return {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg](v)


def state(value: Column, target: dict) -> Column:
    """met, risk or missed; null without a value."""
    goal, warn = float(target["value"]), target.get("warn")
    up = target.get("dir", "max") == "min"  # min: at least; max: at most
    met = value >= goal if up else value <= goal
    risk = F.lit(False) if warn is None else (value >= float(warn) if up else value <= float(warn))
    return F.when(value.isNotNull(), F.when(met, "met").when(risk, "risk").otherwise("missed"))


def half_away(v: Column, digits: int) -> Column:
    m = 10.0**digits
    return F.signum(v) * F.floor(F.abs(v) * m + 0.5) / m


def _number(v: Column, pattern: str) -> Column:
    return F.call_function("format_number", v, F.lit(pattern))


def format_value(v: Column, kind: str) -> Column:
    """Display text: adaptive d / h / m / s, percent with a decimal, counts with commas."""
    sign, x = F.when(v < 0, "-").otherwise(""), F.abs(v) * 86400.0
    unit = lambda per, u: F.concat(sign, _number(half_away(x / per, 1), "#,##0.#"), F.lit(u))
    time = F.when(x >= 86400, unit(86400, " d")).when(x >= 3600, unit(3600, " h")).when(x >= 60, unit(60, " m")).otherwise(unit(1, " s"))
    text = time if kind == "time" else F.concat(_number(half_away(v, 1), "#,##0.0"), F.lit("%")) if kind == PERCENT else _number(half_away(v, 2), "#,##0.##")
    return F.when(v.isNull(), "—").otherwise(text)


def goal_text(target: dict, kind: str) -> str:
    mark = "≥" if target.get("dir", "max") == "min" else "≤"
    return f"{mark} {target['value']:g}" + {"time": " d", PERCENT: "%"}.get(kind, "") + (" of cases" if target.get("per_case") else "")


def case_values(log: EventLog, spec: dict, filters: tuple[dict, ...] = ()) -> tuple[DataFrame, str]:
    """The filtered case table with value, and r and c for the spec's axes; and the metric's type."""
    cases, params, seg = Cases(log), spec.get("params", {}), spec.get("segment", {})
    metric = spec["metric"]
    value = F.lit(None).cast("double") if metric in SERIES else cases.value(metric, params)
    tests = [predicate(cases, f) for f in (*filters, *spec.get("filters", ()))]
    axes = {k: axis(cases, seg[n]) for k, n in (("r", "rows"), ("c", "cols")) if seg.get(n) and seg[n] != "activity"}
    t = cases.table()
    if tests:
        t = t.where(reduce(Column.__and__, tests))
    return t.select("case", "start_s", "end_s", value.alias("value"), *(c.alias(k) for k, c in axes.items())), result_type(metric, params)


def compute_widget(log: EventLog, spec: dict, filters: tuple[dict, ...] = ()) -> DataFrame:
    """A widget's rows: (r, c, value, n, state), r and c null for the overall figure; axes as the spec has them."""
    seg = spec.get("segment", {})
    if "activity" in (seg.get("rows"), seg.get("cols")):
        return activity_widget(log, spec, filters)
    t, kind = case_values(log, spec, filters)
    agg = "share" if kind == PERCENT else spec.get("agg", "avg")
    target = spec.get("target")
    if spec["metric"] in SERIES:
        points = series(t, spec["metric"])
        out = points.agg(aggregate(agg, F.col("value")).alias("value"), F.count("*").alias("n"))
    else:
        v = F.col("value")
        if target and target.get("per_case"):
            v, agg = F.when(v.isNotNull(), (state(v, target | {"warn": None}) == "met").cast("double")), "share"
        exact = kind == "time" and agg in ("avg", "sum")  # whole seconds add up alike in any order of rows
        out = grouped(t.withColumn("value", F.rint(v * (DAY * 1e6)) / 1e6 if exact else v), agg)
        out = out.withColumn("value", F.col("value") / DAY) if exact else out
    if target:
        goal = target if not target.get("per_case") else {"dir": "min", "value": target["per_case"], "warn": target.get("warn")}
        out = out.withColumn("state", state(F.col("value"), goal))
    return out


def grouped(t: DataFrame, agg: str) -> DataFrame:
    """Aggregates by the axes that t has, and overall, in one pass; cases without a label are in no group."""
    keys = [k for k in ("r", "c") if k in t.columns]
    value = [aggregate(agg, F.col("value")).alias("value"), F.count("value").alias("n")]
    if not keys:
        return t.agg(*value)
    out = t.groupingSets([[F.col(k) for k in keys], []], *(F.col(k) for k in keys)).agg(*value, F.grouping_id().alias("_g"))
    live = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    return out.where((F.col("_g") > 0) | live).where("_g > 0 OR n > 0").drop("_g")


def activity_widget(log: EventLog, spec: dict, filters: tuple[dict, ...] = ()) -> DataFrame:
    """The activity axis: the metric's parameter takes each activity in turn. One aggregate by case and activity.

    Counts are zero where a case lacks an activity: their sums need no rows for that, as the number of
    cases (per other label) is known.
    """
    metric, seg = spec["metric"], spec.get("segment", {})
    other = seg.get("cols") if seg.get("rows") == "activity" else seg.get("rows")
    base, _ = case_values(log, {**spec, "metric": "eventCount", "segment": {"cols": other} if other else {}}, filters)
    keys = ["c"] if other else []
    if other:
        base = base.where("c IS NOT NULL")
    e = log.events().join(base.select("case", *keys), "case")
    per = e.groupBy("case", "act", *keys).agg(
        F.count("*").cast("double").alias("n_act"),
        F.avg(F.col("end_s") - F.col("prev_end_s")).alias("sojourn"),
        F.avg(F.when(F.col("ok_start"), F.col("end_s") - F.col("own_start_s"))).alias("service"),
        F.avg(F.when(F.col("ok_start"), F.col("own_start_s") - F.col("prev_end_s"))).alias("waiting"),
    )
    n = F.col("n_act")
    v = {"actFreq": n, "actPresence": F.lit(1.0), "actRepeats": n - 1, "actRework": (n > 1).cast("double"), "actSojourn": F.col("sojourn") / 86400.0, "actService": F.col("service") / 86400.0, "actWaiting": F.col("waiting") / 86400.0}[metric]
    by = per.withColumn("value", v).groupBy(F.col("act").alias("r"), *keys)
    kind = CATALOG[metric][0]
    if metric in ("actFreq", "actPresence", "actRepeats"):
        total = base.groupBy(*keys).agg(F.count("*").alias("cases"))
        sums = by.agg(F.sum("value").alias("s"), F.count_if(F.col("value") != 0).alias("nz"))
        sums = sums.join(total, keys) if keys else sums.withColumn("cases", F.lit(total.first()["cases"]))
        value = 100.0 * F.col("nz") / F.col("cases") if kind == PERCENT else F.col("s") / F.col("cases")
        return sums.select("r", *keys, value.alias("value"), F.col("cases").alias("n"))
    return by.agg(aggregate("share" if kind == PERCENT else spec.get("agg", "avg"), F.col("value")).alias("value"), F.count("value").alias("n"))


def histogram(t: DataFrame) -> DataFrame:
    """(bin, lo, hi, n) of value: a bar per whole number if their span is at most 40, else 20 equal bins."""
    v = F.col("value")
    lo, hi, whole = t.agg(F.min(v), F.max(v), F.bool_and(v == F.floor(v))).first()
    if lo is None:
        return t.limit(0).select(F.lit(0).alias("bin"), v.alias("lo"), v.alias("hi"), F.lit(0).cast("long").alias("n"))
    bins, width = (int(hi - lo) + 1, 1.0) if whole and hi - lo <= INTEGER_SPAN else (1, 0.0) if hi == lo else (HISTOGRAM_BINS, (hi - lo) / HISTOGRAM_BINS)
    place = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    counts = t.where(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    spine = t.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(float(lo)) + (F.col("bin") + k) * width
    return spine.join(counts, "bin", "left").select("bin", edge(0).alias("lo"), edge(1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def box_plot(t: DataFrame) -> DataFrame:
    """One row: quartiles, whiskers (extreme values within 1.5 quartile ranges), outliers (at most 100) and their number."""
    v = F.col("value")
    q = t.agg(F.percentile(v, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).first()["q"]
    if not q:
        return t.limit(0).select(*(F.lit(0.0).alias(n) for n in ("q1", "median", "q3", "lo", "hi")), F.lit(0).cast("long").alias("n_out"))
    low, high = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
    inside = v.between(low, high)
    return t.agg(*(F.lit(x).alias(n) for n, x in zip(("q1", "median", "q3"), q, strict=True)), F.min(F.when(inside, v)).alias("lo"), F.max(F.when(inside, v)).alias("hi"), F.count_if(~inside).alias("n_out"))


def outliers(t: DataFrame, low: float, high: float) -> DataFrame:
    return t.where(~F.col("value").between(low, high)).orderBy("value", "case").limit(MAX_OUTLIERS)


def scorecard(log: EventLog, widgets: list[dict], filters: tuple[dict, ...] = ()) -> DataFrame:
    """A row per targeted widget: title, value, goal, state."""
    rows = []
    for w in widgets:
        if w.get("target"):
            kind = result_type(w["metric"], w.get("params", {}))
            one = compute_widget(log, {**w, "segment": {}}, filters)
            rows.append(one.select(F.lit(w["title"]).alias("title"), "value", F.lit(goal_text(w["target"], kind)).alias("goal"), "state"))
    return reduce(DataFrame.unionByName, rows)


def worst_state(states: Column) -> Column:
    """The worst of a group's states: missed before risk before met; null without one."""
    order = F.create_map(*(F.lit(x) for k, name in enumerate(STATES) for x in (name, k)))
    return F.element_at(F.array(*map(F.lit, STATES)), (F.max(F.element_at(order, states)) + 1).cast("int"))


def grid_cells(out: DataFrame) -> DataFrame:
    """A two-axis widget's cells, those without cases too: every live row with every live column."""
    cells = out.where("r IS NOT NULL AND c IS NOT NULL")
    cols = cells.agg(F.sort_array(F.collect_set("c")).alias("cols"))  # the labels of an axis
    spine = cells.select("r").distinct().join(F.broadcast(cols), F.lit(True)).select("r", F.explode("cols").alias("c"))
    return spine.join(cells, ["r", "c"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def weekday_cells(out: DataFrame, key: str = "r") -> DataFrame:
    """A weekday axis with all seven days, those without cases too."""
    days = out.sparkSession.createDataFrame([(d,) for d in WEEKDAYS], f"{key} string")
    return days.join(out, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bars(out: DataFrame, axis_name: str, key: str = "r", most: int = MAX_BARS) -> DataFrame:
    """The bars that are drawn: the largest of a categorical axis, all of a time axis."""
    live = out.where(F.col(key).isNotNull() & F.col("value").isNotNull())
    return live if axis_name in TIME_AXES else live.orderBy(F.desc("value"), key).limit(most)


def slices(out: DataFrame, key: str = "r", most: int = MAX_SLICES) -> DataFrame:
    """(label, value) of a pie: positive values, the largest of them, and Other for the rest if there are too many."""
    live = out.where(F.col(key).isNotNull() & (F.col("value") > 0)).select(F.col(key).alias("label"), "value")
    top = live.orderBy(F.desc("value"), "label").limit(most).collect()
    if len(top) < most or live.count() == most:
        return live
    kept = [r["label"] for r in top[: most - 1]]
    return live.groupBy(F.when(F.col("label").isin(kept), F.col("label")).otherwise("Other").alias("label")).agg(F.sum("value").alias("value"))


def viz_problem(spec: dict) -> str | None:
    """Why a widget cannot be drawn as its spec asks; None if it can."""
    viz, used = spec.get("viz", "kpi"), [a for a in spec.get("segment", {}).values() if a]
    over_time = spec["metric"] in SERIES
    if viz == "kpi":
        return "a figure has no axis" if used else None
    if viz == "gauge":
        return "a gauge has no axis" if used else None if spec.get("target") else "a gauge needs a target"
    if viz in ("hist", "box"):
        return "a distribution has no axis" if used else "a series has no distribution" if over_time else None
    if viz == "bar":
        return None if len(used) == 1 else "bars need one axis"
    if viz == "line":
        return None if over_time or len(used) == 1 and used[0] in TIME_AXES else "a line needs one time axis or a series"
    if viz == "pie":
        return "a pie needs one axis" if len(used) != 1 else None if spec.get("agg") == "sum" else "a pie needs sums"
    if viz == "table":
        return None if len(used) == 2 else "a table needs two axes"
    return f"unknown chart {viz!r}"
