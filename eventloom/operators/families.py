"""Partitioning cases by attributes, comparing the cells, and ranking attributes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog
from .performance import activity_stats, pair_stats, time_stats
from .variants import case_variants

UNKNOWN, OTHER = "Unknown", "Other"


def folded(c: Column) -> Column:
    """Text without case: as Unicode's folding has it for sharp s, long s and final sigma too."""
    return F.translate(F.lower(F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))), "ςſ", "σs")


def enum_axis(cases: DataFrame, name: str, max_values: int = 12, ignore_case: bool = True) -> DataFrame:
    """(value, label, position) of an attribute's values: spellings merged, all but the commonest max_values - 1 in Other."""
    v = cases.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
    v = v.withColumn("key", folded(F.col("value")) if ignore_case else F.col("value"))
    spelled = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    v = v.withColumn("label", F.first("value").over(spelled)).withColumn("total", F.sum("n").over(Window.partitionBy("key")))
    v = v.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("total"), "label")))
    many = F.max("rank").over(Window.partitionBy()) > max_values
    rest = many & (F.col("rank") >= max_values)
    return v.select("value", F.when(rest, OTHER).otherwise(F.col("label")).alias("label"), F.when(rest, max_values).otherwise(F.col("rank")).alias("position"))


def bin_edges(cases: DataFrame, name: str, bins: int = 4, most_discrete: int | None = None) -> list[float]:
    """Edges of a numeric attribute: one bin per whole number if there are few, else quantiles without repeats."""
    c = F.col(name)
    few = bins if most_discrete is None else most_discrete
    row = cases.agg(F.percentile(c, F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("q"), F.bool_and(c == F.floor(c)).alias("whole"), F.count_distinct(c).alias("n")).first()
    if not row["q"]:
        return []
    if row["whole"] and row["n"] <= few:
        values = sorted(r[0] for r in cases.select(name).where(c.isNotNull()).distinct().collect())  # at most ``few`` rows
        return [*values, values[-1] + 1]
    return sorted(set(row["q"]))


def bin_index(c: Column, edges: list[float]) -> Column:
    """Which [lo, hi) holds c, the last closed; null outside."""
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1])) if len(edges) > 2 else F.expr("cast(array() as array<double>)")
    return F.when(c.between(edges[0], edges[-1]), F.size(F.filter(inner, lambda e: e <= c)))


def _number(x: float) -> str:
    return f"{x:g}"


def numeric_axis(cases: DataFrame, name: str, bins: int = 4, edges: list[float] | None = None) -> tuple[Column, Column]:
    """(label, position) columns."""
    own = edges or bin_edges(cases, name, bins)
    if edges is not None and (len(edges) < 2 or list(edges) != sorted(set(edges))):
        raise ValueError("edges must ascend")
    if len(own) < 2:
        one = F.when(F.col(name).isNotNull(), F.lit(_number(own[0]) if own else ""))
        return one, F.lit(1)
    discrete = edges is None and all(b - a == 1 and a == int(a) for a, b in zip(own, own[1:], strict=False))
    labels = [_number(a) if discrete else f"{_number(a)}-{_number(b)}" for a, b in zip(own, own[1:], strict=False)]
    i = bin_index(F.col(name), own)
    return F.get(F.array(*map(F.lit, labels)), i), i + 1


def assign(
    log: EventLog,
    attributes: list[str],
    max_values: int = 12,
    bins: int = 4,
    unknown: bool = True,
    other: bool = True,
    edges: dict[str, list[float]] | None = None,
    include: dict[str, list[str]] | None = None,
    ignore_case: bool = True,
) -> DataFrame:
    """(case, axis1[, axis2], pos1[, pos2]): the labels of every case; null where it is dropped.

    other: whether rare values share a bucket or drop their cases; unknown: whether missing values have one;
    edges: ranges of numeric attributes in place of quantiles; include: the labels that are kept of an axis.
    """
    if not 1 <= len(attributes) <= 2:
        raise ValueError("one or two attributes partition a log")
    t = log.df.select("case").distinct().join(log.attrs, "case", "left")
    kinds = dict(t.dtypes)
    out = t
    for i, name in enumerate(attributes, 1):
        if name not in kinds or name == "case":
            raise ValueError(f"no attribute {name!r}")
        if name in log.numeric:
            label, place = numeric_axis(t, name, bins, (edges or {}).get(name))
        elif kinds[name] == "boolean":
            label, place = F.col(name).cast("string"), F.when(F.col(name), 1).otherwise(2)
        else:
            values = enum_axis(t, name, max_values, ignore_case)
            values = values.select(F.col("value").alias(name), F.col("label").alias(f"_l{i}"), F.col("position").alias(f"_p{i}"))
            out = out.join(values, name, "left")  # a row per value: AQE broadcasts it if small
            label, place = F.col(f"_l{i}"), F.col(f"_p{i}")
            label = label if other else F.when(label != OTHER, label)
        missing = F.col(name).isNull() | (label.isNull() if name in log.numeric else F.lit(False))
        label = F.when(missing & F.lit(unknown), UNKNOWN).otherwise(label)
        if include and name in include:
            same = folded if ignore_case else lambda c: c
            wanted = [same(F.lit(str(x))) for x in include[name]]
            label = F.when(same(label).isin(wanted), label)
        out = out.withColumn(f"axis{i}", label).withColumn(f"pos{i}", F.when(F.col(f"axis{i}") == UNKNOWN, 1 << 30).otherwise(place).cast("int"))
    names = range(1, len(attributes) + 1)
    out = out.select("case", *(f"axis{i}" for i in names), *(f"pos{i}" for i in names))
    for i in names if include else ():
        if attributes[i - 1] in include and out.where(F.col(f"axis{i}").isNotNull()).isEmpty():
            raise ValueError(f"no value of {attributes[i - 1]!r} is left")
    return out


def _axes(cells: DataFrame) -> list[str]:
    return [c for c in cells.columns if c.startswith("axis")]


def cells_of(assigned: DataFrame, min_cases: int = 0) -> DataFrame:
    """(axes, positions, n, skipped), a row per cell in the order of its axes; skipped: under min_cases."""
    axes = _axes(assigned)
    places = [c for c in assigned.columns if c.startswith("pos")]
    live = assigned.where(reduce(Column.__and__, (F.col(a).isNotNull() for a in axes)))
    return live.groupBy(*axes).agg(*(F.min(p).alias(p) for p in places), F.count("*").alias("n")).withColumn("skipped", F.col("n") < min_cases)


def dropped_cases(assigned: DataFrame) -> int:
    return assigned.where(reduce(Column.__or__, (F.col(a).isNull() for a in _axes(assigned)))).count()


def partition(log: EventLog, attributes: list[str], min_cases: int = 0, max_values: int = 12, bins: int = 4, unknown: bool = True, **options) -> DataFrame:
    """(case, axis1[, axis2], cell_cases): the cell of every case of a cell with at least min_cases."""
    out = assign(log, attributes, max_values, bins, unknown, **options)
    cells = cells_of(out, min_cases).where("NOT skipped").withColumnRenamed("n", "cell_cases")
    axes = _axes(out)
    return out.select("case", *axes).join(cells.select(*axes, "cell_cases"), axes)


def coverage_preview(assigned: DataFrame, min_cases: int = 0) -> DataFrame:
    """Case counts by the first axis, a column per value of the second; without a second one, a column n."""
    cells = cells_of(assigned, min_cases)
    if "axis2" not in cells.columns:
        return cells.select("axis1", "n", "skipped")
    return cells.groupBy("axis1").pivot("axis2").agg(F.first("n"))


def grid(cells: DataFrame) -> DataFrame:
    axes = [c for c in cells.columns if c.startswith("axis")]
    return cells.groupBy(*axes).agg(F.count("*").alias("n"))


def family_process(log: EventLog, cells: DataFrame) -> DataFrame:
    """Per cell: cases, events per case, durations and rework."""
    axes = [c for c in cells.columns if c.startswith("axis")]
    per = log.events().groupBy("case").agg(F.count("*").alias("n"), F.count_distinct("act").alias("acts"), (F.max("end_s") - F.min("start_s")).alias("s"))
    t = per.join(cells.select("case", *axes), "case")
    return t.groupBy(*axes).agg(F.count("*").alias("cases"), F.avg("n").alias("events_mean"), F.percentile("n", 0.5).alias("events_median"), F.min("n").alias("events_min"), F.max("n").alias("events_max"), *time_stats(F.col("s"), "duration_"), F.avg((F.col("n") > F.col("acts")).cast("double")).alias("rework_fraction"), F.avg((F.col("n") - F.col("acts")).cast("double")).alias("mean_repeats"))


def family_activities(log: EventLog, cells: DataFrame) -> DataFrame:
    axes = tuple(c for c in cells.columns if c.startswith("axis"))
    return activity_stats(log.events().join(cells.select("case", *axes), "case"), axes)


def family_edges(log: EventLog, cells: DataFrame) -> DataFrame:
    axes = tuple(c for c in cells.columns if c.startswith("axis"))
    return pair_stats(log.events().join(cells.select("case", *axes), "case"), axes)


def mutual_information(t: DataFrame, a: str, v: str) -> DataFrame:
    """One row nmi: I(a; v) / min(H(a), H(v)) in nats over rows with both, clipped to [0, 1]; 0 if degenerate."""
    n = t.where(F.col(a).isNotNull() & F.col(v).isNotNull()).groupBy(a, v).agg(F.count("*").cast("double").alias("n"))
    n = n.withColumn("na", F.sum("n").over(Window.partitionBy(a))).withColumn("nv", F.sum("n").over(Window.partitionBy(v))).withColumn("t", F.sum("n").over(Window.partitionBy()))
    p, pa, pv = F.col("n") / F.col("t"), F.col("na") / F.col("t"), F.col("nv") / F.col("t")
    s = n.agg(F.sum(p * F.log(p / (pa * pv))).alias("i"), (-F.sum(p * F.log(pa))).alias("ha"), (-F.sum(p * F.log(pv))).alias("hv"))
    least = F.least("ha", "hv")
    return s.select(F.when(least > 1e-12, F.least(F.greatest(F.col("i") / least, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("nmi"))


def eta_squared(t: DataFrame, g: str, v: str) -> DataFrame:
    """One row eta: between-group share of the variance of v; 0 if degenerate."""
    rows = t.where(F.col(g).isNotNull() & F.col(v).isNotNull())
    per = rows.groupBy(g).agg(F.count("*").alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count("*")).alias("w"))
    s = per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("w").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = F.greatest(F.col("sq") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return s.select(F.when(between + F.col("within") > 0, between / (between + F.col("within"))).otherwise(0.0).alias("eta"))


def bucket(t: DataFrame, name: str, numeric: bool, top: int = 8) -> DataFrame:
    """t with b: the attribute's value if it is among the commonest, or its quantile bin."""
    if numeric:
        edges = bin_edges(t, name, 4, most_discrete=10)
        return t.withColumn("b", bin_index(F.col(name), edges).cast("string") if len(edges) > 1 else F.lit("0"))
    v = t.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n")).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_n"), name)))
    return t.join(v, name, "left").withColumn("b", F.when(F.col("_r") <= top, F.col(name).cast("string")).when(F.col(name).isNotNull(), OTHER)).drop("_n", "_r")


def rank_attributes(log: EventLog, top_variants: int = 30) -> DataFrame:
    """(attribute, nmi, eta, score) by descending score: 0.6 nmi with the variant plus 0.4 eta of the duration,
    a quarter of it for attributes with a value per case or nearly one value."""
    traces, v = case_variants(log)
    code = traces.join(v.select("trace", F.least("rank", F.lit(top_variants + 1)).alias("variant")), "trace").select("case", "variant")
    times = log.events().groupBy("case").agg((F.max("end_s") - F.min("start_s")).cast("double").alias("seconds"))
    t = code.join(times, "case").join(log.attrs, "case", "left").persist()
    rows = []
    for name in [c for c in log.attrs.columns if c != "case"]:
        b = bucket(t, name, name in log.numeric)
        shape = t.agg(F.count_distinct(name).alias("d"), F.count(name).alias("n")).first()
        top = t.where(F.col(name).isNotNull()).groupBy(name).count().agg(F.max("count")).first()[0] or 0
        if not shape["n"] or shape["d"] < 2:
            continue  # constant
        flagged = name not in log.numeric and shape["d"] > 0.5 * shape["n"] or top > 0.98 * shape["n"]
        nmi, eta = mutual_information(b, "b", "variant").first()[0], eta_squared(b, "b", "seconds").first()[0]
        rows.append((name, round(nmi, 4), round(eta, 4), round((0.6 * nmi + 0.4 * eta) * (0.25 if flagged else 1.0), 4)))
    t.unpersist()
    return log.df.sparkSession.createDataFrame(rows, "attribute string, nmi double, eta double, score double").orderBy(F.desc("score"), "attribute")


def cell_label(axes: list[str]) -> Column:
    return F.concat_ws(" / ", *axes)


class Tables(Mapping):
    """Tables by name, each made when it is first asked for: what nobody reads costs nothing."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __contains__(self, name: object) -> bool:
        return name in self.makers

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def family_stats(log: EventLog, attributes: list[str], min_cases: int = 0, **options) -> Mapping[str, DataFrame]:
    """The statistics of a family of logs: process, ends, activity, edges, choices, skipped, and one row of totals."""
    from . import skeleton

    assigned = assign(log, attributes, **options).persist()
    axes = _axes(assigned)
    every = cells_of(assigned, min_cases).persist()
    cells = assigned.select("case", *axes).join(every.where("NOT skipped").select(*axes, F.col("n").alias("cell_cases")), axes)

    def totals() -> DataFrame:
        t = every.agg(F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("n"))), F.lit(0)).alias("covered"), F.coalesce(F.sum(F.when(F.col("skipped"), F.col("n"))), F.lit(0)).alias("skipped"))
        return t.withColumn("dropped", F.lit(dropped_cases(assigned))).withColumn("total", F.col("covered") + F.col("skipped") + F.col("dropped"))

    return Tables(
        {
            "process": lambda: process_frame(log, cells),
            "ends": lambda: family_ends(log, cells),
            "activity": lambda: family_activities(log, cells).withColumn("cell", cell_label(axes)).persist(),
            "edges": lambda: family_edges(log, cells).withColumn("cell", cell_label(axes)).persist(),  # small, and read several times by the frames
            "choices": lambda: skeleton.family_choices(log, cells)[0].withColumn("cell", cell_label(axes)).persist(),
            "skipped": lambda: every.where("skipped").select(*axes, "n"),
            "totals": totals,
        }
    )


def family_ends(log: EventLog, cells: DataFrame) -> DataFrame:
    """(axes, act, starts, ends): the activities that the cases of a cell start and end with."""
    axes = _axes(cells)
    order = F.struct("ts", "seq")
    ends = log.df.groupBy("case").agg(F.min_by("act", order).alias("first"), F.max_by("act", order).alias("last")).join(cells.select("case", *axes), "case")
    both = ends.select(*axes, F.explode(F.array(F.struct(F.col("first").alias("act"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("last").alias("act"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x"))
    return both.groupBy(*axes, F.col("x.act").alias("act")).agg(F.sum("x.s").alias("starts"), F.sum("x.e").alias("ends"))


def process_frame(log: EventLog, cells: DataFrame) -> DataFrame:
    """A row per cell: cases and their share, events, activities, events per case, durations in seconds, rework, variants."""
    axes = _axes(cells)
    base = family_process(log, cells)
    total = log.df.agg(F.count_distinct("case")).first()[0]
    e = log.df.join(cells.select("case", *axes), "case")
    sizes = e.groupBy(*axes, "act").agg(F.count("*").alias("n")).groupBy(*axes).agg(F.sum("n").alias("events"), F.count("*").alias("activities"))
    traces = log.traces().join(cells.select("case", *axes), "case").select(*axes, "trace").distinct().groupBy(*axes).agg(F.count("*").alias("sequence_variants"))
    out = base.join(sizes, axes).join(traces, axes)
    return out.withColumn("coverage_pct", F.round(100.0 * F.col("cases") / total, 1)).withColumn("cell", cell_label(axes))


def _matrix(stats: DataFrame, rows: list[str], metric: str) -> DataFrame:
    return stats.groupBy(*rows).pivot("cell").agg(F.first(metric))


def activity_frame(stats: Mapping[str, DataFrame], metric: str = "frequency") -> DataFrame:
    """Activities by cells of one metric."""
    return _matrix(stats["activity"], ["act"], metric).orderBy("act")


def edge_order(edges: DataFrame) -> DataFrame:
    """(a, b, total, place): the family's steps, the most frequent first, equals by their text."""
    text = F.concat(F.col("a"), F.lit(" → "), F.col("b"))
    total = edges.groupBy("a", "b").agg(F.sum("frequency").alias("total"))  # pairs of an alphabet
    return total.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), text)))


def edge_frame(stats: Mapping[str, DataFrame], metric: str = "frequency") -> DataFrame:
    """Steps by cells of one metric, in their family-wide order."""
    return _matrix(stats["edges"], ["a", "b"], metric).join(edge_order(stats["edges"]), ["a", "b"]).orderBy("place").drop("total", "place")


def choice_count_frame(stats: Mapping[str, DataFrame], choice: int) -> DataFrame:
    """Cells by branches of one choice: how often each is taken, null where the cell never comes to it."""
    return stats["choices"].where(F.col("choice") == choice).groupBy("cell").pivot("label").agg(F.first("n"))


def choice_share_frame(stats: Mapping[str, DataFrame], choice: int) -> DataFrame:
    """Cells by branches of one choice, in percent."""
    own = stats["choices"].where(F.col("choice") == choice)
    return own.groupBy("cell").pivot("label").agg(F.first(F.when(F.col("share").isNotNull(), 100.0 * F.col("share"))))


def resource_params(log: EventLog, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(axes, act, performer), the commonest of a cell; and (axes, res) of a cell's resources that perform nothing there."""
    axes = _axes(cells)
    seen = log.df.where("res IS NOT NULL AND res <> ''").join(cells.select("case", *axes), "case")
    counts = seen.groupBy(*axes, "act", "res").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*axes, "act").orderBy(F.desc("n"), "res")
    performers = counts.withColumn("k", F.row_number().over(own)).where("k = 1").select(*axes, "act", F.col("res").alias("performer"))
    extra = counts.select(*axes, "res").distinct().join(performers.withColumnRenamed("performer", "res"), [*axes, "res"], "left_anti")
    return performers, extra
