"""Finding the case attributes of a table of events: which columns are constant within cases, and their kinds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Never attributes, and columns that name who rather than how much.
SKIPPED = ("concept:name", "case:concept:name", "time:timestamp", "timestamp", "start_timestamp", "AssignedTime")
IDENTIFIERS = ("org:resource", "org:group", "org:role", "concept:instance")
CONSTANT_SHARE = NUMERIC_SHARE = 0.99
MAX_ENUM, MAX_SCALE_DIGITS = 20, 6


@dataclass(frozen=True)
class Attribute:
    """kind is boolean, integer or enumeration; integers are values times scale; values maps raw values to their names."""

    source: str
    name: str
    kind: str
    scale: int = 1
    values: tuple[tuple[str, str], ...] = ()


def identifier(text: str, fallback: str = "attr") -> str:
    """A name of word characters that does not start with a digit."""
    name = re.sub(r"_+", "_", re.sub(r"\W", "_", text.removeprefix("case:"))).rstrip("_")
    if name.startswith("_") and not name[1:2].isdigit():
        name = name.lstrip("_")
    if not name:
        return fallback
    return f"_{name}" if name[0].isdigit() else name


def _names(raw: list[str]) -> tuple[tuple[str, str], ...]:
    """Raw values with distinct identifiers, _2, _3 and so on telling apart those that would be equal."""
    taken: dict[str, str] = {}
    for v in sorted(raw):
        base = identifier(v, "VAL")
        name, n = base, 2
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken[name] = v
    return tuple((v, name) for name, v in taken.items())


def as_boolean(c: Column) -> Column:
    """True, false or null, by spellings in any case."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "1.0"), True).when(t.isin("false", "0", "0.0"), False)


def as_number(c: Column) -> Column:
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def snapshot(df: DataFrame, case: str, seq: str, constant_share: float = CONSTANT_SHARE) -> DataFrame:
    """(case, columns): of each column constant in enough cases, the value of the case's first row by seq.

    One shuffle by case: a case holds one value if its least equals its greatest, nulls aside.
    """
    ok = [f.name for f in df.schema if f.name not in (*SKIPPED, case, seq) and isinstance(f.dataType, (T.StringType, T.BooleanType, T.NumericType))]
    if not ok:
        return df.select(F.col(case).cast("string").alias("case")).distinct()
    col = lambda n: F.col(f"`{n}`")
    aggs = [a for i, n in enumerate(ok) for a in (F.min_by(col(n), col(seq)).alias(f"v{i}"), F.coalesce(F.min(col(n)) == F.max(col(n)), F.lit(True)).cast("int").alias(f"k{i}"))]
    per = df.groupBy(col(case).cast("string").alias("case")).agg(*aggs).persist()
    shares = per.agg(*(F.avg(f"k{i}").alias(f"k{i}") for i in range(len(ok)))).first()
    kept = sorted((n, i) for i, n in enumerate(ok) if (shares[f"k{i}"] or 0) >= constant_share)
    return per.select("case", *(F.col(f"v{i}").alias(n) for n, i in kept))


def classify(cases: DataFrame, max_enum: int = MAX_ENUM, numeric_share: float = NUMERIC_SHARE) -> list[Attribute]:
    """The usable attributes by name; constants and strings of many values are left out.

    One pass over all columns: values are counted by (column, value) first, so that no column needs its own shuffle
    and the values of a wide column stay distributed. At most max_enum + 1 values a column reach the driver.
    """
    columns = sorted((f for f in cases.schema if f.name != "case"), key=lambda f: f.name)
    if not columns:
        return []
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{f.name}`").cast("string").alias("v")) for i, f in enumerate(columns))))
    counts = cases.select(pairs.alias("p")).select("p.*").where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
    x = as_number(F.col("v"))
    text = F.rtrim(F.format_string("%.10f", x), F.lit("0"))
    digits = F.when(x == F.floor(x), 0).otherwise(F.length(F.substring_index(text, ".", -1)))
    b = as_boolean(F.col("v"))
    rows = counts.groupBy("i").agg(
        F.count("*").alias("distinct"),
        F.sum("n").alias("n"),
        F.sum(F.when(x.isNotNull(), F.col("n"))).alias("numbers"),
        F.max(digits).alias("digits"),
        F.bool_and(b.isNotNull()).alias("boolean"),
        F.count_distinct(b).alias("truths"),
    )
    out: list[Attribute] = []
    wide = {f.name: isinstance(f.dataType, T.NumericType) for f in columns}
    for r in sorted(rows.collect(), key=lambda r: r["i"]):  # a row per column
        source = columns[r["i"]].name
        who = source.removeprefix("case:").strip().casefold() in IDENTIFIERS
        if r["distinct"] < 2:
            continue
        if r["boolean"] and r["truths"] == 2:
            out.append(Attribute(source, identifier(source), "boolean"))
        elif wide[source] or not who and (r["numbers"] or 0) >= numeric_share * r["n"]:
            out.append(Attribute(source, identifier(source), "integer", 10 ** min(r["digits"] or 0, MAX_SCALE_DIGITS)))
        elif r["distinct"] <= max_enum:
            out.append(Attribute(source, identifier(source), "enumeration"))
    enums = [n for n, f in enumerate(columns) if any(a.source == f.name and a.kind == "enumeration" for a in out)]
    if enums:
        values: dict[str, list[str]] = {}
        for r in counts.where(F.col("i").isin(enums)).select("i", "v").collect():  # at most max_enum values a column
            values.setdefault(columns[r["i"]].name, []).append(r["v"])
        out = [Attribute(a.source, a.name, a.kind, a.scale, _names(values[a.source])) if a.kind == "enumeration" else a for a in out]
    return out


def detect(df: DataFrame, case: str, seq: str, max_enum: int = MAX_ENUM) -> tuple[DataFrame, list[Attribute]]:
    """The cases with their raw attributes, and what each attribute is."""
    cases = snapshot(df, case, seq)
    found = classify(cases, max_enum)
    return cases.select("case", *(F.col(f"`{a.source}`") for a in found)), found


def encoded(cases: DataFrame, attributes: list[Attribute]) -> tuple[DataFrame, list[tuple[str, Attribute, str | None]]]:
    """(case, f0, f1, ...) as numbers, 0 where missing, and of each feature its attribute and, if one-hot, its value's name."""
    features: list[tuple[str, Attribute, str | None]] = []
    cols: list[Column] = []
    for a in attributes:
        c = F.col(f"`{a.source}`")
        if a.kind == "enumeration":
            parts = [((c.cast("string") == raw).cast("double"), name) for raw, name in a.values]
        elif a.kind == "boolean":
            parts = [(as_boolean(c).cast("double"), None)]
        else:
            parts = [(F.round(as_number(c) * a.scale), None)]
        for x, value in parts:
            cols.append(F.coalesce(x, F.lit(0.0)).alias(f"f{len(features)}"))
            features.append((f"f{len(features)}", a, value))
    return cases.select("case", *cols), features


def representatives(cases: DataFrame, variants: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """(variant, attribute, value): the commonest value of an enumeration or boolean, the scaled median of a number.

    Ties go to the value that sorts first. variants is (case, variant); nulls do not count, and an attribute without
    values in a variant has no row.
    """
    t = variants.select("case", "variant").join(cases, "case")
    out = []
    for a in attributes:
        c = F.col(f"`{a.source}`")
        if a.kind == "integer":
            x = as_number(c)
            v = t.where(x.isNotNull()).groupBy("variant").agg(F.bround(F.percentile(x, 0.5) * a.scale).cast("long").cast("string").alias("value"))
        else:
            names = reduce(lambda e, p: e.when(c.cast("string") == p[0], p[1]), a.values[1:], F.when(c.cast("string") == a.values[0][0], a.values[0][1])) if a.values else as_boolean(c).cast("string")
            n = t.select("variant", names.alias("value")).where("value IS NOT NULL").groupBy("variant", "value").agg(F.count("*").alias("n"))
            v = n.groupBy("variant").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
        out.append(v.select("variant", F.lit(a.name).alias("attribute"), "value"))
    if not out:
        return t.select("variant", F.lit("").alias("attribute"), F.lit("").alias("value")).limit(0)
    return reduce(DataFrame.unionByName, out)
