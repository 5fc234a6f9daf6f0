"""Event logs from CSV, Parquet and XES files."""

from __future__ import annotations

import csv
import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..log import EventLog

#: The delimiters tried.
DELIMITERS = (",", ";", "\t", "|")


class LogError(ValueError):
    pass


def _head(spark: SparkSession, path: str, size: int) -> bytes | None:
    """The first bytes of a path's first file, in whatever store it is; no more of it is read."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(context._jsc.hadoopConfiguration())
    files = []
    for found in store.globStatus(place) or ():
        inside = store.listStatus(found.getPath()) if found.isDirectory() else [found]
        files += [x.getPath() for x in inside if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    if not files:
        return None
    stream = store.open(min(files, key=lambda p: p.toString()))
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(delimiter, encoding) from the first 64 KB of the path's first file."""
    raw, encoding = _head(spark, path, 65536), "UTF-8"
    if raw is None:
        raise LogError(f"no file at {path}")
    try:
        text = raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(raw) - 4:  # not only a character cut by the end
            encoding = "windows-1252"
        text = raw.decode("cp1252", "replace")
    lines = [x for x in text.splitlines() if x.strip()][:20]
    counts = {d: Counter(x.count(d) for x in lines).most_common(1)[0] if lines else (0, 0) for d in DELIMITERS}
    return max(DELIMITERS, key=lambda d: (counts[d][0] > 0, counts[d][1], counts[d][0])), encoding


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    sep, encoding = sniff(spark, path)
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=False, quote='"', escape='"')


def parse_time(text, day_first: bool = False) -> Column:
    """A timestamp from text: ISO 8601 first, then the usual day and month orders; null if none fits."""
    day, month = ("dd/MM/yyyy", "MM/dd/yyyy") if day_first else ("MM/dd/yyyy", "dd/MM/yyyy")
    formats = [f"{d}{t}" for d in (day, month, "dd.MM.yyyy", "yyyy/MM/dd") for t in (" HH:mm:ss", " HH:mm", "")]
    return F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def parse_epoch(number, largest) -> Column:
    """A timestamp from a count since 1970, its unit told by the column's largest magnitude."""
    n = number.cast("double")
    micros = F.when(largest < 1e11, n * 1e6).when(largest < 1e14, n * 1e3).when(largest < 1e17, n).otherwise(n / 1e3)
    return F.timestamp_micros(micros.cast("long"))


def day_first_ambiguous(df: DataFrame, column: str) -> bool:
    """Whether reading the day first or the month first gives different times."""
    a, b = parse_time(F.col(column)), parse_time(F.col(column), True)
    return bool(df.agg(F.bool_or(a != b)).first()[0])


def late_starts(df: DataFrame, start: str, ts: str) -> tuple[int, int]:
    """(starts after their completion, pairs checked)."""
    both = F.col(start).isNotNull() & F.col(ts).isNotNull()
    return tuple(df.agg(F.count_if(both & (F.col(start) > F.col(ts))), F.count_if(both)).first())


def map_columns(df: DataFrame, case: str, act: str, ts: str, start: str | None = None, res: str | None = None, attrs: tuple[str, ...] = (), day_first: bool = False) -> EventLog:
    """An event log of a raw table; raises if under half of the times parse or most starts are after completion."""
    kinds = dict(df.dtypes)

    def time(c: str) -> Column:
        if kinds[c].startswith("timestamp") or kinds[c] == "date":
            return F.col(c).cast("timestamp")
        if kinds[c] in ("string",):
            return parse_time(F.col(c), day_first)
        return parse_epoch(F.col(c), F.lit(float(df.agg(F.max(F.abs(F.col(c)))).first()[0] or 0)))

    out = df.withColumn("_ts", time(ts)).withColumn("_seq", F.monotonically_increasing_id())
    if start:
        out = out.withColumn("_start", time(start))
    share = out.agg(F.avg(F.col("_ts").isNotNull().cast("int")), *([F.avg(F.col("_start").isNotNull().cast("int")), F.avg((F.col("_start") > F.col("_ts")).cast("int"))] if start else [])).first()
    if (share[0] or 0) < 0.5:
        raise LogError(f"under half of {ts} can be read as times")
    if start and (share[1] or 0) < 0.5:
        raise LogError(f"under half of {start} can be read as times")
    if start and (share[2] or 0) > 0.5:
        raise LogError(f"most of {start} are after {ts}; the two may be swapped")
    first = Window.partitionBy("case").orderBy("_seq")
    rows = None
    if attrs:  # a case's attributes are those of its first row
        rows = out.select(F.col(case).cast("string").alias("case"), "_seq", *attrs).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_seq")
    return EventLog.of(out, F.col(case), F.col(act), F.col("_ts"), F.col("_seq"), start=F.col("_start") if start else None, res=F.col(res) if res else None, attrs=rows)


#: The element names of XES attributes and the types they hold.
XES_KINDS = {"string": "string", "date": "timestamp", "int": "long", "float": "double", "boolean": "boolean"}
_ITEM = "array<struct<_key:string,_value:string>>"
_TRACE = ", ".join(f"{k} {_ITEM}" for k in XES_KINDS) + f", event array<struct<{','.join(f'{k}:{_ITEM}' for k in XES_KINDS)}>>"


def _unzipped(batches):
    """The traces of the XES files in zip archives, a row of XML text each."""
    import io
    import re
    import zipfile

    import pyarrow as pa

    one = re.compile(r"<trace\b.*?</trace\s*>", re.S)
    for rows in batches:
        for data in rows[0].to_pylist():
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in z.namelist():
                    if name.lower().endswith((".xes", ".xml")):
                        found = one.findall(z.read(name).decode("utf-8", "replace"))
                        for i in range(0, len(found), 1000):
                            yield pa.RecordBatch.from_pydict({"x": found[i : i + 1000]})


def read_xes(spark: SparkSession, path: str, attributes: tuple[str, ...] | None = None) -> EventLog:
    """An XES log, plain, .gz or .zip: events of each trace with concept:name, time:timestamp, start_timestamp and
    org:resource, and the traces' own attributes of any kind (those named, or all that some trace has)."""
    if path.lower().endswith(".zip"):
        raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unzipped, "x string")
        t = raw.select(F.from_xml("x", _TRACE).alias("t")).select("t.*")
    else:
        t = spark.read.format("xml").option("rowTag", "trace").schema(_TRACE).load(path)
    t = t.withColumn("n", F.monotonically_increasing_id())
    pick = lambda xs, key: F.get(F.transform(F.filter(xs, lambda x: x["_key"] == key), lambda x: x["_value"]), F.lit(0))
    case = F.coalesce(pick(F.col("string"), "concept:name"), F.col("n").cast("string"))
    e = t.select(case.alias("c"), "n", F.posexplode("event").alias("pos", "e"))
    own = lambda k, key: pick(F.col(f"e.{k}"), key)
    times = {k: F.try_to_timestamp(own("date", k)) for k in ("time:timestamp", "start_timestamp")}
    starts = not t.where(F.exists("event", lambda x: F.exists(x["date"], lambda d: d["_key"] == "start_timestamp"))).isEmpty()
    keys = {(k, r["key"]) for k in XES_KINDS for r in t.select(F.explode(F.col(f"{k}._key")).alias("key")).distinct().collect()}  # the names of attributes
    chosen = sorted((k, key) for k, key in keys if key != "concept:name" and (attributes is None or key in attributes))
    attrs, numeric = None, []
    if chosen:
        columns = []
        for k, key in chosen:
            value = pick(F.col(k), key)
            columns.append((F.try_to_timestamp(value) if k == "date" else value.try_cast(XES_KINDS[k])).alias(key))
            numeric += [key] if k in ("int", "float") else []
        attrs = t.select(case.alias("case"), *columns).dropDuplicates(["case"])
    return EventLog.of(
        e, F.col("c"), own("string", "concept:name"), times["time:timestamp"], F.struct("n", "pos"),
        start=times["start_timestamp"] if starts else None, res=own("string", "org:resource"), attrs=attrs, numeric=numeric,
    )


def check_mapping(df: DataFrame, case: str, act: str, ts: str, start: str | None = None, rows: int = 5000, day_first: bool = False) -> list[str]:
    """What is wrong with a column mapping, by the table's first rows; empty if nothing is."""
    names = [c for c in (case, act, ts, start) if c]
    if missing := [c for c in names if c not in df.columns]:
        return [f"no column {c!r}" for c in missing]
    problems = [f"column {c!r} is mapped twice" for c, n in Counter(names).items() if n > 1]
    head, kinds = df.select(*dict.fromkeys(names)).limit(rows), dict(df.dtypes)
    known = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    readable = lambda c: known(c) if kinds[c] != "string" else F.avg(parse_time(F.col(c), day_first).isNotNull().cast("int"))
    r = head.agg(F.count("*").alias("n"), known(case).alias("case"), known(act).alias("act"), F.count_distinct(case).alias("cases"), readable(ts).alias("ts"), *([readable(start).alias("start")] if start else [])).first()
    if not r["n"]:
        return [*problems, "the table is empty"]
    problems += [f"{c!r} is empty in some rows" for c, k in ((case, "case"), (act, "act")) if r[k] < 1]
    problems += [f"under half of {c!r} can be read as times" for c, k in ((ts, "ts"), (start, "start")) if c and r[k] < 0.5]
    return [*problems, "every row is a case of its own"] if r["n"] > 1 and r["cases"] == r["n"] else problems


def dropped_events(df: DataFrame, ts: str, day_first: bool = False) -> int:
    """Rows whose completion cannot be read, which the log leaves out."""
    time = parse_time(F.col(ts), day_first) if dict(df.dtypes)[ts] == "string" else F.col(ts)
    return df.where(time.isNull()).count()


def sample_cases(log: EventLog, most: int = 40_000, seed: int = 42) -> tuple[EventLog, int]:
    """At most so many cases of a log, chosen by a hash, and how many it has in all; a smaller log is left as it is."""
    cases = log.df.select("case").distinct()
    n = cases.count()
    if n <= most:
        return log, n
    drawn = cases.withColumn("draw", F.xxhash64(F.lit(seed), "case"))
    low = F.pmod("draw", F.lit(1 << 20)) < min(1 << 20, ((most + 4 * math.isqrt(most) + 16) << 20) // n + 1)
    return log.keep_cases(drawn.where(low).orderBy(F.pmod("draw", F.lit(1 << 20)), "draw", "case").limit(most)), n


def rename_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Old to new activity names from a JSON object or a CSV of two columns with a header; a small file."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect()).removeprefix("\ufeff")
    if text.lstrip().startswith("{"):
        found = json.loads(text)
        if not all(isinstance(v, str) for v in found.values()):
            raise LogError("a rename map takes names to names")
        return found
    rows = [r for r in csv.reader(text.splitlines()) if r]
    if any(len(r) < 2 for r in rows):
        raise LogError("a rename map has two columns")
    return {a.strip(): b.strip() for a, b, *_ in rows[1:] if a.strip() and b.strip()}


def write_csv(log: EventLog, path: str) -> None:
    """A log as CSV with its cases' attributes, in the order of cases and events."""
    order = ["case", "ts", "seq"]
    log.with_attrs(log.df).orderBy(*order).drop("seq").write.csv(path, header=True)


def write_xes(log: EventLog, path: str) -> None:
    """A log as XES: a folder of files, each a whole document of some of the traces."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    line = lambda kind, key, c: F.when(c.isNotNull(), F.concat(F.lit(f'<{kind} key="{key}" value="'), quoted(c), F.lit('"/>'))).otherwise("")
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    parts = [line("string", "concept:name", F.col("act")), line("date", "time:timestamp", time(F.col("ts")))]
    parts += [line("date", "start_timestamp", time(F.col("start_ts")))] if log.interval else []
    parts += [line("string", "org:resource", F.col("res"))] if "res" in log.df.columns else []
    events = log.df.select("case", F.struct("ts", "seq", F.concat(F.lit("<event>"), *parts, F.lit("</event>")).alias("x")).alias("e"))
    traces = log.with_attrs(events.groupBy("case").agg(F.array_join(F.sort_array(F.collect_list("e"))["x"], "").alias("_events")))
    kinds = {"string": "string", "boolean": "boolean", "double": "float", "float": "float", "bigint": "int", "int": "int", "timestamp": "date"}
    own = []
    for name, kind in (log.attrs.dtypes if log.attrs is not None else ()):
        if name != "case":
            value = F.col(f"`{name}`")
            own.append(line(kinds.get(kind, "string"), name, time(value) if kind == "timestamp" else value))
    text = F.concat(F.lit("<trace>"), line("string", "concept:name", F.col("case")), *own, F.col("_events"), F.lit("</trace>"))

    def documents(batches):
        import pyarrow as pa

        begun = False
        for rows in batches:
            if rows.num_rows:
                head = [] if begun else ['<?xml version="1.0" encoding="UTF-8"?><log xes.version="1.0">']
                begun = True
                yield pa.RecordBatch.from_pydict({"value": [*head, *rows[0].to_pylist()]})
        if begun:
            yield pa.RecordBatch.from_pydict({"value": ["</log>"]})

    traces.select(text.alias("value")).mapInArrow(documents, "value string").write.text(path)
