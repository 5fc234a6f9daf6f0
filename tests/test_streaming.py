"""Streams read from files, to their end: the same counts as over the table."""

import datetime as dt

import pytest

from eventloom.functions import formula
from eventloom.operators import metrics
from eventloom.streaming import incremental

SCHEMA = "case string, act string, ts timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    begin = dt.datetime(2025, 1, 1)
    rows = [(f"c{i % 5}", "ab"[i % 2], begin + dt.timedelta(minutes=20 * i)) for i in range(30)]
    rows.append(("late", "a", begin - dt.timedelta(days=9)))
    path = str(tmp_path_factory.mktemp("stream") / "in")
    spark.createDataFrame(rows[:30], SCHEMA).coalesce(1).write.parquet(path)
    spark.createDataFrame(rows[30:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, rows[:30]


def drained(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_activity_counts(spark, folder, tmp_path):
    path, rows = folder
    got = drained(spark, incremental.activity_counts(spark.readStream.schema(SCHEMA).parquet(path)), tmp_path, "counts")
    found = {(r["from"], r["act"]): (r["events"], r["cases"]) for r in got if r["from"].year == 2025}
    want = {}
    for c, a, t in rows:
        want.setdefault((t.replace(minute=0), a), []).append(c)
    assert found == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_sessions(spark, folder, tmp_path):
    path, rows = folder
    got = drained(spark, incremental.arrivals(spark.readStream.schema(SCHEMA).parquet(path), gap="2 hours"), tmp_path, "sessions")
    assert sum(r["events"] for r in got if r["case"] != "late") == len(rows) and len([r for r in got if r["case"] == "c0"]) == 1


def test_catalog_and_names(spark, folder):
    from pyspark.sql import functions as F

    from eventloom.log import EventLog

    log = EventLog.of(spark.read.parquet(folder[0]), F.col("case"), F.col("act"), F.col("ts"), F.col("ts"))
    entries = {e["metric"]: e for e in metrics.catalog(log)}
    assert not entries["actService"]["available"] and entries["actService"]["reason"] and entries["actSojourn"]["available"]
    assert entries["rework"]["aggregations"] == ("share",) and "sum" not in entries["wip"]["aggregations"]
    node = formula.parse('count("a") + time_between("b", "zz") where attr("size") > 1 and contains("q")')
    assert formula.referenced(node) == (["a", "b", "q", "zz"], ["size"])
    assert formula.unknown_names(node, ["a", "b"], ["other"]) == ["q", "zz", "attr:size"]
