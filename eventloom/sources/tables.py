"""Event logs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import EventLog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """A case per user, with the customer's attributes and the event's k as resource."""
    c = table(spark, sf_dir, "customer")
    attrs = c.select(F.col("c_custkey").cast("string").alias("case"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("in_credit"))
    k = F.get_json_object("props", "$.k")
    return EventLog.of(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_type"), F.col("ts"), F.col("event_id"), res=k, attrs=attrs, numeric=("nation", "balance"))


def sessions_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """A case per user and day."""
    case = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return EventLog.of(table(spark, sf_dir, "events"), case, F.col("event_type"), F.col("ts"), F.col("event_id"))


#: Lines that one task holds; sorts of so many stay small however large the table is.
TASK_LINES = 200_000


def line_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """An interval log: a case per order, starts at the order's date; nearly half the starts are bad.

    Lines and orders are dealt by the case itself, so that windows, case tables and attributes need no other shuffle,
    into tasks whose number grows with the lines.
    """
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, lines.count() // TASK_LINES + 1)
    case = lambda key: F.col(key).cast("string").alias("case")
    dates = o.select(case("o_orderkey"), "o_orderdate").where("case IS NOT NULL").repartition(tasks, "case")
    seq = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("seq")
    act = F.concat("l_returnflag", "l_linestatus").alias("act")
    df = lines.select(case("l_orderkey"), act, "l_shipdate", seq, "l_suppkey").where("case IS NOT NULL").repartition(tasks, "case").join(dates, "case")
    attrs = o.select(case("o_orderkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return EventLog.of(df, F.col("case"), F.col("act"), F.col("l_shipdate"), F.col("seq"), start=F.col("o_orderdate"), res=F.col("l_suppkey"), attrs=attrs, numeric=("price",))


def chat_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """A case per conversation, a second per turn."""
    return EventLog.of(table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("role"), F.timestamp_seconds(F.col("turn")), F.col("turn"))
