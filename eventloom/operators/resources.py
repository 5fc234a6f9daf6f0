"""Who performs each activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog


def performers(log: EventLog, strategy: str = "mode", min_support: float = 0.0) -> DataFrame:
    """(act, performer): the commonest resource (mode), the first in the log, the only one (unbound), or all joined by +."""
    known = log.df.where("res IS NOT NULL AND res <> ''")
    if strategy == "first":
        return known.groupBy("act").agg(F.min_by("res", F.struct("ts", "case", "seq")).alias("performer"))
    n = known.groupBy("act", "res").agg(F.count("*").alias("n"), F.min(F.struct("ts", "case", "seq")).alias("seen"))
    if strategy == "mode":
        best = n.withColumn("k", F.row_number().over(Window.partitionBy("act").orderBy(F.desc("n"), "res"))).withColumn("t", F.sum("n").over(Window.partitionBy("act")))
        return best.where((F.col("k") == 1) & (F.col("n") >= min_support * F.col("t"))).select("act", F.col("res").alias("performer"))
    if strategy == "unbound":
        return n.groupBy("act").agg(F.count("*").alias("k"), F.min("res").alias("performer")).where("k = 1").drop("k")
    if strategy == "all":
        return n.groupBy("act").agg(F.sort_array(F.collect_list(F.struct("seen", "res"))).alias("r")).select("act", F.array_join(F.col("r.res"), "+").alias("performer"))
    raise ValueError(f"unknown strategy {strategy!r}")


def first_of(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns))


def components(log: EventLog) -> DataFrame:
    return log.df.where("res IS NOT NULL AND res <> ''").select("res").distinct()
