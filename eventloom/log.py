"""The event log and the facts derived from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def epoch_s(ts) -> Column:
    """Whole epoch seconds, rounded half up."""
    return F.floor((F.unix_micros(ts) + 500_000) / 1_000_000).cast("long")


@dataclass
class EventLog:
    """Events with columns case, act, ts, seq and, if the log has them, start_ts and res; attrs holds a row per case.

    seq breaks ties of ts and must be unique within a case: it stands for input order.
    """

    df: DataFrame
    attrs: DataFrame | None = None
    numeric: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def of(cls, df: DataFrame, case, act, ts, seq, start=None, res=None, attrs: DataFrame | None = None, numeric=()) -> "EventLog":
        cols = [case.cast("string").alias("case"), act.cast("string").alias("act"), ts.cast("timestamp").alias("ts"), seq.alias("seq")]
        cols += [start.cast("timestamp").alias("start_ts")] if start is not None else []
        cols += [res.cast("string").alias("res")] if res is not None else []
        return cls(df.select(*cols).where("ts IS NOT NULL"), attrs, frozenset(numeric))

    @property
    def interval(self) -> bool:
        return "start_ts" in self.df.columns

    def replace(self, df: DataFrame) -> "EventLog":
        return EventLog(df, self.attrs, self.numeric)

    def keep_cases(self, cases: DataFrame, how: str = "left_semi") -> "EventLog":
        return self.replace(self.df.join(cases.select("case"), "case", how))

    def events(self) -> DataFrame:
        """Events with their place in the case and its neighbours; one shuffle by case, which case tables reuse.

        A start that is missing or later than its completion counts as the completion (start_s); ok_start
        tells the rows whose own start is good.
        """
        e = self.df.withColumn("end_s", epoch_s(F.col("ts")))
        if self.interval:
            own = epoch_s(F.col("start_ts"))
            ok = F.coalesce(F.col("start_ts") <= F.col("ts"), F.lit(False))
            e = e.withColumn("own_start_s", own).withColumn("ok_start", ok).withColumn("start_s", F.when(ok, own).otherwise(F.col("end_s")))
        else:
            e = e.withColumn("own_start_s", F.lit(None).cast("long")).withColumn("ok_start", F.lit(False)).withColumn("start_s", F.col("end_s"))
        w = Window.partitionBy("case").orderBy("ts", "seq")
        follow = F.lead("own_start_s" if self.interval else "end_s").over(w)
        return e.select(
            "*",
            F.row_number().over(w).alias("idx"),
            F.lag("end_s").over(w).alias("prev_end_s"),
            F.lead("act").over(w).alias("next_act"),
            F.lead("end_s").over(w).alias("next_end_s"),
            follow.alias("next_start_s"),
        )

    def traces(self) -> DataFrame:
        """(case, trace array<string>, first_seq)."""
        rows = F.sort_array(F.collect_list(F.struct("ts", "seq", "act")))
        return self.df.groupBy("case").agg(rows.alias("r")).select("case", F.col("r.act").alias("trace"))

    def with_attrs(self, cases: DataFrame) -> DataFrame:
        return cases if self.attrs is None else cases.join(self.attrs, "case", "left")
