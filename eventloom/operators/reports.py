"""Tables that are written out: variants, the variant of each case, mined conditions, families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog
from .decisions import Fork
from .tree import Tree, fitness, order_text, orders

SAMPLE_CASES = 5


def variants_report(log: EventLog, tree: Tree, clustering: tuple[DataFrame, DataFrame], sample: int = SAMPLE_CASES) -> DataFrame:
    """A row per variant, then one for noise if there is any, then totals; ``place`` orders them.

    frequency, sequence_variants, linearization_count (text, as it may pass any integer type), the partial order,
    and the first cases of the log that belong to the variant.
    """
    groups, cases = clustering
    cases = cases.join(log.df.groupBy("case").agg(F.min("ts").alias("begin")), "case")
    order = Window.partitionBy("variant").orderBy("begin", "case")
    first = cases.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)  # cut before the shuffle
    first = first.groupBy("variant").agg(F.sort_array(F.collect_list(F.struct("k", "case"))).alias("c")).select("variant", F.concat_ws(", ", "c.case").alias("shown"), F.size("c").alias("n"))
    counts = cases.groupBy("variant").agg(F.count("*").alias("frequency"))
    more = F.col("frequency") - F.col("n")
    shown = F.when(more > 0, F.concat("shown", F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.col("shown"))
    listed = counts.join(first, "variant").select("variant", "frequency", shown.alias("sample_case_ids"))

    def described(frames):
        for frame in frames:
            frame["linearization_count"] = [str(orders(s)) for s in frame["signature"]]
            frame["partial_order_expression"] = [order_text(s, tree) for s in frame["signature"]]
            yield frame.drop(columns="signature")

    schema = "variant string, place long, sequence_variants long, linearization_count string, partial_order_expression string"
    known = groups.select("variant", F.col("rank").cast("long").alias("place"), F.col("sequences").alias("sequence_variants"), "signature").mapInPandas(described, schema)
    columns = ["place", "variant_id", "frequency", "sequence_variants", "linearization_count", "partial_order_expression", "sample_case_ids"]
    body = known.join(listed, "variant").withColumnRenamed("variant", "variant_id").select(columns)
    none = F.lit(None).cast("string")
    noise = listed.where("variant = 'noise'").select(
        F.lit(1 << 40).alias("place"), F.col("variant").alias("variant_id"), "frequency", F.lit(None).cast("long").alias("sequence_variants"), none.alias("linearization_count"), F.lit("(traces did not replay on the tree)").alias("partial_order_expression"), "sample_case_ids"
    )
    one = fitness(groups, cases)
    text = F.format_string("fitness=%.3f, compression=%.3f (concurrency-variants/sequence-variants)", "fitness", "compression")
    totals = one.select(F.lit((1 << 40) + 1).alias("place"), F.lit("totals").alias("variant_id"), F.col("cases").alias("frequency"), F.col("sequences").alias("sequence_variants"), none.alias("linearization_count"), text.alias("partial_order_expression"), none.alias("sample_case_ids"))
    return body.unionByName(noise).unionByName(totals)


def case_variant_map(clustering: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(case_id, variant_id), ``noise`` for cases that do not replay."""
    return clustering[1].select(F.col("case").alias("case_id"), F.col("variant").alias("variant_id"))


def condition_report(log: EventLog, forks: list[Fork]) -> DataFrame:
    """A row per branch of every mined choice."""
    rows = []
    for f in forks:  # choices of a small model
        for k, text in enumerate(f.conditions):
            accuracy = None if f.skipped else f"{f.accuracy:.4f}"
            rows.append((f.choice, len(f.conditions), k, accuracy, None if f.skipped else f.cases, ", ".join(f.features), f.skipped, text))
    schema = "or_fork int, n_branches int, branch_index int, accuracy string, n_samples long, features_used string, skipped_reason string, expression string"
    return log.df.sparkSession.createDataFrame(rows, schema)


def write_report(table: DataFrame, path: str) -> None:
    """A report as CSV, in its order if it has one."""
    out = table.orderBy("place").drop("place") if "place" in table.columns else table
    out.write.csv(path, header=True)


def write_family(stats: dict[str, DataFrame], path: str) -> None:
    """A folder with a CSV for each table of a family's statistics."""
    for name, table in stats.items():
        table.write.csv(f"{path}/{name}", header=True)
