"""Why cases branch: labels of cases at choices, a small decision tree per choice, conditions read off it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Clause, Range, Values, conjoin, simplify, text_of
from ..log import EventLog
from .alignment import FITTING, Runner, walked
from .attributes import Attribute, encoded
from .tree import XOR, Tree, numbered
from .variants import trace_counts


@dataclass(frozen=True)
class Fork:
    """A choice, its branches' conditions, and how well they tell the branches of its cases apart."""

    choice: int
    conditions: tuple[str, ...]
    accuracy: float = 0.0
    cases: int = 0
    features: tuple[str, ...] = ()
    skipped: str | None = None


def branch_labels(log: EventLog, tree: Tree) -> DataFrame:
    """(case, choice, branch) of every choice that a fitting case takes exactly once.

    A parse depends on the trace alone, so traces are replayed once each and their labels joined to the cases.
    """
    kids = Runner(tree).kids
    spark = log.df.sparkSession
    forks = spark.createDataFrame([(i, b, k) for i, t in numbered(tree).items() if t.op == XOR for b, k in enumerate(kids[i])], "choice int, branch int, node int")
    traces, counts = trace_counts(log)
    w = walked(counts, tree, repair=False).where(F.col("status") == FITTING)
    visits = w.select("trace", "visits", F.explode("visits").alias("node", "k"))
    taken = visits.join(F.broadcast(forks), "node")  # a row per branch of the model
    once = taken.where((F.col("k") == 1) & (F.element_at("visits", F.col("choice")) == 1)).select("trace", "choice", "branch")
    return traces.join(once, "trace").select("case", "choice", "branch")


def _clauses(node, features: list[tuple[str, Attribute, str | None]], so_far: Clause | None) -> list[tuple[int, Clause]]:
    """(branch, clause) of every leaf that some case can reach."""
    if so_far is None:
        return []
    if node.subtreeDepth() == 0:
        return [(int(node.prediction()), so_far)]
    split = node.split()
    _, a, value = features[split.featureIndex()]
    if a.kind == "integer":
        cut = float(math.floor(split.threshold()))
        low, high = Range(hi=cut), Range(lo=cut)
    elif value is not None:
        low, high = Values(False, frozenset({value})), Values(True, frozenset({value}))
    else:
        low, high = Values(True, frozenset({"false"})), Values(True, frozenset({"true"}))
    return [*_clauses(node.leftChild(), features, conjoin(so_far, a.name, low)), *_clauses(node.rightChild(), features, conjoin(so_far, a.name, high))]


def _used(node, features) -> list[str]:
    if node.subtreeDepth() == 0:
        return []
    return [features[node.split().featureIndex()][1].name, *_used(node.leftChild(), features), *_used(node.rightChild(), features)]


def mine_forks(log: EventLog, tree: Tree, cases: DataFrame, attributes: list[Attribute], depth: int = 3, bins: int = 64) -> list[Fork]:
    """A Fork for each choice of the tree; a depth-bounded tree grown by histograms on the executors.

    Choices are a property of the small model, so the loop over them is short; equal feature rows are merged and
    weighted before the trees see them. accuracy is over the cases it learned from.
    """
    runner = Runner(tree)
    x, features = encoded(cases, attributes)
    names = [f for f, _, _ in features]
    labels = branch_labels(log, tree)
    rows = labels.join(x, "case").groupBy("choice", "branch", *names).agg(F.count("*").cast("double").alias("w")).persist()
    by_choice = {r["choice"]: (int(r["w"]), r["branches"]) for r in rows.groupBy("choice").agg(F.sum("w").alias("w"), F.collect_set("branch").alias("branches")).collect()}
    out = []
    for i, t in numbered(tree).items():
        if t.op != XOR:
            continue
        n = len(runner.kids[i])
        if i not in by_choice:
            out.append(Fork(i, ("false",) * n, skipped="no_labelled_cases"))
            continue
        weight, seen = by_choice[i]
        if len(seen) == 1 or not names:
            reason = None if len(seen) == 1 else "no_attributes"
            top = min(seen) if len(seen) == 1 else None
            out.append(Fork(i, tuple("true" if b == top else "false" for b in range(n)), 1.0 if top is not None else 0.0, weight, (), reason))
            continue
        own = VectorAssembler(inputCols=names, outputCol="x").transform(rows.where(F.col("choice") == i)).select("x", F.col("branch").cast("double").alias("label"), "w")
        model = DecisionTreeClassifier(featuresCol="x", labelCol="label", weightCol="w", maxDepth=depth, maxBins=bins, seed=0).fit(own)
        right = model.transform(own).agg((F.sum(F.when(F.col("prediction") == F.col("label"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("a")).first()["a"]
        root = model._java_obj.rootNode()
        leaves = _clauses(root, features, {})
        conditions = tuple(text_of(simplify([c for b, c in leaves if b == k])) for k in range(n))
        out.append(Fork(i, conditions, right, weight, tuple(dict.fromkeys(_used(root, features)))))
    rows.unpersist()
    return out
