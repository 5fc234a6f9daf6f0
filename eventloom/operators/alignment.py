"""Alignments of traces to a process tree, and traversal counts that use them.

A tree runs as a term that is rewritten by each visible step, silent steps being folded into the next visible one.
The search is over (position in the trace, term): following both is free, skipping an event or a model step costs
one. It is bounded by the number of expanded states, not by a clock, so that reruns agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..log import EventLog
from .tree import AND, BUDGET, LOOP, SEQ, XOR, OutOfBudget, Replayer, Tree, numbered
from .variants import trace_counts

STATES = 50_000
DONE = ("done",)


class Runner:
    """The steps of a tree. Terms: done; ("new", node); ("then", term, later nodes); ("par", terms); ("loop", node, part, term)."""

    def __init__(self, tree: Tree):
        self.nodes = numbered(tree)
        self.kids: dict[int, tuple[int, ...]] = {}
        self.known: dict[tuple, tuple[tuple[str, tuple], ...]] = {}
        self._number(tree, iter(range(len(self.nodes))))
        self.start = ("new", 0)

    def _number(self, t: Tree, ids: Iterator[int]) -> int:
        own = next(ids)
        self.kids[own] = tuple(self._number(c, ids) for c in t.children)
        return own

    def may_end(self, term: tuple) -> bool:
        kind = term[0]
        if kind == "done":
            return True
        if kind == "then":
            return self.may_end(term[1]) and all(self.may_end(("new", k)) for k in term[2])
        if kind == "par":
            return all(map(self.may_end, term[1]))
        if kind == "loop":
            _, i, part, inner = term
            return self.may_end(inner) and (part == 0 or self.may_end(("new", self.kids[i][0])))
        i = term[1]
        op, kids = self.nodes[i].op, [("new", k) for k in self.kids[i]]
        if op is None:
            return self.nodes[i].label is None
        if op == XOR:
            return any(map(self.may_end, kids))
        return self.may_end(kids[0]) if op == LOOP else all(map(self.may_end, kids))

    def steps(self, term: tuple) -> tuple[tuple[str, tuple], ...]:
        """(label, next term) of every visible step, sorted."""
        if term not in self.known:
            self.known[term] = tuple(sorted(set(self._steps(term)), key=repr))
        return self.known[term]

    def _steps(self, term: tuple) -> Iterator[tuple[str, tuple]]:
        kind = term[0]
        if kind == "new":
            i = term[1]
            op, kids = self.nodes[i].op, self.kids[i]
            if op is None:
                if self.nodes[i].label is not None:
                    yield self.nodes[i].label, DONE
            elif op == XOR:
                for k in kids:
                    yield from self.steps(("new", k))
            elif op == SEQ:
                yield from self._then(("new", kids[0]), kids[1:]) if kids else ()
            elif op == AND:
                yield from self._par(tuple(("new", k) for k in kids))
            else:
                yield from self._loop(i, 0, ("new", kids[0]))
        elif kind == "then":
            yield from self._then(term[1], term[2])
        elif kind == "par":
            yield from self._par(term[1])
        elif kind == "loop":
            yield from self._loop(*term[1:])

    def _then(self, inner: tuple, later: tuple[int, ...]) -> Iterator[tuple[str, tuple]]:
        for label, after in self.steps(inner):
            yield label, after if not later else ("then", after, later)
        if later and self.may_end(inner):
            yield from self._then(("new", later[0]), later[1:])

    def _par(self, parts: tuple[tuple, ...]) -> Iterator[tuple[str, tuple]]:
        for n, part in enumerate(parts):
            for label, after in self.steps(part):
                left = tuple(p for p in (*parts[:n], after, *parts[n + 1 :]) if p != DONE)
                yield label, ("par", tuple(sorted(left, key=repr))) if left else DONE

    def _loop(self, i: int, part: int, inner: tuple) -> Iterator[tuple[str, tuple]]:
        """Part 0 is the body, others are redo parts; a part that may end silently lets the next one begin."""
        body, redos = self.kids[i][0], range(1, len(self.kids[i]))
        seen: set[int] = set()
        todo = [(part, inner)]
        while todo:
            p, now = todo.pop()
            for label, after in self.steps(now):
                yield label, ("loop", i, p, after)
            if self.may_end(now):
                follow = redos if p == 0 else (0,)
                for q in follow:
                    if q not in seen:
                        seen.add(q)
                        todo.append((q, ("new", self.kids[i][q] if q else body)))


class Aligner:
    def __init__(self, tree: Tree, states: int = STATES):
        self.run, self.alphabet, self.states = Runner(tree), tree.alphabet(), states
        self.ids: dict[tuple, int] = {}
        #: By a term's number: the term, its text, whether it may end, and its steps once they are asked for.
        self.terms: list[tuple[tuple, str, bool]] = []
        self.moves: list[list[tuple[str, int]] | None] = []

    def _id(self, term: tuple) -> int:
        if term not in self.ids:
            self.ids[term] = len(self.terms)
            self.terms.append((term, repr(term), self.run.may_end(term)))
            self.moves.append(None)
        return self.ids[term]

    def _steps(self, term: int) -> list[tuple[str, int]]:
        if self.moves[term] is None:
            self.moves[term] = [(label, self._id(after)) for label, after in self.run.steps(self.terms[term][0])]
        return self.moves[term]

    def align(self, trace: tuple[str, ...]) -> tuple[int, tuple[str, ...]] | None:
        """(cost, path) of a nearest path of the tree, None beyond the budget of states.

        Events outside the tree's alphabet can only be skipped; the estimate counts those still to come. Of
        equal costs the further position goes first, then the path that sorts first.
        """
        alien = [0] * (len(trace) + 1)
        for n in range(len(trace) - 1, -1, -1):
            alien[n] = alien[n + 1] + (trace[n] not in self.alphabet)
        start, end, push = self._id(self.run.start), len(trace), heapq.heappush
        queue = [(alien[0], 0, (), 0, self.terms[start][1], start)]
        best: dict[tuple[int, int], int] = {}
        popped = 0
        while queue:
            _, back, path, cost, _, term = heapq.heappop(queue)
            at = -back
            if best.get((at, term), cost + 1) <= cost:
                continue
            best[at, term] = cost
            popped += 1
            if popped > self.states:
                return None
            if at == end and self.terms[term][2]:
                return cost, path
            moves = [(at + 1, term, path, cost + 1)] if at < end else []
            for label, after in self._steps(term):
                way = (*path, label)
                if at < end and label == trace[at]:
                    moves.append((at + 1, after, way, cost))
                moves.append((at, after, way, cost + 1))
            for n, after, way, c in moves:
                if best.get((n, after), c + 1) > c:
                    push(queue, (c + alien[n], -n, way, c, self.terms[after][1], after))
        return None


FITTING, REPAIRED, UNEXPLAINED = "fitting", "repaired", "unexplained"


def _core(tree: Tree) -> Column:
    """A trace with a null in place of each run of events outside the tree's alphabet.

    A run as a whole stays, not its length: where it lies tells which of equal paths is taken.
    """
    known = F.array(*map(F.lit, sorted(tree.alphabet()))).cast("array<string>")
    marked = F.transform("trace", lambda a: F.when(F.array_contains(known, a), a))
    return F.filter(marked, lambda a, i: a.isNotNull() | (i == 0) | F.get(marked, i - 1).isNotNull())


def _walks(cores: DataFrame, tree: Tree, repair: bool, budget: int, states: int) -> DataFrame:
    """(core, fits, signature, path, cost, visits) of distinct traces, runs of alien events being nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replayer, aligner = Replayer(tree, budget), Aligner(tree, states)

        def replay(t: tuple[str, ...]):
            try:
                return replayer.replay(t)
            except OutOfBudget:
                return None

        for frame in frames:
            rows = []
            for raw in frame["core"]:
                core = tuple(raw)
                path, cost, got = core, 0, replay(core)
                fits = got is not None
                if not fits and repair:
                    found = aligner.align(core)
                    if found:
                        cost, path = found
                        got = replay(path)
                rows.append((list(core), fits, *((None, None, None, {}) if got is None else (got[0], list(path), cost, dict(got[1])))))
            yield pd.DataFrame(rows, columns=["core", "fits", "signature", "path", "cost", "visits"]).astype({"cost": "Int32"})

    tasks = 4 * cores.sparkSession.sparkContext.defaultParallelism
    return cores.repartition(tasks, "core").mapInPandas(run, "core array<string>, fits boolean, signature string, path array<string>, cost int, visits map<int,long>")


def _status() -> Column:
    return F.when(F.col("fits"), FITTING).when(F.col("signature").isNotNull(), REPAIRED).otherwise(UNEXPLAINED)


def walked(counts: DataFrame, tree: Tree, repair: bool = True, budget: int = BUDGET, states: int = STATES) -> DataFrame:
    """Distinct traces (trace, n) with the path of the tree they count along: their own if it fits, else a nearest one.

    Events outside the tree's alphabet can only be skipped, at a cost of one each: traces alike but for the names and
    the lengths of runs of such events are walked once. Walks are dealt over several tasks a core, as their costs differ
    by orders of magnitude. A trace that runs out of budget is unexplained and has no path.
    """
    rows = counts.select("trace", F.col("n").cast("long").alias("n"), _core(tree).alias("core"))
    walks = _walks(rows.select("core").distinct(), tree, repair, budget, states)
    cost = (F.col("cost") + F.size("trace") - F.size("core")).cast("int").alias("cost")
    return rows.join(walks, "core").select("trace", "n", _status().alias("status"), "signature", "path", cost, "visits")


def traversal_stats(log: EventLog, tree: Tree, repair: bool = True, states: int = STATES) -> tuple[DataFrame, DataFrame]:
    """(node, visits, cases) over counted cases, and one row of totals: cases and sequences by status, coverage, fitting ratio."""
    counts = trace_counts(log)[1].groupBy(_core(tree).alias("core")).agg(F.sum("n").alias("n"), F.count("*").alias("sequences")).persist()
    walks = _walks(counts.select("core"), tree, repair, BUDGET, states)
    w = counts.join(walks, "core").withColumn("status", _status()).persist()
    nodes = w.select("n", F.explode("visits").alias("node", "k")).groupBy("node").agg(F.sum(F.col("k") * F.col("n")).alias("visits"), F.sum("n").alias("cases"))
    by = {s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)) for s in (FITTING, REPAIRED, UNEXPLAINED)}
    totals = w.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *(c.alias(s) for s, c in by.items()), F.coalesce(F.sum("sequences"), F.lit(0)).alias("sequences"), F.count_distinct("signature").alias("signatures"))
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), F.col("total")), F.lit(0.0))
    return nodes, totals.withColumn("coverage", share(F.col(FITTING) + F.col(REPAIRED))).withColumn("fitting_ratio", share(F.col(FITTING)))


def branch_counts(tree: Tree, nodes: DataFrame) -> DataFrame:
    """(choice, branch, visits): how often each branch of a choice is taken; 0 if never."""
    kids = Runner(tree).kids
    rows = [(i, b, k) for i, t in numbered(tree).items() if t.op == XOR for b, k in enumerate(kids[i])]
    known = nodes.sparkSession.createDataFrame(rows, "choice int, branch int, node int")
    return known.join(nodes.select("node", "visits"), "node", "left").select("choice", "branch", F.coalesce("visits", F.lit(0)).alias("visits"))
