"""Trees from the directly-follows graph alone: Spark counts the edges, the driver cuts a graph of activities.

What reaches the driver is at most a row per pair of activities (and cell), however many distinct traces there are;
beyond MAX_EDGES it refuses. The tree may allow less or more than the log, so counts over it should allow repair.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import EventLog
from ..sources.files import LogError
from .tree import AND, LOOP, SEQ, TAU, XOR, Tree, _and_cut, _loop_cut, _seq_cut, _xor_cut, leaf, node

MAX_EDGES = 1_000_000


@dataclass
class Graph:
    """Activities, edge counts, the activities that begin and end cases, and the cases that each activity is in."""

    acts: list[str]
    follows: Counter
    starts: Counter
    ends: Counter
    cover: Counter = field(default_factory=Counter)

    def part(self, group: list[str], starts: Counter | None = None, ends: Counter | None = None) -> "Graph":
        own = set(group)
        pick = lambda c: Counter({a: n for a, n in c.items() if a in own})
        return Graph(sorted(group), Counter({(a, b): n for (a, b), n in self.follows.items() if a in own and b in own}), pick(self.starts if starts is None else starts), pick(self.ends if ends is None else ends), self.cover)


def edges(log: EventLog, cells: DataFrame | None = None) -> DataFrame:
    """(cell columns, a, b, n): successions, with a null for the begin and b null for the end of cases."""
    axes = [c for c in cells.columns if c.startswith("axis")] if cells is not None else []
    e = log.events()
    if axes:
        e = e.join(cells.select("case", *axes), "case")
    first = F.struct(F.lit(None).cast("string").alias("a"), F.col("act").alias("b"))
    pairs = F.explode(F.when(F.col("idx") == 1, F.array(first, F.struct(F.col("act").alias("a"), F.col("next_act").alias("b")))).otherwise(F.array(F.struct(F.col("act").alias("a"), F.col("next_act").alias("b")))))
    return e.select(*axes, pairs.alias("p")).select(*axes, "p.*").groupBy(*axes, "a", "b").agg(F.count("*").alias("n"))


def graphs(log: EventLog, cells: DataFrame | None = None, noise: float = 0.0) -> dict[tuple, Graph]:
    """The graph of each cell, () if there are none. Edges rarer than noise times their source's commonest are left out."""
    axes = [c for c in cells.columns if c.startswith("axis")] if cells is not None else []
    seen = log.df.join(cells.select("case", *axes), "case") if axes else log.df
    return _graphs(edges(log, cells), seen.groupBy(*axes, "act").agg(F.count_distinct("case").alias("n")), axes, noise)


def trace_graphs(traces: DataFrame, noise: float = 0.0) -> dict[tuple, Graph]:
    """The graphs of cells from their distinct traces (axes, trace, n)."""
    axes = [c for c in traces.columns if c.startswith("axis")]
    step = lambda a, i: F.struct(a.alias("a"), F.get("trace", i + 1).alias("b"))
    first = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.get("trace", F.lit(0)).alias("b")))
    pairs = traces.select(*axes, "n", F.explode(F.concat(first, F.transform("trace", step))).alias("p"))
    rows = pairs.groupBy(*axes, "p.a", "p.b").agg(F.sum("n").alias("n"))
    cover = traces.select(*axes, "n", F.explode(F.array_distinct("trace")).alias("act")).groupBy(*axes, "act").agg(F.sum("n").alias("n"))
    return _graphs(rows, cover, axes, noise)


def _graphs(steps: DataFrame, cover: DataFrame, axes: list[str], noise: float) -> dict[tuple, Graph]:
    rows = steps.limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise LogError(f"more than {MAX_EDGES} successions: merge or drop activities first")
    out: dict[tuple, Graph] = {}
    for r in rows:
        g = out.setdefault(tuple(r[x] for x in axes), Graph([], Counter(), Counter(), Counter()))
        if r["a"] is None:
            g.starts[r["b"]] += r["n"]
        elif r["b"] is None:
            g.ends[r["a"]] += r["n"]
        else:
            g.follows[r["a"], r["b"]] += r["n"]
    for r in cover.collect():  # fewer rows than edges
        out[tuple(r[x] for x in axes)].cover[r["act"]] = r["n"]
    for g in out.values():
        g.acts = sorted({*g.starts, *g.ends, *(a for pair in g.follows for a in pair)})
        if noise:
            most: Counter = Counter()
            for (a, _), n in g.follows.items():
                most[a] = max(most[a], n)
            g.follows = Counter({(a, b): n for (a, b), n in g.follows.items() if n >= noise * most[a]})
    return dict(sorted(out.items(), key=lambda kv: tuple(map(str, kv[0]))))


def discover(log: EventLog, noise: float = 0.0) -> Tree:
    found = graphs(log, None, noise)
    return mine(found[()]) if found else TAU


def mine(g: Graph) -> Tree:
    if not g.acts:
        return TAU
    if len(g.acts) == 1:
        a = leaf(g.acts[0])
        return node(LOOP, a, TAU) if (g.acts[0], g.acts[0]) in g.follows else a
    pairs, starts, ends = set(g.follows), set(g.starts), set(g.ends)
    for op, cut in ((XOR, _xor_cut), (SEQ, _seq_cut), (AND, _and_cut), (LOOP, _loop_cut)):
        groups = cut(g.acts, pairs, starts, ends)
        if groups and len(groups) > 1:
            if op == SEQ:
                return node(SEQ, *_in_order(g, groups))
            if op == LOOP:
                body, redos = groups[0], groups[1:]
                kids = [mine(g.part(body))] + [mine(g.part(r, _into(g, set(body), set(r)), _out_of(g, set(r), set(body)))) for r in redos]
                return node(LOOP, kids[0], kids[1] if len(kids) == 2 else node(XOR, *kids[1:]))
            kids = [mine(g.part(x)) for x in groups]
            if op == AND:  # cases must lack a part whose activities are in fewer of them than there are
                kids = [t if sum(g.cover[a] for a in x) >= sum(g.starts.values()) else node(XOR, TAU, t) for t, x in zip(kids, groups, strict=True)]
            return node(op, *kids)
    return node(LOOP, node(XOR, *map(leaf, g.acts)), TAU)


def _into(g: Graph, a: set[str], b: set[str]) -> Counter:
    out: Counter = Counter()
    for (x, y), n in g.follows.items():
        if x in a and y in b:
            out[y] += n
    return out


def _out_of(g: Graph, a: set[str], b: set[str]) -> Counter:
    out: Counter = Counter()
    for (x, y), n in g.follows.items():
        if x in a and y in b:
            out[x] += n
    return out


def _in_order(g: Graph, groups: list[list[str]]) -> list[Tree]:
    """The parts of a sequence; one that some edge, begin or end passes over may be left out."""
    place = {a: i for i, x in enumerate(groups) for a in x}
    kids = []
    for i, x in enumerate(groups):
        own, before, after = set(x), {a for a in place if place[a] < i}, {a for a in place if place[a] > i}
        passed = any(place[a] < i < place[b] for a, b in g.follows) or any(place[a] > i for a in g.starts) or any(place[a] < i for a in g.ends)
        t = mine(g.part(x, g.starts + _into(g, before, own), g.ends + _out_of(g, own, after)))
        kids.append(node(XOR, TAU, t) if passed else t)
    return kids
