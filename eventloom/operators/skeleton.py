"""What the trees of a family have in common, and how each cell's cases branch at the choices.

Trees are merged into one skeleton in which parts that differ become variation points. Each cell is replayed on the
skeleton with its own variants put in, so that counts of a shared choice line up across the cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog
from . import dfg
from .tree import AND, LOOP, SEQ, XOR, OutOfBudget, Replayer, Tree

VARIES = "varies"


@dataclass(frozen=True)
class Part:
    """A node of the skeleton; at a variation point cells[i] names the cells that have children[i]."""

    op: str | None
    label: str | None = None
    children: tuple["Part", ...] = ()
    cells: tuple[tuple[int, ...], ...] = ()


Variants = list[tuple[tuple[int, ...], Tree]]


def canonical(t: Tree) -> str:
    """Equal for trees that differ only in the order of choices or parallel parts."""
    if not t.op:
        return "tau" if t.label is None else repr(t.label)
    kids = [canonical(c) for c in t.children]
    return f"{t.op}({', '.join(sorted(kids) if t.op in (XOR, AND) else kids)})"


def _part(t: Tree) -> Part:
    return Part(t.op, t.label, tuple(map(_part, t.children)))


def _grouped(variants: Variants) -> Variants:
    """Cells with equal trees together, in order of first appearance."""
    found: dict[str, tuple[list[int], Tree]] = {}
    for cells, t in variants:
        found.setdefault(canonical(t), ([], t))[0].extend(cells)
    return [(tuple(cells), t) for cells, t in found.values()]


def _varying(variants: Variants) -> Part:
    groups = _grouped(variants)
    return Part(VARIES, None, tuple(_part(t) for _, t in groups), tuple(cells for cells, _ in groups))


def merge(variants: Variants) -> Part:
    """The skeleton of some cells' trees: equal parts once, sequences and loops part by part, the rest as variants."""
    groups = _grouped(variants)
    if len(groups) == 1:
        return _part(groups[0][1])
    trees = [t for _, t in groups]
    if all(t.op == SEQ for t in trees):
        return _merge_sequences(groups)
    if all(t.op == LOOP and len(t.children) == 2 for t in trees):
        return Part(LOOP, None, tuple(merge([(c, t.children[k]) for c, t in groups]) for k in (0, 1)))
    return _varying(groups)


def _shared(keys: list[list[str]]) -> int:
    """Length of the longest common prefix."""
    n = 0
    for column in zip(*keys, strict=False):
        if len(set(column)) > 1:
            break
        n += 1
    return n


def _merge_sequences(groups: Variants) -> Part:
    keys = [[canonical(c) for c in t.children] for _, t in groups]
    head = _shared(keys)
    tail = _shared([k[head:][::-1] for k in keys])
    middles = [(cells, t.children[head : len(t.children) - tail]) for cells, t in groups]
    first = groups[0][1].children
    out = list(map(_part, first[:head]))
    sizes = {len(m) for _, m in middles}
    if len(sizes) == 1:
        out += [merge([(cells, m[i]) for cells, m in middles]) for i in range(sizes.pop())]
    else:
        whole = lambda m: Tree() if not m else m[0] if len(m) == 1 else Tree(SEQ, None, m)
        out.append(_varying([(cells, whole(m)) for cells, m in middles]))
    out += map(_part, first[len(first) - tail :])
    return Part(SEQ, None, tuple(out))


def numbered(skeleton: Part) -> dict[int, tuple[Part, int | None, int]]:
    """Pre-order number -> (part, its parent's number, its place among the parent's children)."""
    out: dict[int, tuple[Part, int | None, int]] = {}

    def go(p: Part, parent: int | None, place: int):
        own = len(out)
        out[own] = (p, parent, place)
        for n, c in enumerate(p.children):
            go(c, own, n)

    go(skeleton, None, 0)
    return out


def configured(skeleton: Part, cell: int) -> tuple[Tree, list[int]]:
    """A cell's own tree, and the skeleton's number of each of its nodes in pre-order."""
    alias: list[int] = []
    count = iter(range(10**9))

    def go(p: Part, used: bool) -> Tree | None:
        own = next(count)
        if p.op == VARIES:
            chosen = next((n for n, c in enumerate(p.cells) if cell in c), 0)
            kids = [go(c, used and n == chosen) for n, c in enumerate(p.children)]
            return kids[chosen]
        if used:
            alias.append(own)
        kids = [go(c, used) for c in p.children]
        return Tree(p.op, p.label, tuple(kids)) if used else None

    return go(skeleton, True), alias


def _labels(p: Part) -> Iterator[str]:
    if p.label is not None:
        yield p.label
    for c in p.children:
        yield from _labels(c)


def _last(p: Part) -> str | None:
    found = None
    for found in _labels(p.children[0] if p.op == LOOP and p.children else p):
        pass
    return found


def choices(skeleton: Part) -> list[dict]:
    """The choices in pre-order: node, name by what precedes it, branches by their first activities, inside_loop, shared."""
    parts = numbered(skeleton)
    kids: dict[int, list[int]] = {}
    for i, (_, parent, _) in parts.items():
        if parent is not None:
            kids.setdefault(parent, []).append(i)
    out = []
    for i, (p, _, _) in parts.items():
        if p.op != XOR or len(p.children) < 2:
            continue
        before, in_loop, shared, at = None, False, True, i
        while parts[at][1] is not None:
            _, up, place = parts[at]
            over = parts[up][0]
            in_loop |= over.op == LOOP
            shared &= over.op != VARIES
            if before is None and over.op == SEQ:
                before = next((x for k in range(place - 1, -1, -1) if (x := _last(over.children[k]))), None)
            elif before is None and over.op == LOOP and place:
                before = _last(over.children[0])
            at = up
        seen: dict[str, int] = {}
        names = []
        for c in p.children:
            name = next(_labels(c), "(skip)")
            seen[name] = seen.get(name, 0) + 1
            names.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
        out.append({"node": i, "name": f"after {before}" if before else "at start", "branches": names, "children": kids[i], "inside_loop": in_loop, "shared": shared})
    return out


def family_choices(log: EventLog, cells: DataFrame, noise: float = 0.0) -> tuple[DataFrame, Part]:
    """(axes, choice, name, branch, label, n, share) and the skeleton; n is null where a cell never comes to the choice.

    The log is read once, for the distinct traces of the cells: each cell's tree comes from its directly-follows graph,
    counted over them, and the replay runs over them. Traces that do not fit are not counted.
    """
    axes = [c for c in cells.columns if c.startswith("axis")]
    spark = log.df.sparkSession
    traces = log.traces().join(cells.select("case", *axes), "case").groupBy(*axes, "trace").agg(F.count("*").alias("n")).persist()
    found = dfg.trace_graphs(traces, noise)
    names = list(found)
    skeleton = merge([((i,), dfg.mine(g)) for i, g in enumerate(found.values())]) if names else Part(None)
    setup = [configured(skeleton, i) for i in range(len(names))]
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    key = spark.createDataFrame([(*k, i) for i, k in enumerate(names)], ", ".join([f"`{a}` {kinds[a]}" for a in axes] + ["cell int"]))
    rows = traces.join(key, axes)  # a row per cell: broadcast if small

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replayers = [Replayer(t) for t, _ in setup]
        for frame in frames:
            out: dict[tuple[int, int], int] = {}
            for cell, trace, n in zip(frame["cell"], frame["trace"], frame["n"], strict=True):
                try:
                    got = replayers[cell].replay(tuple(trace))
                except OutOfBudget:
                    got = None
                for i, k in got[1].items() if got else ():
                    at = (cell, setup[cell][1][i])
                    out[at] = out.get(at, 0) + k * n
            yield pd.DataFrame([(c, i, k) for (c, i), k in out.items()], columns=["cell", "node", "k"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    walks = rows.select("cell", "trace", "n").repartition(tasks, "cell", "trace").mapInPandas(run, "cell int, node int, k long").groupBy("cell", "node").agg(F.sum("k").alias("k"))
    known = [(c["node"], c["name"], b, label, child) for c in choices(skeleton) for b, (label, child) in enumerate(zip(c["branches"], c["children"], strict=True))]
    table = spark.createDataFrame(known, "choice int, name string, branch int, label string, child int")
    grid = key.crossJoin(table)  # cells by branches of the model: small spines
    counted = grid.join(walks.select("cell", F.col("node").alias("child"), "k"), ["cell", "child"], "left")
    total = F.sum("k").over(Window.partitionBy("cell", "choice"))
    n = F.when(total.isNotNull(), F.coalesce("k", F.lit(0)))
    return counted.select(*axes, "choice", "name", "branch", "label", n.alias("n"), F.try_divide(n.cast("double"), total).alias("share")), skeleton

