"""Scenarios: a path model of a tree, its simulation by tokens, scenarios from variants, and what they cover.

The model is small and goes to the executors; there is a scenario per variant, and variants are simulated where they lie.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import holds
from ..log import EventLog
from .alignment import FITTING, Runner, walked
from .tree import AND, LOOP, SEQ, XOR, Tree, numbered
from .variants import trace_counts

START, END, ACT, OR_FORK, OR_JOIN, AND_FORK, AND_JOIN, STUB, DYNAMIC = "start", "end", "activity", "or_fork", "or_join", "and_fork", "and_join", "stub", "dynamic_stub"
PATH = "path"
MAX_HITS = 100
# Kinds of problems that a simulation reports.
BLOCKED, ENDLESS, UNREACHED, NO_BRANCH, MANY_BRANCHES, MANY_PLUGINS, NO_PLUGIN, UNSUPPORTED = (
    "blocked_and_join",
    "infinite_loop",
    "end_point_not_reached",
    "no_branch_enabled",
    "multiple_branches_enabled",
    "multiple_plugins_enabled",
    "no_plugin_enabled",
    "unsupported_node",
)


@dataclass(frozen=True)
class Step:
    """A node of a map. A fork that closes a loop counts ``counter`` down each time; a stub holds (map, precondition) pairs."""

    id: int
    kind: str
    map: str
    label: str = ""
    counter: str | None = None
    plugins: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Path:
    id: int
    source: int
    target: int
    guard: str | None = None


@dataclass
class Model:
    root: str
    steps: dict[int, Step] = field(default_factory=dict)
    paths: dict[int, Path] = field(default_factory=dict)

    def out(self, step: int) -> list[Path]:
        return [p for p in self.paths.values() if p.source == step]

    def into(self, step: int) -> list[Path]:
        return [p for p in self.paths.values() if p.target == step]

    def elements(self) -> set[tuple[str, int]]:
        return {(s.kind, s.id) for s in self.steps.values()} | {(PATH, p.id) for p in self.paths.values()}

    def problems(self) -> list[str]:
        """Steps with the wrong number of ways in or out."""
        arity = {START: ("0", "1"), END: ("1", "0"), ACT: ("1", "1"), STUB: ("1", "1"), DYNAMIC: ("1", "1"), OR_FORK: ("1", "2+"), AND_FORK: ("1", "2+"), OR_JOIN: ("2+", "1"), AND_JOIN: ("2+", "1")}
        ok = lambda n, rule: n >= 2 if rule == "2+" else n == int(rule)
        out = []
        for s in self.steps.values():
            if s.kind not in arity:
                out.append(f"{s.kind} {s.id}: unknown kind")
                continue
            for side, n, rule in (("in", len(self.into(s.id)), arity[s.kind][0]), ("out", len(self.out(s.id)), arity[s.kind][1])):
                if not ok(n, rule):
                    out.append(f"{s.kind} {s.id}: {n} {side}, not {rule}")
        return out


def model_of(tree: Tree, guards: dict[tuple[int, int], str] | None = None, stubs: frozenset[int] = frozenset()) -> Model:
    """The path model of a tree: a root map, and a plug-in map behind a stub for each node in stubs.

    A branch without a guard gets ``choice_<node> == <branch>``; loops run ``loop_<node>`` times.
    """
    guards = guards or {}
    nodes, kids = numbered(tree), Runner(tree).kids
    model = Model("root")

    def step(kind: str, on: str, **more) -> int:
        n = len(model.steps)
        model.steps[n] = Step(n, kind, on, **more)
        return n

    def connect(src: tuple[int, str | None], target: int) -> None:
        n = len(model.paths)
        model.paths[n] = Path(n, src[0], target, src[1])

    def build(i: int, src: tuple[int, str | None], on: str) -> tuple[int, str | None]:
        t, below = nodes[i], kids[i]
        if i in stubs and on != f"part_{i}":
            name = f"part_{i}"
            stub = step(STUB, on, label=name, plugins=((name, "true"),))
            connect(src, stub)
            connect(build(i, (step(START, name), None), name), step(END, name))
            return stub, None
        if t.op is None:
            if t.label is None:
                return src
            n = step(ACT, on, label=t.label)
            connect(src, n)
            return n, None
        if t.op == SEQ or t.op in (XOR, AND) and len(below) == 1:
            for k in below:
                src = build(k, src, on)
            return src
        if t.op == LOOP:
            join = step(OR_JOIN, on)
            connect(src, join)
            end = build(below[0], (join, None), on)
            fork = step(OR_FORK, on, label=f"loop_{i}", counter=f"loop_{i}")
            connect(end, fork)
            again = (fork, f"loop_{i} > 0")
            if len(below) > 2:
                pick = step(OR_FORK, on, label=f"redo_{i}")
                connect(again, pick)
                merge = step(OR_JOIN, on)
                for b, k in enumerate(below[1:]):
                    connect(build(k, (pick, f"redo_{i} == {b}"), on), merge)
                connect((merge, None), join)
            elif len(below) == 2:
                connect(build(below[1], again, on), join)
            else:
                connect(again, join)
            return fork, f"loop_{i} <= 0"
        fork = step(OR_FORK if t.op == XOR else AND_FORK, on, label=f"choice_{i}" if t.op == XOR else "")
        connect(src, fork)
        join = step(OR_JOIN if t.op == XOR else AND_JOIN, on)
        for b, k in enumerate(below):
            guard = guards.get((i, b), f"choice_{i} == {b}") if t.op == XOR else None
            connect(build(k, (fork, guard), on), join)
        return join, None

    connect(build(0, (step(START, "root"), None), "root"), step(END, "root"))
    return model


@dataclass(frozen=True)
class Run:
    """What a simulation walked, how often, the activities in order, and its problems as (kind, step, text)."""

    visits: dict[tuple[str, int], int]
    trace: tuple[str, ...]
    problems: tuple[tuple[str, int, str], ...]

    @property
    def visited(self) -> set[tuple[str, int]]:
        return set(self.visits)


def simulate(model: Model, values: dict[str, object], max_hits: int = MAX_HITS) -> Run:
    """The token game. Tokens move first in, first out; a tuple as a value holds what a fork is to see at each visit.

    A token that meets a problem stops there. An AND-join waits for a token on each way in, per call of its map; a map
    behind a stub is called with its own stack, so that its end returns to the caller.
    """
    out: dict[int, list[Path]] = {s: [] for s in model.steps}
    into: dict[int, list[Path]] = {s: [] for s in model.steps}
    for p in sorted(model.paths.values(), key=lambda p: p.id):
        out[p.source].append(p)
        into[p.target].append(p)
    starts = {s.map: s.id for s in model.steps.values() if s.kind == START}
    visits: Counter = Counter()
    hits: Counter = Counter()
    counters: dict[tuple, int] = {}
    waiting: dict[tuple[int, tuple], set[int]] = {}
    problems: list[tuple[str, int, str]] = []
    trace: list[str] = []
    tokens = deque([(starts[model.root], None, ())])
    ended: set[int] = set()

    def go(p: Path, stack: tuple) -> None:
        visits[PATH, p.id] += 1
        tokens.append((p.target, p.id, stack))

    def seen(s: Step) -> dict[str, object]:
        return {k: v[(hits[s.id] - 1) % len(v)] if v else None for k, v in ((k, v if isinstance(v, tuple) else (v,)) for k, v in values.items())}

    while tokens:
        at, via, stack = tokens.popleft()
        s = model.steps[at]
        if s.kind == AND_JOIN:
            got = waiting.setdefault((at, stack), set())
            got.add(via)
            if len(got) < len(into[at]):
                continue
            del waiting[at, stack]
        hits[at] += 1
        if hits[at] > max_hits:
            if hits[at] == max_hits + 1:
                problems.append((ENDLESS, at, f"{s.kind} {s.label} entered {max_hits} times"))
            continue
        visits[s.kind, at] += 1
        if s.kind == ACT:
            trace.append(s.label)
        if s.kind == END:
            ended.add(at)
            if stack:
                caller, rest = stack[-1], stack[:-1]
                for p in out[caller]:
                    go(p, rest)
        elif s.kind in (STUB, DYNAMIC):
            now = seen(s)
            open_maps = [name for name, when in s.plugins if holds(when, now)]
            if not open_maps:
                problems.append((NO_PLUGIN, at, s.label))
            elif len(open_maps) > 1 and s.kind == STUB:
                problems.append((MANY_PLUGINS, at, s.label))
            else:
                tokens.extend((starts[name], None, (*stack, at)) for name in open_maps)
        elif s.kind == OR_FORK:
            now = seen(s)
            if s.counter:
                key = (at, stack)
                left = counters.get(key, int(now.get(s.counter) or 1)) - 1
                counters[key] = left
                now[s.counter] = left
                if left <= 0:
                    del counters[key]
            ways = [p for p in out[at] if p.guard is None or holds(p.guard, now)]
            if len(ways) == 1:
                go(ways[0], stack)
            else:
                problems.append((MANY_BRANCHES if ways else NO_BRANCH, at, s.label))
        elif s.kind in (START, ACT, OR_JOIN, AND_FORK, AND_JOIN):
            for p in out[at]:
                go(p, stack)
        else:
            problems.append((UNSUPPORTED, at, s.kind))
    problems += [(BLOCKED, at, f"{len(got)} of {len(into[at])} ways came") for (at, _), got in waiting.items()]
    problems += [(UNREACHED, s.id, s.label) for s in model.steps.values() if s.kind == END and s.map == model.root and s.id not in ended]
    return Run(dict(visits), tuple(trace), tuple(problems))


def suggest_loop_iterations(tree: Tree) -> dict[int, int]:
    """How often each loop must run to walk every branch in it: choices add up, other parts overlap, inner loops count for themselves."""
    nodes, kids = numbered(tree), Runner(tree).kids

    def need(i: int) -> int:
        t = nodes[i]
        if t.op == XOR and kids[i]:
            return sum(map(need, kids[i]))
        if t.op == LOOP or not kids[i]:
            return 1
        return max(map(need, kids[i]))

    return {i: max(need(kids[i][0]), *(1 + need(k) for k in kids[i][1:2])) if len(kids[i]) > 1 else need(kids[i][0]) for i, t in nodes.items() if t.op == LOOP and kids[i]}


def settings(tree: Tree, visits: dict[int, int]) -> dict[str, tuple[int, ...]]:
    """What a parse means for the model's variables: each choice's branches as often as they were taken, and loop counts.

    A parse tells how often, not in which order, so branches of a choice in a loop go round in turn.
    """
    nodes, kids = numbered(tree), Runner(tree).kids
    out: dict[str, tuple[int, ...]] = {}
    for i, t in nodes.items():
        k = visits.get(i, 0)
        if not k:
            continue
        if t.op == XOR:
            left = [visits.get(c, 0) for c in kids[i]]
            turns = []
            while any(left):
                for b, n in enumerate(left):
                    if n:
                        turns.append(b)
                        left[b] -= 1
            out[f"choice_{i}"] = tuple(turns)
        elif t.op == LOOP:
            out[f"loop_{i}"] = (math.ceil(visits.get(kids[i][0], 0) / k),)
    return out


SCENARIO_SCHEMA = "variant string, cases long, share double, settings map<string,array<int>>, trace array<string>, visited array<struct<kind:string,id:int>>, problems array<struct<kind:string,id:int,text:string>>"


def scenarios(log: EventLog, tree: Tree, model: Model | None = None, values: DataFrame | None = None, max_hits: int = MAX_HITS) -> DataFrame:
    """A scenario per variant (variant, cases, share, settings, trace, visited, problems), simulated on the model.

    Settings come from the commonest trace of the variant, the first of equals. values, as (variant, attribute, value),
    adds what data-driven guards read. Variants are ranked by cases, then by signature.
    """
    model = model or model_of(tree)
    w = walked(trace_counts(log)[1], tree, repair=False).where(F.col("status") == FITTING)
    groups = w.groupBy("signature").agg(F.sum("n").alias("cases"), F.min_by("visits", F.struct(-F.col("n"), "trace")).alias("visits"))
    total = F.sum("cases").over(Window.partitionBy())
    ranked = groups.withColumn("share", F.col("cases") / total).withColumn("variant", F.concat(F.lit("v"), F.row_number().over(Window.orderBy(F.desc("cases"), "signature")).cast("string")))  # a row per variant
    if values is not None:
        given = values.groupBy("variant").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("given"))  # an entry per attribute
        ranked = ranked.join(given, "variant", "left")
    else:
        ranked = ranked.withColumn("given", F.lit(None).cast("map<string,string>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                own = settings(tree, dict(r.visits))
                done = simulate(model, {**own, **(dict(r.given) if r.given is not None else {})}, max_hits)
                rows.append((r.variant, r.cases, r.share, {k: list(v) for k, v in own.items()}, list(done.trace), [{"kind": k, "id": i} for k, i in sorted(done.visited)], [{"kind": k, "id": i, "text": x} for k, i, x in done.problems]))
            yield pd.DataFrame(rows, columns=["variant", "cases", "share", "settings", "trace", "visited", "problems"])

    return ranked.select("variant", "cases", "share", "visits", "given").mapInPandas(run, SCENARIO_SCHEMA)


def coverage(found: DataFrame, model: Model) -> DataFrame:
    """(kind, covered, total, hits): elements of the model that some scenario walks, by kind, and scenarios that walk them."""
    spark = found.sparkSession
    every = spark.createDataFrame(sorted(model.elements()), "kind string, id int")
    hit = found.select(F.explode("visited").alias("e")).select("e.*").groupBy("kind", "id").agg(F.count("*").alias("n"))
    if hit.join(every, ["kind", "id"], "left_anti").head(1):
        raise ValueError("the scenarios were simulated on another model")
    return every.join(hit, ["kind", "id"], "left").groupBy("kind").agg(F.count("n").alias("covered"), F.count("*").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))


def compare(a: Run, b: Run, model: Model) -> dict:
    """Elements walked by one run only, by both and by neither, and the share of those walked that both walked."""
    every = model.elements()
    if not a.visited | b.visited <= every:
        raise ValueError("the runs are of another model")
    both, either = a.visited & b.visited, a.visited | b.visited
    return {"a_only": a.visited - b.visited, "b_only": b.visited - a.visited, "both": both, "neither": every - either, "agreement": len(both) / len(either) if either else 0.0}


def compare_all(found: DataFrame, name: str) -> DataFrame:
    """(variant, a_only, b_only, both, agreement) of the scenario called name against each other one."""
    one = found.where(F.col("variant") == name).select(F.col("visited").alias("one"))  # a single row
    t = found.where(F.col("variant") != name).crossJoin(F.broadcast(one))
    both, either = F.size(F.array_intersect("one", "visited")), F.size(F.array_union("one", "visited"))
    return t.select("variant", F.size(F.array_except("one", "visited")).alias("a_only"), F.size(F.array_except("visited", "one")).alias("b_only"), both.alias("both"), F.coalesce(F.try_divide(both, either), F.lit(0.0)).alias("agreement"))


def without(model: Model, paths: set[int]) -> Model:
    """The model less some paths, as a check of what their absence breaks."""
    return replace(model, paths={k: p for k, p in model.paths.items() if k not in paths})
