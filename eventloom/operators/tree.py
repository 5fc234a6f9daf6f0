"""Process trees: model, discovery, replay, traversal counts and pruning.

Trees are small and live on the driver; the work on the log runs over its distinct traces, each replayed once.
"""

from __future__ import annotations

import json
import math
import time
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog
from .variants import trace_counts

SEQ, XOR, AND, LOOP = "->", "X", "+", "*"
NOFIT = "NOFIT"
BUDGET = 200_000
#: Parses of parts of traces that a replayer keeps.
KEPT = 100_000


@dataclass(frozen=True)
class Tree:
    """A leaf (label, None for a silent step) or an operator over children; a loop is do, redo."""

    op: str | None = None
    label: str | None = None
    children: tuple["Tree", ...] = ()

    def __str__(self) -> str:
        return f"{self.op}({', '.join(map(str, self.children))})" if self.op else "tau" if self.label is None else repr(self.label)

    def alphabet(self) -> frozenset[str]:
        return frozenset([self.label] if self.label is not None else ()).union(*(c.alphabet() for c in self.children))


def leaf(label: str | None) -> Tree:
    return Tree(None, label)


def node(op: str, *children: Tree) -> Tree:
    return Tree(op, None, children)


TAU = leaf(None)


def numbered(tree: Tree) -> dict[int, Tree]:
    """Nodes by pre-order number."""
    out: dict[int, Tree] = {}

    def go(t: Tree):
        out[len(out)] = t
        for c in t.children:
            go(c)

    go(tree)
    return out


# Replay


Signature = str | tuple | None


class OutOfBudget(Exception):
    pass


class Replayer:
    """Whether a trace fits, and how often each node is visited, by recursive descent over trace positions.

    A parse of node from position i gives its ends j with a visit count; the first found for each end is
    kept. Parallel children split the trace by their alphabets if these are disjoint, else every distinct way
    to deal the shared events is tried; the budget alone bounds that.
    """

    def __init__(self, tree: Tree, budget: int = BUDGET):
        self.nodes = numbered(tree)
        self.budget = budget
        self.kids: dict[int, list[int]] = {}
        n = 0

        def go(t: Tree) -> int:
            nonlocal n
            own = n
            n += 1
            self.kids[own] = [go(c) for c in t.children]
            return own

        go(tree)
        self.alpha = {i: t.alphabet() for i, t in self.nodes.items()}
        self.dealt: dict[tuple[int, tuple[str, ...]], tuple[int, tuple[Signature, Counter] | None]] = {}

    def replay(self, trace: tuple[str, ...]) -> tuple[str, Counter] | None:
        """(signature as JSON text, visits by node) or None. Raises OutOfBudget."""
        self.left = self.budget
        found = self._ends(0, trace, 0, {}).get(len(trace))
        return found and (json.dumps(found[0], ensure_ascii=False), found[1])

    def _ends(self, i: int, trace: tuple[str, ...], at: int, memo: dict) -> dict[int, tuple[Signature, Counter]]:
        """End position -> (signature, visits) of node i started at ``at``; longest ends first.

        Signatures: a label, None for a silent step, ("->", ...), ("X", node, branch, inner), ("+", ...) and
        ("*", node, runs of the body up to 2, first run).
        """
        key = (i, at)
        if key in memo:
            return memo[key]
        self.left -= 1
        if self.left < 0:
            raise OutOfBudget
        t, kids = self.nodes[i], self.kids[i]
        memo[key] = out = {}
        me = Counter({i: 1})
        if t.op is None:
            if t.label is None:
                out[at] = (None, me)
            elif at < len(trace) and trace[at] == t.label:
                out[at + 1] = (t.label, me)
        elif t.op == SEQ:
            part = {at: ((), me)}
            for k in kids:
                nxt: dict[int, tuple[tuple, Counter]] = {}
                for j in sorted(part, reverse=True):
                    for e, (sig, visits) in self._ends(k, trace, j, memo).items():
                        if e not in nxt:
                            nxt[e] = ((*part[j][0], sig), part[j][1] + visits)
                part = nxt
            out.update({e: ((SEQ, *(s for s in sigs if s is not None)), v) for e, (sigs, v) in part.items()})
        elif t.op == XOR:
            for b, k in enumerate(kids):
                for e, (sig, visits) in self._ends(k, trace, at, memo).items():
                    if e not in out:
                        out[e] = ((XOR, i, b, sig), me + visits)
        elif t.op == AND:
            inside = self.alpha[i]
            stop = at
            while stop < len(trace) and trace[stop] in inside:
                stop += 1
            for e in range(stop, at - 1, -1):
                got = self._parallel(kids, trace[at:e])
                if got:
                    out[e] = ((AND, *(s for s, _ in got)), sum((v for _, v in got), me))
        else:  # loop: do (redo do)*
            seen = {e: (1, sig, me + v) for e, (sig, v) in self._ends(kids[0], trace, at, memo).items()}
            queue = list(seen)
            while queue:
                j = queue.pop(0)
                n, sig, visits = seen[j]
                for r in kids[1:]:
                    for e, (_, rv) in self._ends(r, trace, j, memo).items():
                        for f, (_, dv) in self._ends(kids[0], trace, e, memo).items():
                            if f > j and f not in seen:
                                seen[f] = (n + 1, sig, visits + rv + dv)
                                queue.append(f)
            out.update({e: ((LOOP, i, min(n, 2), sig), v) for e, (n, sig, v) in seen.items()})
        memo[key] = out = dict(sorted(out.items(), reverse=True))
        return out

    def _whole(self, i: int, part: tuple[str, ...]) -> tuple[Signature, Counter] | None:
        """The parse of node i over the whole of a part dealt to it; parts recur, so it is kept with what it cost."""
        key = (i, part)
        if key not in self.dealt:
            before = self.left
            got = self._ends(i, part, 0, {}).get(len(part))
            if len(self.dealt) >= KEPT:
                self.dealt.clear()
            self.dealt[key] = (before - self.left, got)
            return got
        cost, got = self.dealt[key]
        self.left -= cost
        if self.left < 0:
            raise OutOfBudget
        return got

    def _parallel(self, kids: list[int], part: tuple[str, ...]) -> list[tuple[Signature, Counter]] | None:
        if not kids:
            return [] if not part else None
        first, rest = kids[0], kids[1:]
        others = frozenset().union(*(self.alpha[k] for k in rest)) if rest else frozenset()
        own = self.alpha[first]
        splits: dict[tuple[tuple, tuple], None] = {((), ()): None}  # distinct ways to deal the events, in a fixed order
        for a in part:
            if a not in own and a not in others:
                return None
            dealt: dict[tuple[tuple, tuple], None] = {}
            for mine, other in splits:
                self.left -= 1
                if a in own:
                    dealt[(*mine, a), other] = None
                if a in others:
                    dealt[mine, (*other, a)] = None
            if self.left < 0:
                raise OutOfBudget
            splits = dealt
        for mine, other in splits:
            got = self._whole(first, mine)
            if got:
                tail = self._parallel(rest, other)
                if tail is not None:
                    return [got, *tail]
        return None


PARSE_SCHEMA = "trace array<string>, n long, signature string, visits map<int,long>, exhausted boolean"


def parses(counts: DataFrame, tree: Tree, budget: int = BUDGET) -> DataFrame:
    """Distinct traces (trace, n) with signature (NOFIT if none), visits by node and whether the budget ran out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replayer = Replayer(tree, budget)
        for frame in frames:
            rows = []
            for trace, n in zip(frame["trace"], frame["n"], strict=True):
                try:
                    got, over = replayer.replay(tuple(trace)), False
                except OutOfBudget:
                    got, over = None, True
                rows.append((list(trace), n, got[0] if got else NOFIT, dict(got[1]) if got else {}, over))
            yield pd.DataFrame(rows, columns=["trace", "n", "signature", "visits", "exhausted"])

    rows = counts.select("trace", F.col("n").cast("long").alias("n"))
    tasks = 4 * counts.sparkSession.sparkContext.defaultParallelism  # small rows, costly work: dealt by hand
    return rows.repartition(tasks, "trace").mapInPandas(run, PARSE_SCHEMA)


def order_text(signature: str, tree: Tree) -> str:
    """A signature as a partial order: ``X -> (Y || Z)``, a chosen branch in brackets, a loop's body with ^1 or ^>=2."""
    nodes = numbered(tree)
    short = {SEQ: "seq", XOR: "xor", AND: "par", LOOP: "loop"}

    def go(s) -> str | None:
        if s is None or isinstance(s, str):
            return s
        if s[0] == SEQ:
            return " -> ".join(x for x in map(go, s[1:]) if x is not None) or None
        if s[0] == XOR:
            return f"[{go(s[3]) or 'tau'}]"
        if s[0] == LOOP:
            body = nodes[s[1]].children[0]
            return (short[body.op] if body.op else body.label or "tau") + ("^1" if s[2] < 2 else "^>=2")
        parts = [(x, go(x)) for x in s[1:]]
        parts = [(x, t) for x, t in parts if t is not None]
        if len(parts) == 1 and isinstance(parts[0][0], str):
            return parts[0][1]
        return "(" + " || ".join(t for _, t in parts) + ")" if parts else None

    return go(json.loads(signature)) or "tau"


def orders(signature: str) -> int:
    """How many total orders a signature's partial order has; a loop counts as one step."""

    def size(s) -> int:
        if s is None or isinstance(s, str):
            return int(s is not None)
        return 1 if s[0] == LOOP else size(s[3]) if s[0] == XOR else sum(map(size, s[1:]))

    def go(s) -> int:
        if s is None or isinstance(s, str) or s[0] == LOOP:
            return 1
        if s[0] == XOR:
            return go(s[3])
        out = math.prod(map(go, s[1:]))
        if s[0] == AND:
            sizes = [size(x) for x in s[1:]]
            out *= math.factorial(sum(sizes))
            for n in sizes:
                out //= math.factorial(n)
        return out

    return go(json.loads(signature))


def taken_choices(signature: str) -> dict[int, int]:
    """The branch of every choice that a signature takes outside loops."""
    out: dict[int, int] = {}

    def go(s) -> None:
        if isinstance(s, list) and s[0] == XOR:
            out[s[1]] = s[2]
            go(s[3])
        elif isinstance(s, list) and s[0] != LOOP:
            for x in s[1:]:
                go(x)

    go(json.loads(signature))
    return out


def cluster(log: EventLog, tree: Tree) -> tuple[DataFrame, DataFrame]:
    """(variant, signature, cases, sequences, rank) and (case, variant); traces that do not fit are ``noise``.

    The traces are replayed once: their parses are kept for both tables.
    """
    traces, v = trace_counts(log)
    p = parses(v, tree).persist()
    groups = p.where(F.col("signature") != NOFIT).groupBy("signature").agg(F.sum("n").alias("cases"), F.count("*").alias("sequences"))
    groups = groups.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cases"), "signature"))).withColumn("variant", F.concat(F.lit("v"), F.col("rank").cast("string")))
    named = p.select("trace", "signature").join(groups.select("signature", "variant"), "signature", "left")
    return groups, traces.join(named, "trace").select("case", F.coalesce("variant", F.lit("noise")).alias("variant"))


def fitness(groups: DataFrame, cases: DataFrame) -> DataFrame:
    """One row of a clustering: cases, fitting, variants, sequences, fitness and compression (variants to sequences)."""
    one = groups.agg(F.coalesce(F.sum("cases"), F.lit(0)).alias("fitting"), F.count("*").alias("variants"), F.coalesce(F.sum("sequences"), F.lit(0)).alias("sequences"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return one.withColumn("cases", F.lit(cases.count())).withColumn("fitness", share("fitting", "cases")).withColumn("compression", share("variants", "sequences"))


def named_variants(groups: DataFrame, names: list[str]) -> list[str]:
    """Variant ids that names stand for: ids, or scenario names that begin with one; raises for any other."""
    if not names:
        raise ValueError("no variants are named")
    wanted = {n: n.split("_", 1)[0] for n in map(str, names)}
    have = {r["variant"] for r in groups.where(F.col("variant").isin([*wanted, *wanted.values()])).select("variant").collect()}
    if unknown := [n for n, v in wanted.items() if n not in have and v not in have]:
        raise ValueError(f"no variants of this clustering: {unknown}")
    return list(dict.fromkeys(n if n in have else v for n, v in wanted.items()))


def keep_variants(log: EventLog, clustering: tuple[DataFrame, DataFrame], names: list[str]) -> EventLog:
    """The log's cases of the named behavioural variants; cases that fit no variant go."""
    groups, cases = clustering
    return log.keep_cases(cases.where(F.col("variant").isin(named_variants(groups, names))))


def replay_estimate(log: EventLog, tree: Tree, probe: int = 50, box: float = 1.0) -> dict:
    """Seconds a replay of the whole log would take, from a probe of distinct traces chosen by hash."""
    _, counts = trace_counts(log)
    total = counts.count()
    some = [tuple(r["trace"]) for r in counts.orderBy(F.xxhash64("trace"), "trace").limit(probe).collect()]
    replayer, began, done = Replayer(tree), time.perf_counter(), 0
    for trace in some:
        try:
            replayer.replay(trace)
        except OutOfBudget:
            pass
        done += 1
        if time.perf_counter() - began > box:
            break
    each = (time.perf_counter() - began) / max(1, done)
    return {"sequences": total, "probed": done, "seconds": each * total, "exact": done == total}


def traversal(log: EventLog, tree: Tree) -> DataFrame:
    """(node, visits, cases): how often, and in how many fitting cases, each node is walked."""
    _, v = trace_counts(log)
    return parses(v, tree).where(F.col("signature") != NOFIT).select("n", F.explode("visits").alias("node", "k")).groupBy("node").agg(F.sum(F.col("k") * F.col("n")).alias("visits"), F.sum("n").alias("cases"))


def prune(tree: Tree, cases: dict[int, int], min_cases: int = 0, min_share: float = 0.0) -> tuple[Tree, list[int]]:
    """The tree without choice branches that too few cases walk, and the removed nodes; each choice keeps its best branch."""
    removed: list[int] = []
    counter = iter(range(len(numbered(tree))))

    def skip(t: Tree):
        for c in t.children:
            next(counter)
            skip(c)

    def go(t: Tree, own: int) -> Tree:
        kids, ids = [], []
        walked = cases.get(own, 0)
        plan = []
        for c in t.children:
            k = next(counter)
            mark = len(removed)
            plan.append((c, k, go(c, k), mark))
        best = max(plan, key=lambda p: cases.get(p[1], 0))[1] if plan else None
        for n, (_, k, new, _) in enumerate(plan):
            count = cases.get(k, 0)
            rare = count < min_cases or walked and count / walked < min_share
            if t.op == XOR and k != best and rare or t.op == LOOP and n > 0 and rare and new != TAU:
                removed.append(k)
                continue
            kids.append(new)
            ids.append(k)
        if t.op == LOOP and len(kids) == 1 or t.op in (XOR, SEQ, AND) and len(kids) == 1:
            return kids[0]
        flat: list[Tree] = []
        for c in kids:
            flat.extend(c.children if t.op in (XOR, SEQ, AND) and c.op == t.op else [c])
        return Tree(t.op, t.label, tuple(flat))

    return go(tree, next(counter)), sorted(removed)


def pruned_cases(log: EventLog, tree: Tree, removed: list[int]) -> DataFrame:
    """Cases that walked a removed node."""
    traces, v = trace_counts(log)
    hit = parses(v, tree).where(F.arrays_overlap(F.map_keys("visits"), F.array(*map(F.lit, removed)))) if removed else parses(v, tree).limit(0)
    return traces.join(hit.select("trace"), "trace", "left_semi").select("case")


# Discovery: cuts of the directly-follows graph over distinct traces with weights


def discover(log: EventLog, noise: float = 0.0) -> Tree:
    """The tree that recursive cuts find; traces are grouped in Spark, so the driver sees distinct ones only."""
    _, v = trace_counts(log)
    return inductive({tuple(r["trace"]): r["n"] for r in v.select("trace", "n").toLocalIterator()}, noise)


def inductive(traces: dict[tuple[str, ...], int], noise: float = 0.0) -> Tree:
    if () in traces:
        rest = {t: n for t, n in traces.items() if t}
        if not rest:
            return TAU
        if traces[()] < noise * sum(traces.values()):
            return inductive(rest, noise)
        return node(XOR, TAU, inductive(rest, noise))
    acts = sorted({a for t in traces for a in t})
    if len(acts) == 1:
        if all(len(t) == 1 for t in traces):
            return leaf(acts[0])
        return node(LOOP, leaf(acts[0]), TAU)
    follows: Counter = Counter()
    for t, n in traces.items():
        for a, b in zip(t, t[1:], strict=False):
            follows[a, b] += n
    starts, ends = {t[0] for t in traces}, {t[-1] for t in traces}
    if noise:
        most = {a: max((n for (x, _), n in follows.items() if x == a), default=0) for a in acts}
        follows = Counter({(a, b): n for (a, b), n in follows.items() if n >= noise * most[a]})
    edges = set(follows)
    for cut, split in ((_xor_cut, _split_xor), (_seq_cut, _split_project), (_and_cut, _split_project), (_loop_cut, _split_loop)):
        groups = cut(acts, edges, starts, ends)
        if groups and len(groups) > 1:
            op = {_xor_cut: XOR, _seq_cut: SEQ, _and_cut: AND, _loop_cut: LOOP}[cut]
            parts = split(traces, groups)
            kids = [inductive(p, noise) if p else TAU for p in parts]
            if op == LOOP and len(kids) > 2:
                kids = [kids[0], node(XOR, *kids[1:])]
            return node(op, *kids)
    return node(LOOP, node(XOR, *map(leaf, acts)), TAU)  # the flower: anything goes


def _closure(acts: list[str], edges: set) -> dict[str, set[str]]:
    nxt = defaultdict(set)
    for a, b in edges:
        nxt[a].add(b)
    out = {}
    for a in acts:
        seen, todo = set(), list(nxt[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo.extend(nxt[b])
        out[a] = seen
    return out


def _merge(acts: list[str], together) -> list[list[str]]:
    group = {a: {a} for a in acts}
    for a in acts:
        for b in acts:
            if group[a] is not group[b] and together(a, b):
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    return sorted({id(g): sorted(g) for g in group.values()}.values())


def _xor_cut(acts, edges, starts, ends):
    return _merge(acts, lambda a, b: (a, b) in edges or (b, a) in edges)


def _seq_cut(acts, edges, starts, ends):
    reach = _closure(acts, edges)
    groups = _merge(acts, lambda a, b: (b in reach[a]) == (a in reach[b]))
    changed = True
    while changed:  # groups must be totally ordered by reachability
        changed = False
        for x in groups:
            for y in groups:
                if x is not y and not (all(b in reach[a] and a not in reach[b] for a in x for b in y) or all(a in reach[b] and b not in reach[a] for a in x for b in y)):
                    groups = [g for g in groups if g is not x and g is not y] + [sorted(x + y)]
                    changed = True
                    break
            if changed:
                break
    return sorted(groups, key=lambda g: sum(g[0] not in reach[h[0]] for h in groups if h is not g), reverse=False) if len(groups) < 2 else sorted(groups, key=lambda g: -sum(h[0] in reach[g[0]] for h in groups if h is not g))


def _and_cut(acts, edges, starts, ends):
    groups = _merge(acts, lambda a, b: not ((a, b) in edges and (b, a) in edges))
    good = [g for g in groups if starts & set(g) and ends & set(g)]
    if not good:
        return None
    for g in groups:
        if g not in good:
            good[0] = sorted(good[0] + g)
    return good


def _loop_cut(acts, edges, starts, ends):
    body = starts | ends
    rest = [a for a in acts if a not in body]
    groups = _merge(rest, lambda a, b: (a, b) in edges or (b, a) in edges)
    do, redo = set(body), []
    for g in groups:
        s = set(g)
        into = {a for a, b in edges if b in s and a not in s}
        out = {b for a, b in edges if a in s and b not in s}
        firsts, lasts = {b for a, b in edges if b in s and a in ends}, {a for a, b in edges if a in s and b in starts}
        whole = all((e, f) in edges for f in firsts for e in ends) and all((x, st) in edges for x in lasts for st in starts)
        if into <= ends and out <= starts and into and out and whole:
            redo.append(g)
        else:
            do |= s
    return [sorted(do), *redo] if redo else None


def _split_xor(traces, groups):
    where = {a: i for i, g in enumerate(groups) for a in g}
    parts: list[Counter] = [Counter() for _ in groups]
    for t, n in traces.items():
        best = Counter(where[a] for a in t).most_common(1)[0][0]
        parts[best][tuple(a for a in t if where[a] == best)] += n
    return parts


def _split_project(traces, groups):
    parts: list[Counter] = [Counter() for _ in groups]
    for t, n in traces.items():
        for i, g in enumerate(groups):
            parts[i][tuple(a for a in t if a in g)] += n
    return parts


def _split_loop(traces, groups):
    where = {a: i for i, g in enumerate(groups) for a in g}
    parts: list[Counter] = [Counter() for _ in groups]
    for t, n in traces.items():
        run, own = [], 0
        for a in t:
            if where[a] != own:
                parts[own][tuple(run)] += n
                if own and where[a]:
                    parts[0][()] += n
                run, own = [], where[a]
            run.append(a)
        parts[own][tuple(run)] += n
    return parts


def to_json(tree: Tree) -> str:
    return json.dumps({"op": tree.op, "label": tree.label, "children": [json.loads(to_json(c)) for c in tree.children]})
