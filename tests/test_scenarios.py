import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.functions.conditions import holds
from eventloom.log import EventLog
from eventloom.operators import alignment, attributes, decisions, dfg, scenarios, skeleton, tree
from eventloom.sources.files import LogError

S, X, P, L = tree.SEQ, tree.XOR, tree.AND, tree.LOOP
leaf, node, TAU = tree.leaf, tree.node, tree.TAU


def log_of(spark, cases: dict[str, str], attrs=None) -> EventLog:
    rows = [(c, a, i) for c, t in cases.items() for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "c string, a string, i long")
    return EventLog.of(df, F.col("c"), F.col("a"), F.timestamp_seconds("i"), F.col("i"), attrs=attrs)


def some_tree(r, depth, labels):
    if not depth or r.random() < 0.2:
        return TAU if r.random() < 0.15 or not labels else leaf(labels.pop())
    op = r.choice([S, X, P, L])
    return node(op, *[some_tree(r, depth - 1, labels) for _ in range(2 if op == L else r.choice([2, 3]))])


def distance(a, b):
    """Insertions and deletions that turn a into b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] if x == y else len(a) + len(b)))
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_alignment_is_nearest(seed):
    r = random.Random(seed)
    t = some_tree(r, 3, list("abcdef"))
    run, replayer = alignment.Runner(t), tree.Replayer(t)
    words, front = set(), {((), run.start)}
    for _ in range(6):
        words |= {w for w, term in front if run.may_end(term)}
        front = {(w + (x,), after) for w, term in front for x, after in run.steps(term)}
        if len(front) > 3000:
            return
    assert all(replayer.replay(w) for w in words)
    for _ in range(5):
        trace = tuple(r.choice([*sorted(t.alphabet()), "?"]) for _ in range(r.randint(0, 3)))
        cost, path = alignment.Aligner(t).align(trace)
        assert replayer.replay(path) and cost == distance(trace, path)
        assert not words or cost <= min(distance(trace, w) for w in words)


def test_alignment_budget():
    t = node(P, *(leaf(a) for a in "abcdefg"))
    assert alignment.Aligner(t, states=3).align(tuple("gfedcba?")) is None
    assert alignment.Aligner(t).align(tuple("gfedcba?")) == (1, tuple("gfedcba"))


def test_traversal_with_and_without_repair(spark):
    t = node(S, leaf("A"), node(X, leaf("B"), leaf("C")), leaf("D"))
    log = log_of(spark, {"1": "ABD", "2": "ACD", "3": "ABD", "4": "AD?", "5": "DDD"})
    nodes, totals = alignment.traversal_stats(log, t)
    got = totals.first().asDict()
    assert (got["total"], got["fitting"], got["repaired"], got["unexplained"], got["coverage"]) == (5, 3, 2, 0, 1.0)
    counts = {(r["choice"], r["branch"]): r["visits"] for r in alignment.branch_counts(t, nodes).collect()}
    assert sum(counts.values()) == 5
    _, bare = alignment.traversal_stats(log, t, repair=False)
    assert bare.first()["unexplained"] == 2 and bare.first()["fitting_ratio"] == 0.6
    none, zero = alignment.traversal_stats(log_of(spark, {"1": "A"}).replace(log.df.limit(0)), t)
    assert none.count() == 0 and zero.first()["coverage"] == 0.0


# Attributes and decisions


def test_detection(spark):
    rows = [(c, i, c % 2 == 0, f"v {c % 3}", f"{c}.5", f"{c}x", "same", i, None, "TRUE" if c % 2 else "false") for c in range(100) for i in range(3)]
    df = spark.createDataFrame(rows, "c long, seq long, flag boolean, kind string, amount string, many string, one string, changes long, `a.b` string, spelled string")
    cases, found = attributes.detect(df, "c", "seq")
    by = {a.source: a for a in found}
    assert {n: a.kind for n, a in by.items()} == {"flag": "boolean", "kind": "enumeration", "amount": "integer", "spelled": "boolean"}
    assert by["amount"].scale == 10 and by["kind"].values == (("v 0", "v_0"), ("v 1", "v_1"), ("v 2", "v_2"))
    assert cases.count() == 100 and set(cases.columns) == {"case", *by}
    assert attributes.classify(cases.limit(0)) == []


def test_identifiers():
    assert [attributes.identifier(x) for x in ("case:Claim Value", "3_5", "a--b.", "__x", "!!")] == ["Claim_Value", "_3_5", "a_b", "x", "attr"]
    assert attributes._names(["a b", "a-b"]) == (("a b", "a_b"), ("a-b", "a_b_2"))


def test_forks_are_explained(spark):
    t = node(S, leaf("A"), node(X, leaf("B"), leaf("C"), leaf("D")), node(L, node(X, leaf("E"), leaf("F")), TAU))
    cases, rows = {}, []
    for n in range(120):
        amount, kind = n * 10, "ab"[n % 2]
        cases[str(n)] = "A" + ("B" if amount <= 500 else "C" if kind == "a" else "D") + "EF"
        rows.append((str(n), amount, kind))
    cases["odd"] = "AZ"
    attrs = spark.createDataFrame(rows, "case string, amount long, kind string")
    log = log_of(spark, cases, attrs)
    labels = decisions.branch_labels(log, t)
    assert labels.count() == 120 and {r["choice"] for r in labels.collect()} == {2}
    found = attributes.classify(attrs)
    forks = {f.choice: f for f in decisions.mine_forks(log, t, attrs, found)}
    fork = forks[2]
    assert fork.accuracy == 1.0 and fork.cases == 120 and set(fork.features) == {"amount", "kind"}
    for n in range(120):
        want = [n * 10 <= 500, n * 10 > 500 and n % 2 == 0, n * 10 > 500 and n % 2 == 1]
        assert [holds(c, {"amount": n * 10, "kind": "ab"[n % 2]}) for c in fork.conditions] == want
    assert [f.skipped for c, f in forks.items() if c != 2] == ["no_labelled_cases"]
    reps = attributes.representatives(attrs, labels.select("case", F.col("branch").cast("string").alias("variant")), found)
    got = {(r["variant"], r["attribute"]): r["value"] for r in reps.collect()}
    assert got["0", "amount"] == "250" and got["1", "kind"] == "a" and got["2", "kind"] == "b"


# Scenarios


@pytest.mark.parametrize("seed", range(40))
def test_simulated_parse_walks_its_trace(seed):
    r = random.Random(seed)
    t = some_tree(r, 3, list("abcdefgh"))
    loops = [n for n in tree.numbered(t).values() if n.op == L]
    if any(c.op == L for n in loops for c in tree.numbered(n).values() if c is not n):
        return  # inner loops run their mean
    model = scenarios.model_of(t, None, frozenset(i for i, n in tree.numbered(t).items() if i and n.op and r.random() < 0.3))
    assert model.problems() == []
    run = alignment.Runner(t)
    term, word = run.start, ()
    while len(word) < 9 and run.steps(term) and not (run.may_end(term) and r.random() < 0.4):
        x, term = r.choice(run.steps(term))
        word += (x,)
    if run.may_end(term):
        done = scenarios.simulate(model, scenarios.settings(t, tree.Replayer(t).replay(word)[1]))
        assert not done.problems and sorted(done.trace) == sorted(word)


def kinds(run):
    return Counter(k for k, _, _ in run.problems)


def test_problems():
    m = scenarios
    fork = m.model_of(node(X, leaf("A"), leaf("B")), {(0, 0): "x > 1", (0, 1): "x > 2"})
    assert kinds(m.simulate(fork, {"x": 0})) == {m.NO_BRANCH: 1, m.UNREACHED: 1}
    assert kinds(m.simulate(fork, {"x": 3})) == {m.MANY_BRANCHES: 1, m.UNREACHED: 1}
    assert not m.simulate(fork, {"x": 2}).problems
    loop = m.model_of(node(L, leaf("A"), TAU))
    assert m.simulate(loop, {"loop_0": 5}).trace == tuple("AAAAA")
    assert kinds(m.simulate(loop, {"loop_0": 500}, 20)) == {m.ENDLESS: 1, m.UNREACHED: 1}
    both = m.model_of(node(P, leaf("A"), leaf("B")))
    gap = next(p.id for p in both.paths.values() if both.steps[p.source].label == "A")
    broken = m.without(both, {gap})
    target = both.paths[gap].target
    assert broken.problems()
    waits = m.Model(both.root, both.steps, {**broken.paths, 99: m.Path(99, target, target)})
    assert kinds(m.simulate(waits, {})) == {m.BLOCKED: 1, m.UNREACHED: 1}


def test_stubs():
    m = scenarios
    model = m.model_of(node(S, leaf("A"), node(P, leaf("B"), leaf("C"))), None, frozenset({2}))
    stub = next(s for s in model.steps.values() if s.kind == m.STUB)
    assert sorted(m.simulate(model, {}).trace) == ["A", "B", "C"]
    for kind, plugins, problem in ((m.STUB, (("part_2", "true"), ("part_2", "x == 1")), m.MANY_PLUGINS), (m.STUB, (), m.NO_PLUGIN), ("timer", (), m.UNSUPPORTED)):
        model.steps[stub.id] = m.Step(stub.id, kind, stub.map, stub.label, None, plugins)
        assert kinds(m.simulate(model, {"x": 1}))[problem] == 1


def test_scenarios_cover_the_model(spark):
    t = node(S, leaf("A"), node(X, leaf("B"), leaf("C")), node(L, leaf("D"), TAU))
    log = log_of(spark, {"1": "ABD", "2": "ABD", "3": "ACDD", "4": "ZZ"})
    model = scenarios.model_of(t)
    found = scenarios.scenarios(log, t, model)
    rows = {r["variant"]: r for r in found.collect()}
    assert [(rows[v]["cases"], "".join(rows[v]["trace"]), rows[v]["problems"]) for v in ("v1", "v2")] == [(2, "ABD", []), (1, "ACDD", [])]
    assert all(r["covered"] == r["total"] for r in scenarios.coverage(found, model).collect())
    part = {r["kind"]: (r["covered"], r["total"]) for r in scenarios.coverage(found.where("variant = 'v1'"), model).collect()}
    assert part[scenarios.ACT] == (3, 4)
    a, b = (scenarios.simulate(model, {k: tuple(v) for k, v in rows[v]["settings"].items()}) for v in ("v1", "v2"))
    c, d = scenarios.compare(a, b, model), scenarios.compare_all(found, "v1").first()
    assert (len(c["a_only"]), len(c["b_only"]), len(c["both"]), c["agreement"]) == (d["a_only"], d["b_only"], d["both"], d["agreement"])
    with pytest.raises(ValueError):
        scenarios.coverage(found, scenarios.model_of(leaf("A")))


def test_loop_suggestions():
    body = node(S, node(X, leaf("a"), leaf("b"), leaf("c")), node(X, leaf("x"), leaf("y")))
    assert scenarios.suggest_loop_iterations(node(L, body, node(X, leaf("p"), leaf("q"), leaf("r")))) == {0: 4}
    assert scenarios.suggest_loop_iterations(node(L, node(L, body, TAU), TAU)) == {0: 2, 1: 3}


# Graphs and families


@pytest.mark.parametrize("traces", [["ab", "ac"], ["abc", "acb"], ["a", "aba", "ababa"], ["ab", "b"], ["abcd", "acbd", "aed"], ["aa", "a"], ["abd", "ad", "bd"], ["ab", "ba", "a"]])
def test_graph_mining(spark, traces):
    log = log_of(spark, {str(i): t for i, t in enumerate(traces)})
    t = dfg.discover(log)
    assert all(tree.Replayer(t).replay(tuple(x)) for x in traces), str(t)


def test_graph_limit(spark, monkeypatch):
    monkeypatch.setattr(dfg, "MAX_EDGES", 2)
    with pytest.raises(LogError):
        dfg.discover(log_of(spark, {"1": "abc"}))


def test_skeleton():
    trees = [node(S, leaf("a"), node(P, leaf("b"), leaf("c")), leaf("d")), node(S, leaf("a"), node(X, leaf("b"), leaf("c")), leaf("d")), node(S, leaf("a"), node(P, leaf("c"), leaf("b")), leaf("d"))]
    s = skeleton.merge([((i,), t) for i, t in enumerate(trees)])
    assert s.children[1].op == skeleton.VARIES and s.children[1].cells == ((0, 2), (1,))
    for i, t in enumerate(trees):
        own, alias = skeleton.configured(s, i)
        assert skeleton.canonical(own) == skeleton.canonical(t) and len(alias) == len(tree.numbered(own))
    (choice,) = skeleton.choices(s)
    assert choice["name"] == "after a" and choice["branches"] == ["b", "c"] and not choice["shared"]
    short = skeleton.merge([((0,), node(S, leaf("a"), leaf("b"))), ((1,), node(S, leaf("a"), leaf("x"), leaf("y"), leaf("b")))])
    assert [c.op or c.label for c in short.children] == ["a", skeleton.VARIES, "b"]


def test_family_choices(spark):
    cases = {"1": "abd", "2": "acd", "3": "abd", "4": "ad", "5": "abd"}
    cells = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("4", "y"), ("5", "y")], "case string, axis1 string")
    rows, skel = skeleton.family_choices(log_of(spark, cases), cells)
    got = {(r["axis1"], r["label"]): r["n"] for r in rows.collect() if r["name"] == "after a" and r["label"] != "(skip)"}
    counts = Counter((r["axis1"], r["n"]) for r in rows.collect())
    assert got["x", "c"] == 1 and counts["y", 1] == 2  # y: b once, skipped once
    assert any(r["n"] is None for r in rows.collect())  # a choice that only one cell has


def test_alien_runs_are_walked_once(spark):
    t = node(S, leaf("a"), node(X, TAU, leaf("b")), leaf("c"))
    traces = [tuple(x) for n in range(5) for x in itertools.product("abcyz", repeat=n)]
    counts = spark.createDataFrame([(list(x), i + 1) for i, x in enumerate(traces)], "trace array<string>, n long")
    plain = alignment.Aligner(t)
    got = {tuple(r["trace"]): r for r in alignment.walked(counts, t).collect()}
    for x in traces:
        assert (got[x]["cost"], tuple(got[x]["path"])) == plain.align(x)
        assert (got[x]["status"] == "fitting") == (plain.align(x)[0] == 0)
    seen = alignment._walks(counts.select(alignment._core(t).alias("core")).distinct(), t, True, 1000, 1000).count()
    assert seen < len(traces) / 2
    ties = node(X, leaf("b"), leaf("b"), node(P, leaf("c"), node(S, leaf("b"), leaf("a"))))  # where equal paths are told by the place of a run
    odd = tuple("byyayay")
    (row,) = alignment.walked(spark.createDataFrame([(list(odd), 1)], "trace array<string>, n long"), ties).collect()
    assert (row["cost"], tuple(row["path"])) == alignment.Aligner(ties).align(odd)


def test_family_choices_read_the_log_once(spark, monkeypatch):
    cases = {"1": "abd", "2": "acd", "3": "abbd", "4": "ad", "5": "abd", "6": "dcba"}
    cells = spark.createDataFrame([(c, "xy"[int(c) % 2]) for c in cases], "case string, axis1 string")
    log = log_of(spark, cases)
    traces = log.traces().join(cells, "case").groupBy("axis1", "trace").agg(F.count("*").alias("n"))
    assert dfg.trace_graphs(traces) == dfg.graphs(log, cells)
    monkeypatch.setattr(EventLog, "events", lambda self: pytest.fail("the log is windowed again"))
    assert skeleton.family_choices(log, cells)[0].count()


def test_kept_parses_cost_what_they_did():
    t = node(P, *(node(X, TAU, node(L, leaf(a), TAU)) for a in "abc"))
    kept = tree.Replayer(t)
    for x in itertools.product("abc", repeat=5):
        new = tree.Replayer(t)
        assert kept.replay(x) == new.replay(x) and kept.left == new.left
    assert len(kept.dealt) < 40
