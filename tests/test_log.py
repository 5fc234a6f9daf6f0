"""Small logs with known facts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.log import EventLog
from eventloom.operators import families, logfilters, performance, resources, tree, variants, widgets
from eventloom.sources import files


def day(n):
    return dt.datetime(2025, 3, 3) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def parcels(spark):
    """Five parcels: two are packed once, one is not packed, one is packed twice, one is cancelled."""
    steps = {"p1": "Open 0 Pack 2 Ship 5", "p2": "Open 0 Pack 1 Ship 3", "p3": "Open 0 Ship 9", "p4": "Open 0 Pack 1 Pack 4 Ship 6", "p5": "Open 0 Cancel 1"}
    clerk = {"p1": "Ana", "p2": "Ben", "p3": "Ana", "p4": "Ben", "p5": "Cy"}
    rows = []
    for case, text in steps.items():
        words = text.split()
        rows += [(case, a, day(int(n)), clerk[case]) for a, n in zip(words[::2], words[1::2], strict=True)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "c string, a string, t timestamp, r string, i int")
    attrs = [("p1", "north", 7.0), ("p2", "south", 8.0), ("p3", "north", 9.0), ("p4", None, 10.0), ("p5", "south", None)]
    attrs = spark.createDataFrame(attrs, "case string, region string, weight double")
    return EventLog.of(df, F.col("c"), F.col("a"), F.col("t"), F.col("i"), res=F.col("r"), attrs=attrs, numeric=("weight",))


CASES = ("p1", "p2", "p3", "p4", "p5")


def values(log, metric, **params):
    t, _ = widgets.case_values(log, {"metric": metric, "params": params})
    return {r["case"]: r["value"] for r in t.collect()}


def of(*xs):
    return dict(zip(CASES, xs, strict=True))


def test_metrics(parcels):
    assert values(parcels, "duration") == of(5, 3, 9, 6, 1)
    assert values(parcels, "rework") == of(0, 0, 0, 1, 0)
    assert values(parcels, "actFreq", activity="Pack") == of(1, 1, 0, 2, 0)
    assert values(parcels, "actRework", activity="Pack") == of(0, 0, None, 1, None)
    assert values(parcels, "timeBetween", **{"from": "Pack", "to": "Ship"}) == of(3, 2, None, 5, None)
    assert values(parcels, "edgeShare", **{"from": "Open", "to": "Pack"}) == of(1, 1, 0, 1, 0)


def test_formula_nulls(parcels):
    f = lambda text: values(parcels, "custom", formula=text)
    assert f('attr("weight") > 8 and contains("Lose")') == of(0, 0, 0, 0, None)
    assert f('1 / count("Lose")') == dict.fromkeys(CASES)
    assert f('duration() where attr("region") == "north"') == of(5, None, 9, None, None)
    assert f("broken(") == dict.fromkeys(CASES)


def test_filters_on_missing_values(parcels):
    n = lambda f: len(widgets.case_values(parcels, {"metric": "duration", "filters": [f]})[0].collect())
    assert n({"field": "attr:weight", "op": "not", "value": 7.0}) == 3  # a missing number never passes
    assert n({"field": "attr:region", "op": "not", "value": "north"}) == 3  # a missing text does
    assert n({"field": "segment", "value": ["weekday", "Noday"]}) == 0
    assert n({"field": "attr:none", "op": "is", "value": "x"}) == 5
    with pytest.raises(ValueError):
        n({"field": "what", "value": 1})


def test_statistics(parcels):
    a = {r["act"]: r for r in performance.activity_stats(parcels.events()).collect()}
    assert (a["Pack"]["frequency"], a["Pack"]["case_coverage"], a["Pack"]["repeat_frequency"]) == (4, 3, 1)
    assert a["Ship"]["sojourn_median"] == 2.5 * 86400 and a["Open"]["sojourn_mean"] is None
    p = {(r["a"], r["b"]): r["frequency"] for r in performance.pair_stats(parcels.events()).collect()}
    assert p == {("Open", "Pack"): 3, ("Pack", "Ship"): 3, ("Open", "Ship"): 1, ("Pack", "Pack"): 1, ("Open", "Cancel"): 1}
    v = variants.variants(parcels).orderBy("rank").collect()
    assert (v[0]["n"], v[0]["text"]) == (2, "Open → Pack → Ship")
    assert {r["act"]: r["performer"] for r in resources.performers(parcels).collect()} == {"Open": "Ana", "Pack": "Ben", "Ship": "Ana", "Cancel": "Cy"}


def test_log_filters(parcels):
    n = lambda **o: logfilters.apply(parcels, o).df.select("case").distinct().count()
    assert n(variant_ranks=(1, 1)) == 2
    assert n(attr_expr='attr("weight") >= 8') == 3
    assert n(duration_pct=(0, 50)) == 3
    assert n(time_to="2025-03-08 00:00:00", time_mode="traces_contained") == 3
    assert logfilters.apply(parcels, {"activity_ranks": (1, 1)}).df.select("act").distinct().collect()[0][0] == "Open"


@pytest.mark.parametrize("lo, hi", [(0, 100), (0, 40), (20, 60), (40, 41), (60, 60), (90, 100)])
def test_duration_pct_against_a_sorted_list(spark, lo, hi):
    length = [3, 1, 3, 3, 0, 9, 3, 1, 7, 3, 250, 3]
    rows = [(f"c{i:02}", "ab"[k], day(0) + dt.timedelta(hours=h * k), 2 * i + k) for i, h in enumerate(length) for k in (0, 1)]
    log = EventLog.of(spark.createDataFrame(rows, "c string, a string, t timestamp, i int"), F.col("c"), F.col("a"), F.col("t"), F.col("i"))
    kept = {r["case"] for r in logfilters.duration_pct(log, lo, hi).df.select("case").distinct().collect()}
    order = sorted(range(len(length)), key=lambda i: (length[i], i))
    n = len(length)
    assert kept == {f"c{i:02}" for i in order[lo * n // 100 : -(-hi * n // 100)]}


def test_partition_has_unknown(parcels):
    cells = {r["axis1"]: r["n"] for r in families.grid(families.partition(parcels, ["weight"])).collect()}
    assert cells == {"7": 1, "8": 1, "9": 1, "10": 1, "Unknown": 1}


def test_scorecard_and_formats(spark, parcels):
    r = widgets.scorecard(parcels, [{"title": "t", "metric": "duration", "agg": "max", "target": {"value": 8, "dir": "max", "warn": 10}}]).first()
    assert (r["value"], r["goal"], r["state"]) == (9, "≤ 8 d", "risk")
    one = spark.range(1).select(widgets.half_away(F.lit(1.005), 2).alias("x"), widgets.format_value(F.lit(0.5), "time").alias("t"), widgets.format_value(F.lit(None).cast("double"), "count").alias("m")).first()
    assert (one["x"], one["t"], one["m"]) == (1.0, "12 h", "—")


def test_interval_log(spark):
    df = spark.createDataFrame([("c", "A", day(0), day(-1), 0), ("c", "B", day(4), day(2), 1), ("c", "B", day(5), day(9), 2)], "c string, a string, t timestamp, s timestamp, i int")
    log = EventLog.of(df, F.col("c"), F.col("a"), F.col("t"), F.col("i"), start=F.col("s"))
    assert values(log, "duration") == {"c": 6}
    assert values(log, "actService", activity="B") == {"c": 2}  # the bad start is left out
    assert values(log, "actWaiting", activity="B") == {"c": 2}


# Trees

S, X, P, L = tree.SEQ, tree.XOR, tree.AND, tree.LOOP
leaf, node = tree.leaf, tree.node


def fits(t, trace):
    return tree.Replayer(t).replay(tuple(trace))


def test_replay():
    t = node(S, node(P, leaf("m"), node(S, leaf("p"), leaf("q"))), node(X, tree.TAU, leaf("r")))
    assert fits(t, "mpq")[0] == fits(t, "pmq")[0] == fits(t, "pqm")[0] != fits(t, "mpqr")[0]
    assert fits(t, "qpm") is None and fits(t, "mp") is None and fits(t, "mpqrr") is None
    nested = node(L, node(X, leaf("u"), node(L, leaf("v"), leaf("w"))), leaf("y"))
    for trace in ("u", "vwv", "uyvwvwv", "vyuyv", "uyuyvwv"):
        visits = fits(nested, trace)[1]
        assert [visits[n] for n in (2, 4, 5, 6)] == [trace.count(c) for c in "uvwy"]
    assert fits(nested, "vw") is None and fits(nested, "uu") is None


def test_parallel_parts_of_later_rounds_are_parsed_anew():
    t = node(L, node(P, node(X, leaf("c"), leaf("d")), node(X, tree.TAU, leaf("e"))), leaf("z"))
    visits = fits(t, "cezdzec")[1]
    names = {i: n.label for i, n in tree.numbered(t).items()}
    assert {names[i]: k for i, k in visits.items() if names[i]} == {"c": 2, "d": 1, "e": 2, "z": 2}


def test_only_the_budget_bounds_shared_events():
    t = node(P, leaf("a"), node(L, leaf("a"), tree.TAU))  # either part may take any of the events
    for n in (2, 17, 18, 90):
        assert tree.Replayer(t).replay(("a",) * n) is not None
    either = node(L, node(X, leaf("a"), leaf("b")), tree.TAU)
    with pytest.raises(tree.OutOfBudget):
        tree.Replayer(node(P, node(S, either, leaf("c")), either), 5_000).replay(tuple("ab") * 20)


@pytest.mark.parametrize("traces", [["ab", "ac"], ["abc", "acb"], ["a", "aba", "ababa"], ["ab", "b"], ["abcd", "acbd", "aed"], ["x"], ["aa", "a"], ["abab", "ba", "c"]])
def test_discovered_tree_replays_its_log(traces):
    t = tree.inductive({tuple(x): 1 for x in traces})
    assert all(fits(t, x) for x in traces), str(t)


def test_discovery_finds_operators():
    assert tree.inductive({tuple("abc"): 1, tuple("acb"): 1}).op == S
    assert str(tree.inductive({tuple("ab"): 1, tuple("ba"): 1})) == "+('a', 'b')"
    assert tree.inductive({tuple("a"): 1, tuple("b"): 1}).op == X


def test_prune_and_cluster(spark, parcels):
    t = node(X, leaf("A"), leaf("B"), leaf("C"))
    small, removed = tree.prune(t, {0: 100, 1: 90, 2: 8, 3: 2}, min_share=0.05)
    assert str(small) == "X('A', 'B')" and removed == [3]
    model = node(S, leaf("Open"), node(X, tree.TAU, leaf("Pack")), leaf("Ship"))
    groups, cases = tree.cluster(parcels, model)
    assert [(r["variant"], r["cases"]) for r in groups.orderBy("rank").collect()] == [("v1", 2), ("v2", 1)]
    assert {r["case"]: r["variant"] for r in cases.collect()}["p4"] == "noise"


# Files


def test_csv(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("case;what;when\n1;A;2024-01-01 10:00:00\n1;B;2024-01-02T10:00:00\n2;A;31/01/2024 10:00\n2;B;nonsense\n", encoding="utf-8")
    assert files.sniff(spark, str(p)) == (";", "UTF-8")
    raw = files.read_csv(spark, str(p))
    log = files.map_columns(raw, "case", "what", "when")
    assert [(r["case"], r["act"]) for r in log.df.orderBy("ts").collect()] == [("1", "A"), ("1", "B"), ("2", "A")]
    p.write_text("case,what,when\n1,A,x\n1,B,y\n")
    with pytest.raises(files.LogError):
        files.map_columns(files.read_csv(spark, str(p)), "case", "what", "when")


def test_epoch_units(spark):
    for n in (1_700_000_000, 1_700_000_000_000, 1_700_000_000_000_000):
        assert spark.range(1).select(files.parse_epoch(F.lit(n), F.lit(float(n))).cast("long").alias("x")).first()["x"] == 1_700_000_000


def test_xes(spark, tmp_path):
    p = tmp_path / "log.xes"
    p.write_text('<log><trace><string key="concept:name" value="t1"/><event><string key="concept:name" value="A"/><string key="org:resource" value="R"/><date key="time:timestamp" value="2024-01-01T10:00:00Z"/></event><event><string key="concept:name" value="B"/><date key="time:timestamp" value="2024-01-02T10:00:00Z"/></event></trace></log>')
    assert [(r["case"], r["act"], r["res"]) for r in files.read_xes(spark, str(p)).df.orderBy("ts").collect()] == [("t1", "A", "R"), ("t1", "B", None)]
