"""Signatures, reports, charts, suggestions, files: small logs with facts worked out by hand."""

import datetime as dt
import gzip
import itertools
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from eventloom.log import EventLog
from eventloom.operators import families, performance, reports, suggest, tree, variants, widgets
from eventloom.operators.decisions import Fork
from eventloom.sources import files

S, X, P, L = tree.SEQ, tree.XOR, tree.AND, tree.LOOP
leaf, node = tree.leaf, tree.node


def log_of(spark, traces, attrs=None, **how):
    """A case per trace, an hour between events."""
    begin = dt.datetime(2025, 6, 2)
    rows = [(f"k{i:03}", a, begin + dt.timedelta(days=i, hours=n), 100 * i + n) for i, t in enumerate(traces) for n, a in enumerate(t)]
    df = spark.createDataFrame(rows, "c string, a string, t timestamp, i int")
    return EventLog.of(df, F.col("c"), F.col("a"), F.col("t"), F.col("i"), attrs=attrs, **how)


MODEL = node(S, leaf("start"), node(P, node(S, leaf("b"), leaf("c")), leaf("d"), node(X, tree.TAU, leaf("e"))), node(L, leaf("f"), leaf("g")))


def fitting():
    """All traces of the model with a loop of one or two rounds, by brute force over the orders of the parallel part."""
    out = {}
    for extra in ((), ("e",)):
        for inner in set(itertools.permutations(["b", "c", "d", *extra])):
            if inner.index("b") < inner.index("c"):
                for rounds in (["f"], ["f", "g", "f"]):
                    out[("start", *inner, *rounds)] = (bool(extra), len(rounds))
    return out


def test_partial_orders_and_their_number():
    groups = {}
    for trace, kind in fitting().items():
        groups.setdefault((tree.Replayer(MODEL).replay(trace)[0], kind), set()).add(trace)
    assert len(groups) == 4
    for (signature, (extra, rounds)), traces in groups.items():
        assert tree.orders(signature) == len(traces)  # the loop counts as one step
        inside = "(b -> c || d || [e])" if extra else "(b -> c || d || [tau])"
        assert tree.order_text(signature, MODEL) == f"start -> {inside} -> f{'^1' if rounds == 1 else '^>=2'}"
        assert list(tree.taken_choices(signature).values()) == [int(extra)]
    silent = node(P, leaf("a"), node(X, tree.TAU, leaf("b")))
    assert tree.order_text(tree.Replayer(silent).replay(("a",))[0], silent) == "(a || [tau])"
    assert tree.order_text(tree.Replayer(node(P, leaf("a"), tree.TAU)).replay(("a",))[0], node(P, leaf("a"), tree.TAU)) == "a"


@pytest.fixture(scope="module")
def clustered(spark):
    traces = [t for n, t in enumerate(sorted(fitting())) for _ in range(1 + n % 3)] + [("start", "f"), ("x",)]
    log = log_of(spark, traces)
    return log, tree.cluster(log, MODEL), traces


def test_variants_report(spark, clustered, tmp_path):
    log, clustering, traces = clustered
    rows = reports.variants_report(log, MODEL, clustering).orderBy("place").collect()
    assert [r["variant_id"] for r in rows] == ["v1", "v2", "v3", "v4", "noise", "totals"]
    kinds = fitting()
    for r in rows[:4]:
        kind = ("[e]" in r["partial_order_expression"], 3 if ">=2" in r["partial_order_expression"] else 1)
        own = [i for i, t in enumerate(traces) if kinds.get(t) == kind]
        assert (r["frequency"], r["sequence_variants"], r["linearization_count"]) == (len(own), len({traces[i] for i in own}), str(len({traces[i] for i in own})))
        shown = ", ".join(f"k{i:03}" for i in own[:5])
        assert r["sample_case_ids"] == (shown + f", +{len(own) - 5} more" if len(own) > 5 else shown)
    assert rows[4]["frequency"] == 2 and rows[4]["sample_case_ids"] == f"k{len(traces) - 2:03}, k{len(traces) - 1:03}"
    assert rows[5]["frequency"] == len(traces) and rows[5]["partial_order_expression"].startswith(f"fitness={(len(traces) - 2) / len(traces):.3f}, compression={4 / len(kinds):.3f}")
    reports.write_report(reports.variants_report(log, MODEL, clustering), f"{tmp_path}/v")
    assert [r["variant_id"] for r in spark.read.csv(f"{tmp_path}/v", header=True).collect()] == [r["variant_id"] for r in rows]
    assert reports.case_variant_map(clustering).where("variant_id = 'noise'").count() == 2


def test_named_variants(clustered):
    log, clustering, _ = clustered
    groups = clustering[0]
    assert tree.named_variants(groups, ["v2", "v1_Pack", "v2_again"]) == ["v2", "v1"]
    with pytest.raises(ValueError, match="v9"):
        tree.named_variants(groups, ["v1", "v9"])
    with pytest.raises(ValueError):
        tree.named_variants(groups, [])
    size = {r["variant"]: r["cases"] for r in groups.collect()}
    assert tree.keep_variants(log, clustering, ["v3", "v1_x"]).df.select("case").distinct().count() == size["v3"] + size["v1"]
    one = tree.fitness(*clustering).first()
    assert (one["variants"], one["sequences"]) == (4, len(fitting()))


def test_replay_estimate(clustered):
    found = tree.replay_estimate(clustered[0], MODEL)
    assert found["sequences"] == len(fitting()) + 2 and found["probed"] == min(50, found["sequences"]) and found["seconds"] > 0


def test_condition_report(clustered):
    forks = [Fork(3, ("a > 1", "!(a > 1)"), 0.75, 8, ("a",)), Fork(7, ("false", "false", "false"), skipped="no_labelled_cases")]
    rows = reports.condition_report(clustered[0], forks).collect()
    assert [tuple(r) for r in rows[:2]] == [(3, 2, 0, "0.7500", 8, "a", None, "a > 1"), (3, 2, 1, "0.7500", 8, "a", None, "!(a > 1)")]
    assert len(rows) == 5 and rows[4]["accuracy"] is None and rows[4]["skipped_reason"] == "no_labelled_cases"


def test_ranks_of_many_equal_variants(spark):
    traces = list(itertools.product("abc", repeat=4)) + [("a", "b")] * 3 + [("z",)] * 2
    v = variants.ranked(variants.trace_counts(log_of(spark, traces))[1]).orderBy("rank").collect()
    order = [("a", "b"), ("z",), *sorted(set(traces) - {("a", "b"), ("z",)})]
    assert [tuple(r["trace"]) for r in v] == order and [r["rank"] for r in v] == list(range(1, len(order) + 1))
    assert [r["covered"] for r in v] == list(itertools.accumulate(r["n"] for r in v))


# Suggestions


def test_loops_and_parallel_pairs_are_told_apart_by_the_returning_cases(spark):
    parallel = [tuple("sabt")] * 6 + [tuple("sbat")] * 6
    loop = [tuple("scdcdu")] * 6 + [tuple("scdu")] * 4
    lopsided = [tuple("pq")] * 9 + [tuple("pqpq")] * 1 + [tuple("qp")] * 5
    found = {(r["a"], r["b"]): r["interleaved"] for r in suggest.both_ways(log_of(spark, parallel + loop + lopsided)).collect()}
    assert found == {("a", "b"): True, ("b", "a"): True, ("c", "d"): False, ("d", "c"): False, ("p", "q"): True, ("q", "p"): True}
    uneven = [tuple("pq")] * 9 + [tuple("pqp")] * 2 + [tuple("qp")] * 1
    found = {(r["a"], r["b"]): r["interleaved"] for r in suggest.both_ways(log_of(spark, uneven)).collect()}
    assert found == {("p", "q"): False, ("q", "p"): True}  # 2 of 3 that return went forth; 2 of 11 the other way


def test_decision_points(spark):
    traces = [tuple("sabt")] * 10 + [tuple("sbat")] * 10 + [tuple("smt")] * 12 + [tuple("snt")] * 10 + [tuple("sot")] * 1 + [tuple("sst")] * 3 + [tuple("rx"), tuple("ry")]
    got = sorted((r["act"], r["b"], r["cases"]) for r in suggest.decision_points(log_of(spark, traces)).collect())
    # a and b are halves of a split, o is too rare, s to s is rework, r is reached by too few
    assert got == [("s", "m", 12), ("s", "n", 10)]


def test_targets_scores_and_guards(spark):
    assert suggest.significant(12.3456) == 12.3 and suggest.significant(0.0012345) == 0.00123 and suggest.significant(float("inf")) == 0
    assert suggest.baseline_target(10.0) == {"on": False, "dir": "max", "value": 10.0, "warn": 12.0} and suggest.baseline_target(0) is None
    traces = [tuple("ab") if i % 2 else tuple("acd") for i in range(40)]
    attrs = spark.createDataFrame([(f"k{i:03}", "odd" if i % 2 else "even", f"id{i}", "same", float(i % 3)) for i in range(40)], "case string, kind string, number string, flat string, level double")
    log = log_of(spark, traces, attrs, numeric=("level",))
    scores = {r["attribute"]: r for r in suggest.attribute_scores(log).collect()}
    assert set(scores) == {"kind", "level"} and scores["kind"]["divergence"] == 1 and scores["kind"]["strong"] and not scores["level"]["strong"]
    assert suggest.draws(log, {"metric": "duration", "agg": "avg", "viz": "bar", "segment": {"rows": "attr:kind"}})
    assert not suggest.draws(log, {"metric": "duration", "agg": "avg", "viz": "bar", "segment": {"rows": "attr:flat"}})
    boards = {b["name"]: b["widgets"] for b in suggest.suggest_dashboards(log)}
    assert boards["overview"][0]["baseline"]["on"] is False and [w["segment"]["rows"] for w in boards["segments"]] == ["attr:kind", "attr:level"]


# Axes and charts


def test_numeric_axis(spark):
    traces = [tuple("ab")] * 40
    attrs = spark.createDataFrame([(f"k{i:03}", float(i % 3), i * 1.5) for i in range(40)] + [("other", 77.0, 1e9)], "case string, few double, many double")
    log = log_of(spark, traces, attrs, numeric=("few", "many"))
    count = lambda a: {r["r"]: r["n"] for r in widgets.compute_widget(log, {"metric": "eventCount", "agg": "avg", "segment": {"rows": f"attr:{a}"}}).where("r IS NOT NULL").collect()}
    assert count("few") == {"0": 14, "1": 13, "2": 13}
    assert count("many") == {"0–14.62": 10, "14.62–29.25": 10, "29.25–43.88": 10, "43.88–58.50": 10} or sum(count("many").values()) == 40 and len(count("many")) == 4
    assert widgets.numeric_bins(log, "few") == ([0.0, 1.0, 2.0, 2.0], ["0", "1", "2"])


def test_charts(spark):
    problem = widgets.viz_problem
    assert problem({"metric": "duration", "viz": "kpi"}) is None and problem({"metric": "duration", "viz": "kpi", "segment": {"rows": "month"}})
    assert problem({"metric": "duration", "viz": "gauge"}) and problem({"metric": "duration", "viz": "gauge", "target": {"value": 1}}) is None
    assert problem({"metric": "wip", "viz": "hist"}) and problem({"metric": "duration", "viz": "box"}) is None
    assert problem({"metric": "duration", "viz": "line", "segment": {"rows": "resource"}}) and problem({"metric": "wip", "viz": "line"}) is None
    assert problem({"metric": "duration", "agg": "avg", "viz": "pie", "segment": {"rows": "month"}}) and problem({"metric": "duration", "agg": "sum", "viz": "pie", "segment": {"rows": "month"}}) is None
    assert problem({"metric": "duration", "viz": "table", "segment": {"rows": "month"}}) and problem({"metric": "duration", "viz": "what"})
    out = spark.createDataFrame([(f"r{i:02}", float(i - 2)) for i in range(30)], "r string, value double")
    assert [r["r"] for r in widgets.bars(out, "variant").collect()] == [f"r{i:02}" for i in range(29, 5, -1)] and widgets.bars(out, "month").count() == 30
    pie = {r["label"]: r["value"] for r in widgets.slices(out).collect()}
    assert len(pie) == 8 and pie["Other"] == sum(range(1, 21)) and pie["r29"] == 27
    states = spark.createDataFrame([("met",), (None,), ("risk",)], "s string")
    assert states.agg(widgets.worst_state(F.col("s")).alias("s")).first()["s"] == "risk"


def test_unbound_names_and_axes(spark):
    log = log_of(spark, [("a", "b")], spark.createDataFrame([("k000", 1)], "case string, size int"))
    spec = {"params": {"from": "a", "to": "gone"}, "segment": {"rows": "attr:size", "cols": "attr:lost"}, "filters": [{"field": "contains", "value": "b"}, {"field": "attr:none", "value": 1}]}
    assert widgets.unbound(log, [spec, spec]) == ["attr:none", "gone", "attr:lost"]
    assert widgets.axes(log) == ["year", "quarter", "month", "weekday", "activity", "variant", "attr:size"]


# Families


def test_assigned_cells(spark):
    attrs = [("k000", "Straße", 1.0), ("k001", "STRASSE", 2.0), ("k002", "hof", 3.0), ("k003", None, 4.0), ("k004", "hof", None)]
    log = log_of(spark, [("a", "b")] * 5, spark.createDataFrame(attrs, "case string, place string, n double"), numeric=("n",))
    cells = lambda **o: {r["axis1"]: r["n"] for r in families.cells_of(families.assign(log, ["place"], **o)).collect()}
    assert cells() == {"STRASSE": 2, "hof": 2, "Unknown": 1} and cells(ignore_case=False) == {"hof": 2, "STRASSE": 1, "Straße": 1, "Unknown": 1}
    assert cells(unknown=False) == {"STRASSE": 2, "hof": 2} and cells(include={"place": ["HOF"]}) == {"hof": 2}
    assert cells(max_values=2) == {"STRASSE": 2, "hof": 2, "Unknown": 1}
    assert cells(max_values=1) == {"Other": 4, "Unknown": 1} and cells(max_values=1, other=False) == {"Unknown": 1}
    assert families.dropped_cases(families.assign(log, ["place"], include={"place": ["hof"]})) == 3
    with pytest.raises(ValueError):
        families.assign(log, ["place"], include={"place": ["nowhere"]})
    for bad in ([], ["place", "n", "place"], ["nothing"]):
        with pytest.raises(ValueError):
            families.assign(log, bad)
    ranged = families.cells_of(families.assign(log, ["n"], edges={"n": [0, 2, 3]}, unknown=False)).orderBy("pos1").collect()
    assert [(r["axis1"], r["n"]) for r in ranged] == [("0-2", 1), ("2-3", 2)]
    with pytest.raises(ValueError):
        families.assign(log, ["n"], edges={"n": [3, 2]})
    crossed = families.assign(log, ["place", "n"])
    assert families.coverage_preview(crossed).columns[0] == "axis1" and families.cells_of(crossed, 2).where("NOT skipped").count() == 0


def test_segment_pairs(spark):
    log = log_of(spark, [("start", "b", "d", "c", "f", "g", "f"), ("start", "d", "b", "c", "f")])
    found = {(r["segment"], r["a"], r["b"]): r["frequency"] for r in performance.segment_pairs(MODEL, performance.pair_stats(log.events())).collect()}
    assert found[("0.0", "start", "b")] == 1 and found[("0.0", "start", "d")] == 1 and found[("0.1", "c", "f")] == 2
    assert sum(k for (s, a, b), k in found.items() if (a, b) == ("f", "g")) == 1


# Files

XES = """<log xes.version="1.0"><trace><string key="concept:name" value="t&amp;1"/><int key="amount" value="7"/><float key="rate" value="0.5"/><boolean key="vip" value="true"/><date key="due" value="2025-01-05T00:00:00Z"/>
<event><string key="concept:name" value="A"/><string key="org:resource" value="R"/><date key="start_timestamp" value="2025-01-01T09:00:00Z"/><date key="time:timestamp" value="2025-01-01T10:00:00Z"/></event>
<event><string key="concept:name" value="B"/><date key="time:timestamp" value="2025-01-02T10:00:00Z"/></event></trace><trace><string key="concept:name" value="t2"/><event><string key="concept:name" value="A"/><date key="time:timestamp" value="2025-01-03T10:00:00Z"/></event></trace></log>"""


@pytest.mark.parametrize("kind", ["xes", "xes.gz", "zip"])
def test_xes_with_attributes(spark, tmp_path, kind):
    path = f"{tmp_path}/log.{kind}"
    if kind == "zip":
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("inner.xes", XES)
    else:
        with (gzip.open if kind.endswith("gz") else open)(path, "wt") as f:
            f.write(XES)
    log = files.read_xes(spark, path)
    rows = [tuple(r) for r in log.df.select("case", "act", F.col("start_ts").isNotNull(), "res").orderBy("ts").collect()]
    assert rows == [("t&1", "A", True, "R"), ("t&1", "B", False, None), ("t2", "A", False, None)]
    one = log.attrs.where("case = 't&1'").first()
    assert (one["amount"], one["rate"], one["vip"], one["due"].day) == (7, 0.5, True, 5) and log.numeric == {"amount", "rate"}
    files.write_xes(log, f"{tmp_path}/out")
    again = files.read_xes(spark, f"{tmp_path}/out")
    key = lambda x: sorted(map(str, x.collect()))
    assert key(again.df.drop("seq")) == key(log.df.drop("seq")) and key(again.attrs.select("case", "amount", "vip", "due")) == key(log.attrs.select("case", "amount", "vip", "due"))


def test_mapping_check(spark):
    df = spark.createDataFrame([("1", "a", "2025-01-01", "x"), ("1", "b", "2025-01-02", "y"), ("2", None, "2025-01-03", "z")], "c string, a string, t string, s string")
    assert files.check_mapping(df, "c", "a", "t") == ["'a' is empty in some rows"]
    assert files.check_mapping(df, "c", "nope", "t") == ["no column 'nope'"]
    assert "under half of 's' can be read as times" in files.check_mapping(df, "c", "a", "t", "s")
    assert "every row is a case of its own" in files.check_mapping(df, "t", "c", "t") and "column 't' is mapped twice" in files.check_mapping(df, "t", "c", "t")
    assert files.check_mapping(df.limit(0), "c", "a", "t") == ["the table is empty"]
    assert files.dropped_events(df, "t") == 0 and files.dropped_events(df, "s") == 3


def test_rename_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": "b, c", "d": "e"}))
    (tmp_path / "m.csv").write_text('from,to\na,"b, c"\n d , e\n,x\n')
    assert files.rename_map(spark, f"{tmp_path}/m.json") == files.rename_map(spark, f"{tmp_path}/m.csv") == {"a": "b, c", "d": "e"}
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(files.LogError):
        files.rename_map(spark, f"{tmp_path}/bad.json")


def test_sampled_cases(spark):
    log = log_of(spark, [("a",)] * 300)
    some, n = files.sample_cases(log, 50)
    again, _ = files.sample_cases(log.replace(log.df.repartition(5)), 50)
    ids = lambda x: sorted(r["case"] for r in x.df.select("case").distinct().collect())
    assert n == 300 and len(ids(some)) == 50 and ids(some) == ids(again)
    assert files.sample_cases(log, 300)[0] is log


def test_family_tables_are_made_when_asked_for(spark, monkeypatch):
    from eventloom.operators import skeleton

    monkeypatch.setattr(skeleton, "family_choices", lambda *a, **k: pytest.fail("no choices were asked for"))
    rows = [("1", "a", 1, 1), ("1", "b", 2, 2), ("2", "a", 1, 1)]
    df = spark.createDataFrame(rows, "case string, act string, s int, seq int").withColumn("ts", F.timestamp_seconds("s"))
    log = EventLog(df.drop("s"), spark.createDataFrame([("1", "x"), ("2", "y")], "case string, kind string"))
    stats = families.family_stats(log, ["kind"], min_cases=1)
    assert [tuple(r) for r in families.edge_frame(stats).collect()] == [("a", "b", 1)]
    assert "choices" in stats and stats["edges"] is stats["edges"]


def test_line_statistics_deal_the_lines_once(spark, sf, monkeypatch):
    from eventloom.sources import tables

    monkeypatch.setattr(tables, "TASK_LINES", 500)
    events = tables.line_log(spark, sf).events()
    assert events.rdd.getNumPartitions() >= 12  # 6,000 lines
    for out in (performance.pair_stats(events), performance.activity_stats(events)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1  # read, dealt and sorted once, not once for counts and once for times
