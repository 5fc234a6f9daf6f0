"""Queries over a whole small log against plain counts of it."""

import itertools
import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest

from eventloom.plans.queries import QUERIES

from .test_scenarios import distance


@pytest.fixture(scope="module")
def sessions(spark, tmp_path_factory):
    """(folder, traces): 200 sessions of 1 to 9 events, far more than 30 variants."""
    r = random.Random(3)
    rows, traces = [], []
    for user in range(200):
        traces.append([r.choice("abcd") for _ in range(r.randint(1, 9))])
        rows += [(len(rows) + i, datetime(2024, 1, 1, 12) + timedelta(seconds=i), user, a) for i, a in enumerate(traces[-1])]
    path = tmp_path_factory.mktemp("sessions")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    return str(path), traces


def test_mined_queries_see_every_session(spark, sessions):
    path, traces = sessions
    assert len(set(map(tuple, traces))) > 100
    # every activity may be left out, taken once or looped, in any order: the parse is told by these three alone
    shape = lambda t: tuple(min(t.count(a), 2) for a in "abcd")
    sequences = defaultdict(set)
    for t in traces:
        sequences[shape(t)].add(tuple(t))
    cases = Counter(map(shape, traces))
    got = QUERIES["variant_clusters"](spark, path).collect()
    assert sorted((r["cases"], r["sequences"]) for r in got) == sorted((n, len(sequences[k])) for k, n in cases.items())
    # +(X(tau, *(a, tau)), ...): five nodes an activity after the root
    want = {0: (len(traces), len(traces))}
    for i, a in enumerate("abcd"):
        has, n = sum(a in t for t in traces), sum(t.count(a) for t in traces)
        first = 1 + 5 * i
        want |= {first: (len(traces),) * 2, first + 1: (len(traces) - has,) * 2, first + 2: (has, has), first + 3: (n, has)}
        more = [t.count(a) - 1 for t in traces if t.count(a) > 1]
        want[first + 4] = (sum(more), len(more))
    assert {r["node"]: (r["visits"], r["cases"]) for r in QUERIES["traversal_counts"](spark, path).collect()} == want
    pruned = QUERIES["pruned_tree"](spark, path).first()
    assert pruned["before"] == "+(" + ", ".join(f"X(tau, *('{a}', tau))" for a in "abcd") + ")"
    # a branch goes if under a tenth of all sessions take it; the commoner one of each choice stays
    assert pruned["removed"] == sum(min(h := sum(a in t for t in traces), len(traces) - h) < 0.1 * len(traces) for a in "abcd")


def test_repaired_queries_against_a_brute_force_aligner(spark, tmp_path):
    early = ("AF", "RF", "NF")
    model = [(*a, *["NO"] * k) for n in range(5) for a in itertools.product(early, repeat=n) for k in range(5)]
    r, traces, nearest = random.Random(2), [], []
    while len(traces) < 60:
        t = tuple(r.choice([*early, "NO", "NO", "AO"]) for _ in range(r.randint(1, 4)))
        cost = {w: distance(t, w) for w in model}
        best = [w for w in model if cost[w] == min(cost.values())]
        if len(best) == 1:  # of equal ones the aligner is free
            traces.append(t)
            nearest.append(best[0])
    lines = [(i, 1, 1, n, 1.0, float(n), a[0], a[1], date(2024, 1, 1) + timedelta(days=n)) for i, t in enumerate(traces) for n, a in enumerate(t)]
    orders = [(i, date(2023, 12, 1), "p", "s", 1.0) for i in range(len(traces))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    fit = sum(t == w for t, w in zip(traces, nearest, strict=True))
    got = QUERIES["repaired_totals"](spark, str(tmp_path)).first()
    assert 0 < fit < 60 and (got["total"], got["fitting"], got["repaired"], got["unexplained"], got["sequences"]) == (60, fit, 60 - fit, 0, len(set(traces)))
    assert got["coverage"] == 1.0 and got["fitting_ratio"] == round(fit / 60, 6)
    want = Counter({(c, b): 0 for c, n in ((1, 2), (4, 3), (9, 2)) for b in range(n)})
    for w in nearest:
        want.update([(1, int(any(a in early for a in w))), (9, int("NO" in w)), *((4, early.index(a)) for a in w if a in early)])
    assert {(r["choice"], r["branch"]): r["visits"] for r in QUERIES["repaired_branches"](spark, str(tmp_path)).collect()} == dict(want)
