"""More named queries: suggestions, numeric axes, charts, partitions, families, reports, behavioural variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, families, performance, reports, suggest, tree, variants, widgets
from ..sources.tables import events_log, line_log, sessions_log
from .queries import _line_attributes, _line_tree, _r, add, widget

# Suggestions

_STEPS = """, w AS (SELECT DISTINCT c, a, na AS b FROM ev WHERE na IS NOT NULL AND a <> na),
ed AS (SELECT a, b, count(*) AS cases FROM w GROUP BY a, b),
bo AS (SELECT f.a, f.b, count(*) AS both_n FROM w f JOIN w g ON f.c = g.c AND f.a = g.b AND f.b = g.a GROUP BY f.a, f.b),
il AS (SELECT x.a, x.b, x.cases AS forth, y.cases AS back, coalesce(both_n, 0) AS both_n
       FROM ed x JOIN ed y ON x.a = y.b AND x.b = y.a LEFT JOIN bo ON bo.a = x.a AND bo.b = x.b
       WHERE coalesce(both_n, 0) < 0.5 * y.cases)"""
_POINTS = (
    _STEPS
    + """, rc AS (SELECT a, count(DISTINCT c) AS reach FROM ev GROUP BY a),
br AS (SELECT ed.a, ed.b, cases, cases / reach AS share FROM ed JOIN rc ON rc.a = ed.a
       WHERE reach >= 0.1 * (SELECT count(DISTINCT c) FROM ev) AND cases / reach >= 0.1
         AND NOT EXISTS (SELECT 1 FROM il WHERE il.a = ed.a AND il.b = ed.b)),
ok AS (SELECT * FROM br x WHERE NOT EXISTS
        (SELECT 1 FROM br y JOIN il ON il.a = x.b AND il.b = y.b WHERE y.a = x.a AND y.b <> x.b))
SELECT a AS act, b, cases::BIGINT AS cases, round(share, 6)::DOUBLE AS share FROM ok
WHERE a IN (SELECT a FROM ok GROUP BY a HAVING count(*) >= 2)"""
)


def _decisions(make):
    return lambda s, d: suggest.decision_points(make(s, d)).withColumn("share", _r("share"))


add(
    "suggest_time_share",
    lambda s, d: suggest.time_share(events_log(s, d)).withColumn("share", _r("share")),
    """, p AS (SELECT c, a, sum(greatest(e - pe, 0)) AS s, count(*) AS n FROM ev GROUP BY c, a)
SELECT a AS act, coalesce(sum(s), 0)::BIGINT AS seconds, round(coalesce(sum(s), 0) / sum(sum(s)) OVER (), 6)::DOUBLE AS share,
       count(*)::BIGINT AS reach, (count(*) FILTER (WHERE n > 1))::BIGINT AS repeats FROM p GROUP BY a""",
    "ev",
)
add(
    "interleaving",
    lambda s, d: suggest.interleaving(sessions_log(s, d)).withColumnRenamed("both", "both_n"),
    _STEPS + " SELECT a, b, forth::BIGINT AS forth, back::BIGINT AS back, both_n::BIGINT AS both_n FROM il",
    "se",
)
add("decision_points", _decisions(events_log), _POINTS, "ev")
add(
    "attribute_scores",
    lambda s, d: suggest.attribute_scores(events_log(s, d)).select("attribute", "segments", "coverage", "balance", "strong"),
)
add(
    "baseline_targets",
    lambda s, d: s.createDataFrame(
        [(b["name"], w["metric"], w["agg"], w["baseline"]["value"], w["baseline"]["warn"]) for b in suggest.suggest_dashboards(events_log(s, d)) for w in b["widgets"] if "baseline" in w and "agg" in w],
        "board string, metric string, agg string, value double, warn double",
    ),
    """, du AS (SELECT (e - s) / 86400.0 AS v FROM cs), q AS (SELECT 'median' AS agg, quantile_cont(v, 0.5) AS v FROM du UNION ALL SELECT 'p90', quantile_cont(v, 0.9) FROM du)
SELECT 'overview' AS board, 'duration' AS metric, agg, round(v, 2 - floor(log10(v))::INT)::DOUBLE AS value, round(v * 1.2, 2 - floor(log10(v * 1.2))::INT)::DOUBLE AS warn FROM q WHERE v > 0""",
    "ev",
)

# Numeric axes, grids with every cell, charts

_BALANCE = """, ba AS (SELECT c, balance FROM cs JOIN cu USING (c)),
q AS (SELECT quantile_cont(balance, [0, 0.25, 0.5, 0.75, 1]) AS ed FROM ba),
tx AS (SELECT list_transform(ed, lambda x: CASE WHEN x = floor(x) THEN format('{:.0f}', x) ELSE format('{:.4g}', x) END) AS t, ed FROM q),
lb AS (SELECT ba.c, (balance >= ed[2])::INT + (balance >= ed[3])::INT + (balance >= ed[4])::INT + 1 AS k, t, (cs.e - cs.s) / 86400.0 AS v FROM ba JOIN cs USING (c), tx)"""
widget(
    "duration_by_balance",
    "ev",
    {"metric": "duration", "agg": "median", "segment": {"rows": "attr:balance"}},
    _BALANCE
    + """ SELECT t[k] || '–' || t[k + 1] AS r, round(quantile_cont(v, 0.5), 6)::DOUBLE AS value, count(*)::BIGINT AS n FROM lb GROUP BY 1
UNION ALL SELECT NULL, round(quantile_cont((e - s) / 86400.0, 0.5), 6)::DOUBLE, count(*)::BIGINT FROM cs""",
)
_GRID = {"metric": "eventCount", "agg": "avg", "segment": {"rows": "attr:segment", "cols": "weekday"}}


def _rounded(out: DataFrame) -> DataFrame:
    return out.withColumn("value", _r("value")).withColumn("n", F.col("n").cast("long"))


_CELLS = """, t AS (SELECT segment AS r, strftime(to_timestamp(cs.s), '%A') AS d, n FROM cs JOIN cu USING (c) WHERE segment IS NOT NULL),
g AS (SELECT r, d AS c, avg(n) AS value, count(*) AS n FROM t GROUP BY 1, 2)"""
add(
    "grid_with_empty_cells",
    lambda s, d: _rounded(widgets.grid_cells(widgets.compute_widget(events_log(s, d), _GRID))),
    _CELLS + " SELECT r, c, round(value, 6)::DOUBLE AS value, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT r FROM g) CROSS JOIN (SELECT DISTINCT c FROM g) LEFT JOIN g USING (r, c)",
    "ev",
)
add(
    "all_weekdays",
    lambda s, d: _rounded(widgets.weekday_cells(widgets.compute_widget(line_log(s, d), {"metric": "eventCount", "agg": "avg", "segment": {"rows": "weekday"}, "filters": [{"field": "attr:status", "op": "is", "value": "P"}]}).where("r IS NOT NULL"))),
    """, t AS (SELECT strftime(to_timestamp(cs.s), '%A') AS r, n FROM cs JOIN orders ON c = CAST(o_orderkey AS VARCHAR) WHERE o_orderstatus = 'P'),
g AS (SELECT r, avg(n) AS value, count(*) AS n FROM t GROUP BY 1)
SELECT d AS r, round(value, 6)::DOUBLE AS value, coalesce(n, 0)::BIGINT AS n FROM unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) u(d) LEFT JOIN g ON g.r = d""",
    "li",
)
_BY_VARIANT = {"metric": "eventCount", "agg": "sum", "segment": {"rows": "variant"}}
_VARIANT_SUM = ", g AS (SELECT array_to_string(trace, ' → ') AS r, sum(n)::DOUBLE AS value FROM cs GROUP BY 1)"
add(
    "variant_bars",
    lambda s, d: widgets.bars(widgets.compute_widget(sessions_log(s, d), _BY_VARIANT), "variant").select("r", "value"),
    _VARIANT_SUM + " SELECT r, value FROM g ORDER BY value DESC, r LIMIT 24",
    "se",
)
add(
    "variant_slices",
    lambda s, d: widgets.slices(widgets.compute_widget(sessions_log(s, d), _BY_VARIANT)),
    _VARIANT_SUM + ", k AS (SELECT *, row_number() OVER (ORDER BY value DESC, r) AS k, count(*) OVER () AS m FROM g) SELECT CASE WHEN m > 8 AND k > 7 THEN 'Other' ELSE r END AS label, sum(value)::DOUBLE AS value FROM k GROUP BY 1",
    "se",
)
_STATES = {"metric": "duration", "agg": "avg", "segment": {"rows": "attr:segment"}, "target": {"value": 60, "warn": 75, "dir": "max"}}
add(
    "worst_state",
    lambda s, d: widgets.compute_widget(events_log(s, d), _STATES).agg(widgets.worst_state(F.col("state")).alias("state")),
    """, v AS (SELECT avg((e - s) / 86400.0) AS v FROM cs UNION ALL SELECT avg((e - s) / 86400.0) FROM cs JOIN cu USING (c) WHERE segment IS NOT NULL GROUP BY segment)
SELECT CASE max(CASE WHEN v <= 60 THEN 0 WHEN v <= 75 THEN 1 ELSE 2 END) WHEN 0 THEN 'met' WHEN 1 THEN 'risk' ELSE 'missed' END AS state FROM v""",
    "ev",
)
add(
    "date_span",
    lambda s, d: widgets.date_span(sessions_log(s, d)),
    " SELECT strftime(to_timestamp(min(s)), '%Y-%m-%d') AS first, strftime(to_timestamp(max(s)), '%Y-%m-%d') AS last FROM cs",
    "se",
)
add(
    "common_endpoints",
    lambda s, d: widgets.common_endpoints(sessions_log(s, d)),
    """ SELECT (SELECT trace[1] FROM cs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS first,
       (SELECT trace[-1] FROM cs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS last""",
    "se",
)

# Steps along the segments of a model

_SEGMENTS = """, p AS (SELECT a, na AS b, ns - e AS w FROM ev WHERE na IS NOT NULL),
sg AS (SELECT '1.back' AS segment, a, b FROM unnest(['AF', 'RF', 'NF']) x(a) CROSS JOIN unnest(['AF', 'RF', 'NF']) y(b)
       UNION ALL SELECT '0.0', a, 'NO' FROM unnest(['AF', 'RF', 'NF']) x(a) UNION ALL SELECT '2.back', 'NO', 'NO')"""


def _segment_waits(s: SparkSession, d: str) -> DataFrame:
    log = line_log(s, d)
    found = performance.segment_pairs(_line_tree(), performance.pair_stats(log.events()))
    kinds = {i: t.op for i, t in tree.numbered(_line_tree()).items()}
    loops = sorted(i for i, op in kinds.items() if op == tree.LOOP)
    names = {"0.0": "0.0"} | {f"{i}.back": f"{k}.back" for k, i in enumerate(loops, 1)}
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return found.groupBy(F.element_at(known, F.col("segment")).alias("segment")).agg(F.sum("frequency").alias("frequency"), _r(F.sum("wait_total")).alias("total"))


add("segment_waits", _segment_waits, _SEGMENTS + " SELECT segment, count(*)::BIGINT AS frequency, round(sum(w), 6)::DOUBLE AS total FROM sg JOIN p USING (a, b) GROUP BY 1", "li")

# Partitions and families

_TWO = ["segment", "in_credit"]
add(
    "partition_cells",
    lambda s, d: families.cells_of(families.assign(events_log(s, d), _TWO), 5).drop("pos1", "pos2"),
    " SELECT segment AS axis1, in_credit::VARCHAR AS axis2, count(*)::BIGINT AS n, count(*) < 5 AS skipped FROM cs JOIN cu USING (c) WHERE segment IS NOT NULL AND in_credit IS NOT NULL GROUP BY 1, 2 "
    "UNION ALL SELECT 'Unknown', 'Unknown', count(*)::BIGINT, count(*) < 5 FROM cs WHERE c NOT IN (SELECT c FROM cu) HAVING count(*) > 0",
    "ev",
)
add(
    "partition_included",
    lambda s, d: families.cells_of(families.assign(events_log(s, d), ["segment"], include={"segment": ["building", "MACHINERY"]})).drop("pos1", "skipped"),
    " SELECT segment AS axis1, count(*)::BIGINT AS n FROM cs JOIN cu USING (c) WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY 1",
    "ev",
)
add(
    "partition_edges",
    lambda s, d: families.cells_of(families.assign(events_log(s, d), ["balance"], edges={"balance": [-1000, 0, 5000, 10000]}, unknown=False)).drop("pos1", "skipped"),
    " SELECT CASE WHEN balance < 0 THEN '-1000-0' WHEN balance < 5000 THEN '0-5000' ELSE '5000-10000' END AS axis1, count(*)::BIGINT AS n FROM cs JOIN cu USING (c) WHERE balance BETWEEN -1000 AND 10000 GROUP BY 1",
    "ev",
)
add(
    "partition_bin_labels",
    lambda s, d: families.cells_of(families.assign(events_log(s, d), ["balance"], unknown=False)).select("pos1", "n"),
    _BALANCE + " SELECT k::INT AS pos1, count(*)::BIGINT AS n FROM lb GROUP BY 1",
    "ev",
)


def _family(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return families.family_stats(line_log(s, d), ["status"], min_cases=1)


_CELL = ", ce AS (SELECT cs.*, o_orderstatus AS cell FROM cs JOIN orders ON c = CAST(o_orderkey AS VARCHAR)), ee AS (SELECT ev.*, cell FROM ev JOIN ce USING (c))"
add(
    "family_totals",
    lambda s, d: _family(s, d)["totals"],
    " SELECT count(*)::BIGINT AS covered, 0::BIGINT AS skipped, 0::INT AS dropped, count(*)::BIGINT AS total FROM cs",
    "li",
)
add(
    "family_process_frame",
    lambda s, d: _family(s, d)["process"].select("cell", "cases", "coverage_pct", "events", "activities", "sequence_variants", _r("duration_median").alias("duration_median")),
    _CELL
    + """, a AS (SELECT cell, count(*) AS events, count(DISTINCT a) AS activities FROM ee GROUP BY cell)
SELECT cell, count(*)::BIGINT AS cases, round(100.0 * count(*) / (SELECT count(*) FROM cs), 1)::DOUBLE AS coverage_pct, any_value(events)::BIGINT AS events, any_value(activities)::BIGINT AS activities,
       count(DISTINCT trace)::BIGINT AS sequence_variants, round(quantile_cont(e - s, 0.5), 6)::DOUBLE AS duration_median FROM ce JOIN a USING (cell) GROUP BY cell""",
    "li",
)
add(
    "family_ends",
    lambda s, d: _family(s, d)["ends"].select("axis1", "act", "starts", "ends"),
    _CELL + ", x AS (SELECT cell, trace[1] AS act, 1 AS s, 0 AS e FROM ce UNION ALL SELECT cell, trace[-1], 0, 1 FROM ce) SELECT cell AS axis1, act, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM x GROUP BY 1, 2",
    "li",
)
_PIVOT = ", ".join(f"max(n) FILTER (WHERE cell = '{c}') AS \"{c}\"" for c in "FOP")
add(
    "family_activity_frame",
    lambda s, d: families.activity_frame(_family(s, d)),
    _CELL + f", n AS (SELECT a AS act, cell, count(*)::BIGINT AS n FROM ee GROUP BY 1, 2) SELECT act, {_PIVOT} FROM n GROUP BY act",
    "li",
)
add(
    "family_edge_frame",
    lambda s, d: families.edge_frame(_family(s, d)),
    _CELL + f", n AS (SELECT a, na AS b, cell, count(*)::BIGINT AS n FROM ee WHERE na IS NOT NULL GROUP BY 1, 2, 3) SELECT a, b, {_PIVOT} FROM n GROUP BY a, b",
    "li",
)
add(
    "edge_order",
    lambda s, d: families.edge_order(_family(s, d)["edges"]).select("a", "b", "total", "place"),
    _CELL + ", n AS (SELECT a, na AS b, count(*)::BIGINT AS total FROM ee WHERE na IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY total DESC, a || ' → ' || b)::INT AS place FROM n",
    "li",
)
add(
    "family_resources",
    lambda s, d: families.resource_params(line_log(s, d), families.partition(line_log(s, d), ["status"]))[0],
    _CELL
    + """, n AS (SELECT cell, a, res, count(*) AS n FROM ee WHERE res IS NOT NULL AND res <> '' GROUP BY 1, 2, 3)
SELECT cell AS axis1, a AS act, res AS performer FROM (SELECT *, row_number() OVER (PARTITION BY cell, a ORDER BY n DESC, res) AS k FROM n) WHERE k = 1""",
    "li",
)


def _first_choice(s: SparkSession, d: str, share: bool) -> DataFrame:
    stats = _family(s, d)
    first = stats["choices"].agg(F.min("choice")).first()[0]
    return (families.choice_share_frame if share else families.choice_count_frame)(stats, first)


add("family_choice_counts", lambda s, d: _first_choice(s, d, False))
add("family_choice_shares", lambda s, d: _first_choice(s, d, True))

# Behavioural variants: on the tree of an order's lines a variant is told by whether each part is there, how often its
# loop runs (once, more) and, if once, by the line's kind


def _clusters(s: SparkSession, d: str):
    log = line_log(s, d)
    return log, tree.cluster(log, _line_tree())


_KIND = """, ft AS (SELECT c, s, trace, len(list_filter(trace, lambda x: x <> 'NO')) AS early FROM cs WHERE regexp_full_match(array_to_string(trace, ',') || ',', '((AF|RF|NF),)*(NO,)*')),
kd AS (SELECT *, least(early, 2) || ':' || coalesce(CASE WHEN early > 0 THEN trace[1] END, '') || ':' || least(len(trace) - early, 2) AS kind FROM ft)"""
add(
    "behavioural_variants",
    lambda s, d: _clusters(s, d)[1][0].select("cases", "sequences"),
    _KIND + " SELECT count(*)::BIGINT AS cases, count(DISTINCT trace)::BIGINT AS sequences FROM kd GROUP BY kind",
    "li",
)
add(
    "clustering_fitness",
    lambda s, d: (lambda c: tree.fitness(*c).withColumn("fitness", _r("fitness")).withColumn("compression", _r("compression")))(_clusters(s, d)[1]),
    _KIND
    + """ SELECT count(*)::BIGINT AS fitting, count(DISTINCT kind)::BIGINT AS variants, count(DISTINCT trace)::BIGINT AS sequences, (SELECT count(*) FROM cs)::INT AS cases,
       round(count(*) / (SELECT count(*) FROM cs), 6)::DOUBLE AS fitness, round(count(DISTINCT kind) / count(DISTINCT trace), 6)::DOUBLE AS compression FROM kd""",
    "li",
)


def _kept(s: SparkSession, d: str) -> DataFrame:
    log, clustering = _clusters(s, d)
    kept = tree.keep_variants(log, clustering, ["v1", "v2_second"])
    return kept.df.groupBy("act").agg(F.count("*").alias("n"), F.count_distinct("case").alias("cases"))


add("variant_filter", _kept)


def _report(s: SparkSession, d: str) -> DataFrame:
    log, clustering = _clusters(s, d)
    return reports.variants_report(log, _line_tree(), clustering)


add("variants_report", lambda s, d: _report(s, d).drop("place"))
add(
    "variants_report_numbers",
    lambda s, d: _report(s, d).where("variant_id NOT IN ('noise', 'totals')").select("frequency", "sequence_variants", "linearization_count"),
    _KIND + " SELECT count(*)::BIGINT AS frequency, count(DISTINCT trace)::BIGINT AS sequence_variants, '1' AS linearization_count FROM kd GROUP BY kind",
    "li",
)
add(
    "case_variant_map",
    lambda s, d: reports.case_variant_map(_clusters(s, d)[1]).groupBy((F.col("variant_id") == "noise").alias("noise")).agg(F.count("*").alias("cases")),
    _KIND + " SELECT c NOT IN (SELECT c FROM ft) AS noise, count(*)::BIGINT AS cases FROM cs GROUP BY 1",
    "li",
)
add("condition_report", lambda s, d: reports.condition_report(line_log(s, d), decisions.mine_forks(line_log(s, d), _line_tree(), line_log(s, d).attrs, _line_attributes(s, d))))
add(
    "ranked_variants",
    lambda s, d: variants.ranked(variants.trace_counts(sessions_log(s, d))[1]).select(F.concat_ws(",", "trace").alias("trace"), "n", "rank", "covered"),
    ", g AS (SELECT trace, count(*) AS n FROM cs GROUP BY trace), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, trace) AS rank FROM g) SELECT array_to_string(trace, ',') AS trace, n::BIGINT AS n, rank::INT AS rank, (sum(n) OVER (ORDER BY rank))::BIGINT AS covered FROM k",
    "se",
)
