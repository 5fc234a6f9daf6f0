"""Named queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, attributes, decisions, dfg, families, logfilters, performance, resources, scenarios, skeleton, suggest, tree, variants, widgets
from ..operators.metrics import Cases
from ..sources.tables import chat_log, events_log, line_log, sessions_log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# SQL bases: ev (events of a log in case order), cs (cases).
_TIMES = "CAST(floor((epoch_us(ts) + 500000) / 1e6) AS BIGINT)"
_CUST = "cu AS (SELECT CAST(c_custkey AS VARCHAR) AS c, c_mktsegment AS segment, c_nationkey::DOUBLE AS nation, c_acctbal AS balance, c_acctbal > 0 AS in_credit FROM customer)"


def _ev(raw: str, start: str = "NULL::BIGINT", ok: str = "false") -> str:
    follow = "e" if start.startswith("NULL") else "os"
    return f"""raw0 AS ({raw}),
raw1 AS (SELECT *, {_TIMES} AS e, {start} AS os, {ok} AS ok FROM raw0),
ev AS (SELECT *, CASE WHEN ok THEN os ELSE e END AS s, row_number() OVER w AS idx, lag(e) OVER w AS pe, lead(a) OVER w AS na, lead(e) OVER w AS ne, lead({follow}) OVER w AS ns FROM raw1 WINDOW w AS (PARTITION BY c ORDER BY ts, seq)),
cs AS (SELECT c, min(s) AS s, max(e) AS e, count(*) AS n, list(a ORDER BY idx) AS trace FROM ev GROUP BY c)"""


EV = _ev("SELECT CAST(user_id AS VARCHAR) AS c, event_type AS a, ts, event_id AS seq, json_extract_string(props, '$.k') AS res FROM events") + ", " + _CUST
SE = _ev("SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS c, event_type AS a, ts, event_id AS seq FROM events")
LI = _ev(
    "SELECT CAST(l_orderkey AS VARCHAR) AS c, l_returnflag || l_linestatus AS a, l_shipdate AS ts, o_orderdate AS st, CAST(l_suppkey AS VARCHAR) AS res, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS seq FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "CAST(floor((epoch_us(st) + 500000) / 1e6) AS BIGINT)",
    "coalesce(st <= ts, false)",
)
LOGS = {"ev": events_log, "se": sessions_log, "li": line_log, "chat": chat_log}
BASES = {"ev": EV, "se": SE, "li": LI}


def add(name: str, fn, sql: str | None = None, base: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = f"WITH {BASES[base]} {sql}" if base else sql


def _r(c, digits: int = 6):
    return F.round(c, digits)


def widget(name: str, log: str, spec: dict, sql: str, filters: tuple = ()) -> None:
    """A widget query returns r, c (if the spec has such axes), value to 6 digits, and n, and state for targets."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = widgets.compute_widget(LOGS[log](spark, sf_dir), spec, filters)
        return out.withColumn("value", _r("value")).withColumn("n", F.col("n").cast("long"))

    add(name, run, sql, log)


# Metrics

A, B = "click", "view"
_AVG = "round(avg(v), 6) AS value, count(v)::BIGINT AS n"
_SHARE = "round(100.0 * count(*) FILTER (WHERE v <> 0) / count(v), 6) AS value, count(v)::BIGINT AS n"


def _metric(name: str, log: str, metric: str, params: dict, per_case: str, share: bool = False, agg: str = "avg", value: str | None = None) -> None:
    widget(name, log, {"metric": metric, "params": params, "agg": agg}, f", pc AS ({per_case}) SELECT {value or (_SHARE if share else _AVG)} FROM pc")


_metric("case_duration", "se", "duration", {}, "SELECT (e - s) / 86400.0 AS v FROM cs")
_metric("event_count_stats", "ev", "eventCount", {}, "SELECT n::DOUBLE AS v FROM cs")
_metric("rework_rate", "se", "rework", {}, "SELECT (n > len(list_distinct(trace)))::INT AS v FROM cs", True)
_metric("act_freq", "ev", "actFreq", {"activity": A}, f"SELECT count(*) FILTER (WHERE a = '{A}')::DOUBLE AS v FROM ev GROUP BY c")
_metric("act_presence", "se", "actPresence", {"activity": A}, f"SELECT max((a = '{A}')::INT) AS v FROM ev GROUP BY c", True)
_metric("act_repeats", "se", "actRepeats", {"activity": A}, f"SELECT greatest(count(*) FILTER (WHERE a = '{A}') - 1, 0)::DOUBLE AS v FROM ev GROUP BY c")
_metric("act_rework", "se", "actRework", {"activity": A}, f"SELECT CASE WHEN count(*) FILTER (WHERE a = '{A}') > 0 THEN (count(*) FILTER (WHERE a = '{A}') > 1)::INT END AS v FROM ev GROUP BY c", True)
_metric("act_sojourn", "ev", "actSojourn", {"activity": A}, f"SELECT avg(e - pe) FILTER (WHERE a = '{A}') / 86400.0 AS v FROM ev GROUP BY c")
_metric("act_service", "li", "actService", {"activity": "NO"}, "SELECT avg(e - os) FILTER (WHERE a = 'NO' AND ok) / 86400.0 AS v FROM ev GROUP BY c")
_metric("act_waiting", "li", "actWaiting", {"activity": "NO"}, "SELECT avg(os - pe) FILTER (WHERE a = 'NO' AND ok) / 86400.0 AS v FROM ev GROUP BY c")
_metric("edge_freq", "ev", "edgeFreq", {"from": A, "to": B}, f"SELECT count(*) FILTER (WHERE a = '{A}' AND na = '{B}')::DOUBLE AS v FROM ev GROUP BY c")
_metric("edge_time", "ev", "edgeTime", {"from": A, "to": B}, f"SELECT avg(ne - e) FILTER (WHERE a = '{A}' AND na = '{B}') / 86400.0 AS v FROM ev GROUP BY c")
_metric("edge_share", "se", "edgeShare", {"from": A, "to": B}, f"SELECT CASE WHEN count(*) FILTER (WHERE a = '{A}') > 0 THEN coalesce(max((a = '{A}' AND na = '{B}')::INT), 0) END AS v FROM ev GROUP BY c", True)
_FIRST = f"f AS (SELECT c, min(idx) AS i, arg_min(e, idx) AS fe FROM ev WHERE a = '{A}' GROUP BY c), tb AS (SELECT ev.c, arg_min(ev.e, ev.idx) - any_value(fe) AS v FROM ev JOIN f ON f.c = ev.c AND ev.idx > f.i WHERE a = '{B}' GROUP BY ev.c)"
widget("time_between", "se", {"metric": "timeBetween", "params": {"from": A, "to": B}, "agg": "avg"}, f", {_FIRST} SELECT round(avg(v) / 86400.0, 6) AS value, count(v)::BIGINT AS n FROM tb")
_metric("kpi_median", "se", "duration", {}, "SELECT (e - s) / 86400.0 AS v FROM cs", agg="median", value="round(quantile_cont(v, 0.5), 6) AS value, count(v)::BIGINT AS n")
_metric("kpi_p90", "se", "duration", {}, "SELECT (e - s) / 86400.0 AS v FROM cs", agg="p90", value="round(quantile_cont(v, 0.9), 6) AS value, count(v)::BIGINT AS n")

# Axes

_DATE = "make_timestamp(s * 1000000)"
_AXES = {
    "weekday": f"dayname({_DATE})",
    "month": f"strftime({_DATE}, '%Y-%m')",
    "quarter": f"year({_DATE})::VARCHAR || '-Q' || quarter({_DATE})::VARCHAR",
    "year": f"year({_DATE})::VARCHAR",
}
for _name, _sql in _AXES.items():
    widget(f"case_duration_by_{_name}", "se", {"metric": "duration", "agg": "avg", "segment": {"rows": _name}}, f", pc AS (SELECT {_sql} AS r, (e - s) / 86400.0 AS v FROM cs) SELECT r, {_AVG} FROM pc GROUP BY GROUPING SETS ((r), ())")
widget("case_duration_by_segment", "ev", {"metric": "duration", "agg": "avg", "segment": {"rows": "attr:segment"}}, f", pc AS (SELECT segment AS r, (e - s) / 86400.0 AS v FROM cs JOIN cu USING (c)) SELECT r, {_AVG} FROM pc GROUP BY GROUPING SETS ((r), ())")
widget("first_event_resource", "ev", {"metric": "eventCount", "agg": "avg", "segment": {"rows": "resource"}}, f", pc AS (SELECT arg_min(res, idx) AS r, count(*)::DOUBLE AS v FROM ev GROUP BY c) SELECT r, {_AVG} FROM pc GROUP BY GROUPING SETS ((r), ())")
widget("duration_by_variant", "se", {"metric": "duration", "agg": "avg", "segment": {"rows": "variant"}}, f", pc AS (SELECT array_to_string(trace, ' → ') AS r, (e - s) / 86400.0 AS v FROM cs) SELECT r, {_AVG} FROM pc GROUP BY GROUPING SETS ((r), ())")
widget("grid_segment_month", "ev", {"metric": "eventCount", "agg": "sum", "segment": {"rows": "attr:segment", "cols": "weekday"}}, f", pc AS (SELECT segment AS r, {_AXES['weekday']} AS c, n::DOUBLE AS v FROM cs JOIN cu USING (c)) SELECT r, c, round(sum(v), 6) AS value, count(v)::BIGINT AS n FROM pc GROUP BY GROUPING SETS ((r, c), ())")
for _m, _v, _all in (("actFreq", "sum(k)", True), ("actPresence", "100.0 * count(*)", True), ("actRepeats", "sum(k - 1)", True)):
    widget(f"{_m}_by_activity", "se", {"metric": _m, "segment": {"rows": "activity"}}, f", pa AS (SELECT c, a, count(*) AS k FROM ev GROUP BY c, a) SELECT a AS r, round({_v} / (SELECT count(*) FROM cs), 6)::DOUBLE AS value, (SELECT count(*) FROM cs)::BIGINT AS n FROM pa GROUP BY a")
widget("actRework_by_activity", "se", {"metric": "actRework", "segment": {"rows": "activity"}}, ", pa AS (SELECT c, a, count(*) AS k FROM ev GROUP BY c, a) SELECT a AS r, round(100.0 * count(*) FILTER (WHERE k > 1) / count(*), 6) AS value, count(*)::BIGINT AS n FROM pa GROUP BY a")
widget("actSojourn_by_activity", "ev", {"metric": "actSojourn", "agg": "avg", "segment": {"rows": "activity"}}, ", pa AS (SELECT c, a, avg(e - pe) / 86400.0 AS v FROM ev GROUP BY c, a) SELECT a AS r, round(avg(v), 6) AS value, count(v)::BIGINT AS n FROM pa GROUP BY a")
widget("activity_axis_grid", "se", {"metric": "actFreq", "segment": {"rows": "activity", "cols": "weekday"}}, f", d AS (SELECT c AS cc, {_AXES['weekday']} AS wd FROM cs), pa AS (SELECT a, wd, count(*) AS k FROM ev JOIN d ON cc = c GROUP BY a, wd), t AS (SELECT wd, count(*) AS m FROM d GROUP BY wd) SELECT a AS r, wd AS c, round(k / m, 6)::DOUBLE AS value, m::BIGINT AS n FROM pa JOIN t USING (wd)")

# Formulas and filters

_FORMULAS = {
    "formula_arith": (f'count("{A}") * 2 - count("{B}") / count("purchase")', f"count(*) FILTER (WHERE a = '{A}') * 2.0 - CASE WHEN count(*) FILTER (WHERE a = 'purchase') > 0 THEN count(*) FILTER (WHERE a = '{B}') / (count(*) FILTER (WHERE a = 'purchase'))::DOUBLE END"),
    "formula_where": (f'count("{A}") where contains("{B}")', f"CASE WHEN count(*) FILTER (WHERE a = '{B}') > 0 THEN count(*) FILTER (WHERE a = '{A}')::DOUBLE END"),
}
for _name, (_text, _sql) in _FORMULAS.items():
    widget(_name, "se", {"metric": "custom", "params": {"formula": _text}, "agg": "avg"}, f", pc AS (SELECT {_sql} AS v FROM ev GROUP BY c) SELECT {_AVG} FROM pc")
widget("formula_logic_null", "se", {"metric": "custom", "params": {"formula": f'time_between("{A}", "{B}") > 0 and contains("purchase")'}}, f", {_FIRST}, pc AS (SELECT CASE WHEN tb.v IS NOT NULL THEN (tb.v > 0 AND list_contains(trace, 'purchase'))::INT END AS v FROM cs LEFT JOIN tb ON tb.c = cs.c) SELECT {_SHARE} FROM pc")
widget("formula_attr_eq", "ev", {"metric": "custom", "params": {"formula": 'attr("segment") == "BUILDING" or attr("nation") > 20'}}, f", pc AS (SELECT (segment = 'BUILDING' OR nation > 20)::INT AS v FROM cs JOIN cu USING (c)) SELECT {_SHARE} FROM pc")


def _filter(name: str, log: str, f: dict, cond: str, join: str = "") -> None:
    widget(name, log, {"metric": "eventCount", "agg": "sum", "filters": [f]}, f", pc AS (SELECT n::DOUBLE AS v FROM cs {join} WHERE {cond}) SELECT round(sum(v), 6) AS value, count(v)::BIGINT AS n FROM pc")


_CU = "JOIN cu USING (c)"
_filter("filter_contains", "se", {"field": "contains", "value": A}, f"list_contains(trace, '{A}')")
_filter("filter_contains_not", "se", {"field": "contains", "op": "not", "value": A}, f"NOT list_contains(trace, '{A}')")
_filter("filter_date_period", "se", {"field": "date", "value": ["2024-01-02", "2024-01"]}, "s >= epoch(TIMESTAMP '2024-01-02') AND s < epoch(TIMESTAMP '2024-02-01')")
_filter("filter_attr_in", "ev", {"field": "attr:segment", "op": "in", "value": ["BUILDING", "MACHINERY"]}, "segment IN ('BUILDING', 'MACHINERY')", _CU)
_filter("filter_attr_not", "ev", {"field": "attr:segment", "op": "not", "value": "BUILDING"}, "coalesce(segment <> 'BUILDING', true)", _CU)
_filter("filter_attr_between", "ev", {"field": "attr:balance", "op": "between", "value": [0, 5000]}, "balance BETWEEN 0 AND 5000", _CU)
_filter("filter_segment", "se", {"field": "segment", "value": ["weekday", "Tuesday"]}, f"dayname({_DATE}) = 'Tuesday'")
_filter("filter_resource", "ev", {"field": "resource", "op": "in", "value": ["1", "2", "3"]}, "c IN (SELECT c FROM ev GROUP BY c HAVING arg_min(res, idx) IN ('1', '2', '3'))")

# Targets and distributions

_TARGET = {"value": 0.5, "dir": "max", "warn": 1.0}
widget("target_states", "se", {"metric": "duration", "agg": "avg", "segment": {"rows": "weekday"}, "target": _TARGET}, f", pc AS (SELECT {_AXES['weekday']} AS r, (e - s) / 86400.0 AS v FROM cs), g AS (SELECT r, avg(v) AS m, count(v) AS n FROM pc GROUP BY GROUPING SETS ((r), ())) SELECT r, round(m, 6) AS value, n::BIGINT AS n, CASE WHEN m <= 0.5 THEN 'met' WHEN m <= 1.0 THEN 'risk' ELSE 'missed' END AS state FROM g")
widget("per_case_target_share", "se", {"metric": "duration", "target": {"value": 0.1, "dir": "max", "per_case": 90, "warn": 50}}, ", pc AS (SELECT ((e - s) / 86400.0 <= 0.1)::INT AS v FROM cs), g AS (SELECT 100.0 * avg(v) AS m, count(v) AS n FROM pc) SELECT round(m, 6) AS value, n::BIGINT AS n, CASE WHEN m >= 90 THEN 'met' WHEN m >= 50 THEN 'risk' ELSE 'missed' END AS state FROM g")


def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [{"title": "time", "metric": "duration", "agg": "avg", "target": _TARGET}, {"title": "again", "metric": "rework", "target": {"value": 10, "dir": "max"}}]
    return widgets.scorecard(sessions_log(spark, sf_dir), specs).withColumn("value", _r("value"))


add("scorecard", _scorecard, ", x AS (SELECT 'time' AS title, avg((e - s) / 86400.0) AS m, '≤ 0.5 d' AS goal, 0.5 AS g, 1.0 AS w FROM cs UNION ALL SELECT 'again', 100.0 * avg((n > len(list_distinct(trace)))::INT), '≤ 10%', 10, NULL FROM cs) SELECT title, round(m, 6) AS value, goal, CASE WHEN m <= g THEN 'met' WHEN m <= w THEN 'risk' ELSE 'missed' END AS state FROM x", "se")


def _values(log: str, metric: str):
    return lambda spark, d: widgets.case_values(LOGS[log](spark, d), {"metric": metric})[0]


_HIST = ", pc AS (SELECT {v}::DOUBLE AS v FROM cs), m AS (SELECT min(v) AS lo, max(v) AS hi FROM pc), "
add("histogram_int", lambda s, d: widgets.histogram(_values("se", "eventCount")(s, d)).select("bin", "lo", "n"), _HIST.format(v="n") + "b AS (SELECT unnest(range(0, (hi - lo)::INT + 1)) AS bin, lo FROM m) SELECT bin::INT AS bin, lo + bin AS lo, (SELECT count(*) FROM pc WHERE v = lo + bin)::BIGINT AS n FROM b", "se")
add("histogram_duration", lambda s, d: widgets.histogram(_values("se", "duration")(s, d)).select("bin", _r("lo").alias("lo"), "n"), _HIST.format(v="(e - s) / 86400.0") + "k AS (SELECT least(floor((v - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM pc, m GROUP BY 1) SELECT x.bin::INT AS bin, round(lo + x.bin * ((hi - lo) / 20), 6) AS lo, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 20)) AS bin) x CROSS JOIN m LEFT JOIN k ON k.bin = x.bin", "se")
add("box_duration", lambda s, d: widgets.box_plot(_values("se", "duration")(s, d)).select(*(_r(c).alias(c) for c in ("q1", "median", "q3", "lo", "hi")), "n_out"), ", pc AS (SELECT (e - s) / 86400.0 AS v FROM cs), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM pc) SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS lo, round(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS hi, (count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)))::BIGINT AS n_out FROM pc, q GROUP BY q1, median, q3", "se")


def _series(metric: str):
    from ..operators.metrics import series

    return lambda s, d: series(Cases(line_log(s, d)).table(), metric)


_MONTHS = ", mm AS (SELECT unnest(generate_series(date_trunc('month', make_timestamp(min(s) * 1000000)), date_trunc('month', make_timestamp(max(e) * 1000000)), INTERVAL 1 MONTH)) AS m FROM cs) "
add("arrival_series", _series("arrivalRate"), _MONTHS + "SELECT strftime(m, '%Y-%m') AS label, (SELECT count(*) FROM cs WHERE date_trunc('month', make_timestamp(s * 1000000)) = m)::DOUBLE AS value FROM mm", "li")
add("completion_series", _series("completionRate"), _MONTHS + "SELECT strftime(m, '%Y-%m') AS label, (SELECT count(*) FROM cs WHERE date_trunc('month', make_timestamp(e * 1000000)) = m)::DOUBLE AS value FROM mm", "li")
add("wip_series", _series("wip"), _MONTHS + "SELECT strftime(m, '%Y-%m') AS label, ((SELECT count(*) FROM cs WHERE make_timestamp(s * 1000000) <= m) - (SELECT count(*) FROM cs WHERE make_timestamp(e * 1000000) <= m))::DOUBLE AS value FROM mm", "li")

# Performance statistics

_ST = "round(avg({v}), 6) AS {p}_mean, round(quantile_cont({v}, 0.5), 6) AS {p}_median, min({v})::DOUBLE AS {p}_min, max({v})::DOUBLE AS {p}_max, sum({v})::DOUBLE AS {p}_total, round(stddev_samp({v}), 4) AS {p}_std, round(quantile_cont({v}, 0.9), 6) AS {p}_p90, round(quantile_cont({v}, 0.95), 6) AS {p}_p95"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_r(c, 4 if c.endswith("_std") else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


add("activity_stats", lambda s, d: _rounded(performance.activity_stats(line_log(s, d).events())), f" SELECT a AS act, count(*)::BIGINT AS frequency, count(DISTINCT c)::BIGINT AS case_coverage, (count(*) - count(DISTINCT c))::BIGINT AS repeat_frequency, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS relative_frequency, {_ST.format(v='(e - os)', p='service')}, {_ST.format(v='(e - pe)', p='sojourn')} FROM ev GROUP BY a", "li")
add("pair_stats", lambda s, d: _rounded(performance.pair_stats(events_log(s, d).events())), f" SELECT a, na AS b, count(*)::BIGINT AS frequency, count(DISTINCT c)::BIGINT AS case_frequency, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS relative_frequency, {_ST.format(v='(ns - e)', p='wait')} FROM ev WHERE na IS NOT NULL GROUP BY a, na", "ev")
add("pair_stats_interval", lambda s, d: _rounded(performance.pair_stats(line_log(s, d).events())), f" SELECT a, na AS b, count(*)::BIGINT AS frequency, count(DISTINCT c)::BIGINT AS case_frequency, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS relative_frequency, {_ST.format(v='(ns - e)', p='wait')} FROM ev WHERE na IS NOT NULL GROUP BY a, na", "li")
add("start_end_activities", lambda s, d: performance.start_end_activities(sessions_log(s, d)), ", x AS (SELECT trace[1] AS f, trace[-1] AS l FROM cs), y AS (SELECT f AS act, 1 AS st, 0 AS en FROM x UNION ALL SELECT l, 0, 1 FROM x) SELECT act, sum(st)::BIGINT AS starts, sum(en)::BIGINT AS ends FROM y GROUP BY act", "se")

# Variants, profile, log filters

_VAR = ", va AS (SELECT trace, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, trace) AS rank FROM cs GROUP BY trace) "
add("sequence_variants", lambda s, d: variants.variants(sessions_log(s, d)), _VAR + "SELECT 'v' || rank AS variant, rank::INT AS rank, n::BIGINT AS n, array_to_string(trace, ' → ') AS text FROM va", "se")
add("variant_coverage", lambda s, d: variants.coverage(sessions_log(s, d)), _VAR + "SELECT rank::INT AS rank, n::BIGINT AS n, round(100.0 * sum(n) OVER (ORDER BY rank) / sum(n) OVER (), 1)::DOUBLE AS cumulative FROM va", "se")
add("log_profile", lambda s, d: variants.profile(sessions_log(s, d)).withColumn("variant_ratio", _r("variant_ratio")), ' SELECT sum(n)::BIGINT AS events, count(*)::BIGINT AS cases, count(DISTINCT trace)::BIGINT AS variants, quantile_cont(n, 0.5)::DOUBLE AS median_len, max(n)::INT AS max_len, (SELECT count(DISTINCT a) FROM ev)::BIGINT AS activities, round(count(DISTINCT trace) / count(*), 6)::DOUBLE AS variant_ratio FROM cs', "se")


def _filtered(name: str, log: str, options: dict, sql: str) -> None:
    """What is left of a log, per activity."""
    add(name, lambda s, d: logfilters.apply(LOGS[log](s, d), options).df.groupBy("act").agg(F.count("*").alias("events"), F.count_distinct("case").alias("cases")), sql + " SELECT a AS act, count(*)::BIGINT AS events, count(DISTINCT c)::BIGINT AS cases FROM kept GROUP BY a", log)


_filtered("activity_rank_filter", "se", {"activity_ranks": (1, 2)}, ", ar AS (SELECT a AS x, row_number() OVER (ORDER BY count(*) DESC, a) AS rank FROM ev GROUP BY a), kept AS (SELECT ev.* FROM ev JOIN ar ON x = a WHERE rank BETWEEN 1 AND 2)")
_filtered("activity_cap_filter", "se", {"activity_cap": [A, B, "purchase"], "exclude_activities": [B]}, f", kept AS (SELECT * FROM ev WHERE a IN ('{A}', 'purchase'))")
_filtered("variant_rank_filter", "se", {"variant_ranks": (1, 3)}, _VAR + ", kept AS (SELECT ev.* FROM ev WHERE c IN (SELECT cs.c FROM cs JOIN va ON va.trace = cs.trace WHERE rank <= 3))")
_filtered("duration_pct_filter", "se", {"duration_pct": (10, 90)}, ", dp AS (SELECT c, row_number() OVER (ORDER BY e - s, q, c) - 1 AS p, count(*) OVER () AS t FROM cs JOIN (SELECT c, min(seq) AS q FROM ev GROUP BY c) USING (c)), kept AS (SELECT * FROM ev WHERE c IN (SELECT c FROM dp WHERE p >= floor(10 * t / 100.0) AND p < ceil(90 * t / 100.0)))")
_WIN = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")
_SPAN = ", sp AS (SELECT c, min(ts) AS x, max(ts) AS y FROM ev GROUP BY c), kept AS (SELECT * FROM ev WHERE c IN (SELECT c FROM sp WHERE {}))"
_filtered("time_window_intersecting", "se", {"time_from": _WIN[0], "time_to": _WIN[1]}, _SPAN.format(f"y >= TIMESTAMP '{_WIN[0]}' AND x <= TIMESTAMP '{_WIN[1]}'"))
_filtered("time_window_contained", "se", {"time_from": _WIN[0], "time_to": _WIN[1], "time_mode": "traces_contained"}, _SPAN.format(f"x >= TIMESTAMP '{_WIN[0]}' AND y <= TIMESTAMP '{_WIN[1]}'"))
_filtered("rename_merge", "se", {"rename_map": {A: "look", B: "look"}}, f", kept AS (SELECT c, CASE WHEN a IN ('{A}', '{B}') THEN 'look' ELSE a END AS a FROM ev)")
_filtered("attr_expr_filter", "ev", {"attr_expr": 'attr("segment") == "BUILDING" and attr("balance") > 0'}, ", kept AS (SELECT * FROM ev WHERE c IN (SELECT c FROM cu WHERE segment = 'BUILDING' AND balance > 0))")

# Families

add("partition_enum_other", lambda s, d: families.grid(families.partition(events_log(s, d), ["segment"], max_values=3)), ", t AS (SELECT segment, count(*) AS n FROM cs JOIN cu USING (c) GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, segment) AS r, count(*) OVER () AS m FROM t) SELECT CASE WHEN m > 3 AND r >= 3 THEN 'Other' ELSE segment END AS axis1, sum(n)::BIGINT AS n FROM k GROUP BY 1", "ev")
add("partition_boolean", lambda s, d: families.grid(families.partition(events_log(s, d), ["in_credit"])), " SELECT in_credit::VARCHAR AS axis1, count(*)::BIGINT AS n FROM cs JOIN cu USING (c) GROUP BY 1", "ev")
_Q = ", t AS (SELECT cs.c, balance FROM cs JOIN cu USING (c)), q AS (SELECT quantile_cont(balance, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM t) "
add("partition_bins", lambda s, d: families.grid(families.partition(events_log(s, d), ["balance"])).select("n"), _Q + "SELECT count(*)::BIGINT AS n FROM t, q GROUP BY (balance >= e[2])::INT + (balance >= e[3])::INT + (balance >= e[4])::INT", "ev")
add("partition_cross_min_cases", lambda s, d: families.grid(families.partition(events_log(s, d), ["segment", "in_credit"], min_cases=5)), " SELECT segment AS axis1, in_credit::VARCHAR AS axis2, count(*)::BIGINT AS n FROM cs JOIN cu USING (c) GROUP BY 1, 2 HAVING count(*) >= 5", "ev")


def _family(fn):
    def run(s: SparkSession, d: str) -> DataFrame:
        log = events_log(s, d)
        return _rounded(fn(log, families.partition(log, ["segment"])))

    return run


add("family_process", _family(lambda log, cells: families.family_process(log, cells).select("axis1", "cases", "events_mean", "events_median", "duration_mean", "duration_max", "rework_fraction", "mean_repeats")), " SELECT segment AS axis1, count(*)::BIGINT AS cases, round(avg(n), 6) AS events_mean, quantile_cont(n, 0.5)::DOUBLE AS events_median, round(avg(e - s), 6) AS duration_mean, max(e - s)::DOUBLE AS duration_max, round(avg((n > len(list_distinct(trace)))::INT), 6) AS rework_fraction, round(avg(n - len(list_distinct(trace))), 6) AS mean_repeats FROM cs JOIN cu USING (c) GROUP BY 1", "ev")
add("family_activity", _family(lambda log, cells: families.family_activities(log, cells).select("axis1", "act", "frequency", "case_coverage", "relative_frequency", "sojourn_mean")), " SELECT segment AS axis1, a AS act, count(*)::BIGINT AS frequency, count(DISTINCT c)::BIGINT AS case_coverage, round(count(*) / sum(count(*)) OVER (PARTITION BY segment), 6)::DOUBLE AS relative_frequency, round(avg(e - pe), 6) AS sojourn_mean FROM ev JOIN cu USING (c) GROUP BY segment, a", "ev")
add("family_edges", _family(lambda log, cells: families.family_edges(log, cells).select("axis1", "a", "b", "frequency", "case_frequency", "wait_mean")), " SELECT segment AS axis1, a, na AS b, count(*)::BIGINT AS frequency, count(DISTINCT c)::BIGINT AS case_frequency, round(avg(ns - e), 6) AS wait_mean FROM ev JOIN cu USING (c) WHERE na IS NOT NULL GROUP BY segment, a, na", "ev")


def _joined(s: SparkSession, d: str) -> DataFrame:
    log = sessions_log(s, d)
    t = log.events().groupBy("case").agg((F.max("end_s") - F.min("start_s")).cast("double").alias("v"), F.min_by("act", F.struct("ts", "seq")).alias("a"), F.max_by("act", F.struct("ts", "seq")).alias("b"))
    return t


_AB = ", t AS (SELECT trace[1] AS a, trace[-1] AS b, (e - s)::DOUBLE AS v FROM cs) "
add("advisor_nmi", lambda s, d: families.mutual_information(_joined(s, d), "a", "b").select(_r("nmi").alias("nmi")), _AB + ", n AS (SELECT a, b, count(*)::DOUBLE AS n FROM t GROUP BY a, b), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS tt FROM n), s2 AS (SELECT sum(n / tt * ln((n / tt) / ((na / tt) * (nb / tt)))) AS i, -sum(n / tt * ln(na / tt)) AS ha, -sum(n / tt * ln(nb / tt)) AS hb FROM m) SELECT round(CASE WHEN least(ha, hb) > 1e-12 THEN least(greatest(i / least(ha, hb), 0), 1) ELSE 0 END, 6)::DOUBLE AS nmi FROM s2", "se")
add("advisor_eta", lambda s, d: families.eta_squared(_joined(s, d), "a", "v").select(_r("eta").alias("eta")), _AB + ", g AS (SELECT count(*) AS n, avg(v) AS m FROM t GROUP BY a) SELECT round((SELECT sum(n * (m - (SELECT avg(v) FROM t)) ** 2) FROM g) / (SELECT var_pop(v) * count(*) FROM t), 6)::DOUBLE AS eta", "se")
add("attribute_ranking", lambda s, d: families.rank_attributes(events_log(s, d)))

# Resources and suggestions

_RES = ", rs AS (SELECT a, res, count(*) AS n, min((ts, c, seq)) AS seen FROM ev WHERE res IS NOT NULL AND res <> '' GROUP BY a, res) "
add("resource_mode", lambda s, d: resources.performers(events_log(s, d)), _RES + "SELECT a AS act, res AS performer FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, res) AS k FROM rs) WHERE k = 1", "ev")
add("resource_first", lambda s, d: resources.performers(events_log(s, d), "first"), _RES + "SELECT a AS act, arg_min(res, seen) AS performer FROM rs GROUP BY a", "ev")
add("resource_all", lambda s, d: resources.performers(events_log(s, d), "all"), _RES + "SELECT a AS act, string_agg(res, '+' ORDER BY seen) AS performer FROM rs GROUP BY a", "ev")
add("resource_components", lambda s, d: resources.components(events_log(s, d)), " SELECT DISTINCT res FROM ev WHERE res IS NOT NULL AND res <> ''", "ev")
add("suggest_dashboards", lambda s, d: s.createDataFrame([(b["name"], len(b["widgets"])) for b in suggest.suggest_dashboards(events_log(s, d))], "name string, widgets int"))


# Process trees (no SQL)


def _chat_tree() -> tree.Tree:
    return tree.node(tree.LOOP, tree.node(tree.SEQ, tree.leaf("user"), tree.leaf("assistant")), tree.TAU)


add("mined_tree", lambda s, d: s.createDataFrame([(tree.to_json(tree.discover(chat_log(s, d))),)], "tree string"))


def _mined(fn):
    """fn over all sessions and the tree of their directly-follows graph, so the driver sees no distinct traces."""

    def run(s: SparkSession, d: str) -> DataFrame:
        log = sessions_log(s, d)
        return fn(log, dfg.discover(log))

    return run


add("replay_parses", lambda s, d: tree.parses(variants.trace_counts(chat_log(s, d))[1], _chat_tree()).select("trace", "n", "signature", "exhausted"))
add("variant_clusters", _mined(lambda log, t: tree.cluster(log, t)[0].select("variant", "cases", "sequences", "signature")))
add("traversal_counts", _mined(tree.traversal))


def _pruned(log, t: tree.Tree) -> DataFrame:
    counts = {r["node"]: r["cases"] for r in tree.traversal(log, t).collect()}  # a row per node of the tree
    small, removed = tree.prune(t, counts, min_share=0.1)
    return log.df.sparkSession.createDataFrame([(str(t), str(small), len(removed))], "before string, after string, removed int")


add("pruned_tree", _mined(_pruned))

# Alignments, decisions, scenarios: the lines of an order, shipped before or after the cut-off date


def _line_tree() -> tree.Tree:
    """Returned, accepted or open early lines, then open late lines; either part may be missing."""
    n, x = tree.node, tree.leaf
    early = n(tree.LOOP, n(tree.XOR, x("AF"), x("RF"), x("NF")), tree.TAU)
    return n(tree.SEQ, n(tree.XOR, tree.TAU, early), n(tree.XOR, tree.TAU, n(tree.LOOP, x("NO"), tree.TAU)))


_EARLY = "('AF', 'RF', 'NF')"
_FIT = ", ft AS (SELECT c, trace, len(list_filter(trace, lambda x: x <> 'NO')) AS early FROM cs WHERE regexp_full_match(array_to_string(trace, ',') || ',', '((AF|RF|NF),)*(NO,)*')) "
_LABELS = _FIT + f", lb AS (SELECT c, 1 AS choice, (early > 0)::INT AS branch FROM ft UNION ALL SELECT c, 9, (len(trace) > early)::INT FROM ft UNION ALL SELECT c, 4, list_position(['AF', 'RF', 'NF'], trace[1]) - 1 FROM ft WHERE early = 1) "
add("branch_labels", lambda s, d: decisions.branch_labels(line_log(s, d), _line_tree()).groupBy("choice", "branch").agg(F.count("*").alias("cases")), _LABELS + "SELECT choice::INT AS choice, branch::INT AS branch, count(*)::BIGINT AS cases FROM lb GROUP BY 1, 2", "li")
add(
    "alignment_repair",
    lambda s, d: alignment.walked(variants.trace_counts(line_log(s, d))[1], _line_tree()).groupBy("status", "cost").agg(F.sum("n").alias("cases"), F.count("*").alias("sequences")),
    f", u AS (SELECT c, trace, idx, (a = 'NO')::INT AS late, (a IN {_EARLY})::INT AS early FROM ev JOIN cs USING (c)), p AS (SELECT *, sum(late) OVER w AS late_before, sum(early) OVER (PARTITION BY c) AS all_early, sum(early) OVER (PARTITION BY c) - sum(early) OVER w AS early_after FROM u WINDOW w AS (PARTITION BY c ORDER BY idx)), k AS (SELECT c, any_value(trace) AS trace, sum(1 - late - early) + least(min(late_before + early_after), any_value(all_early)) AS cost FROM p GROUP BY c) SELECT CASE WHEN cost = 0 THEN 'fitting' ELSE 'repaired' END AS status, cost::INT AS cost, count(*)::BIGINT AS cases, count(DISTINCT trace)::BIGINT AS sequences FROM k GROUP BY 1, 2",
    "li",
)
add("traversal_totals", lambda s, d: alignment.traversal_stats(line_log(s, d), _line_tree(), repair=False)[1].drop("signatures").withColumn("coverage", _r("coverage")).withColumn("fitting_ratio", _r("fitting_ratio")), _FIT + ", n AS (SELECT count(*)::BIGINT AS t, count(DISTINCT trace)::BIGINT AS q FROM cs), f AS (SELECT count(*)::BIGINT AS f FROM ft) SELECT t AS total, f AS fitting, 0::BIGINT AS repaired, t - f AS unexplained, q AS sequences, round(f / t, 6)::DOUBLE AS coverage, round(f / t, 6)::DOUBLE AS fitting_ratio FROM n, f", "li")
add("branch_traversals", lambda s, d: alignment.branch_counts(_line_tree(), alignment.traversal_stats(line_log(s, d), _line_tree(), repair=False)[0]), _FIT + ", x AS (SELECT unnest(trace) AS a FROM ft), sp AS (SELECT * FROM (VALUES (1, 0), (1, 1), (4, 0), (4, 1), (4, 2), (9, 0), (9, 1)) v(choice, branch)), n AS (SELECT 1 AS choice, (early > 0)::INT AS branch FROM ft UNION ALL SELECT 9, (len(trace) > early)::INT FROM ft UNION ALL SELECT 4, list_position(['AF', 'RF', 'NF'], a) - 1 FROM x WHERE a <> 'NO') SELECT sp.choice::INT AS choice, sp.branch::INT AS branch, count(n.choice)::BIGINT AS visits FROM sp LEFT JOIN n ON n.choice = sp.choice AND n.branch = sp.branch GROUP BY 1, 2", "li")

# with repaired cases, over the whole log (no SQL: of equal paths the aligner takes one)
add("repaired_totals", lambda s, d: alignment.traversal_stats(line_log(s, d), _line_tree())[1].drop("signatures").withColumn("coverage", _r("coverage")).withColumn("fitting_ratio", _r("fitting_ratio")))
add("repaired_branches", lambda s, d: alignment.branch_counts(_line_tree(), alignment.traversal_stats(line_log(s, d), _line_tree())[0]))


def _line_attributes(s: SparkSession, d: str) -> list[attributes.Attribute]:
    return attributes.classify(line_log(s, d).attrs)


def _fork_conditions(s: SparkSession, d: str) -> DataFrame:
    log = line_log(s, d)
    forks = decisions.mine_forks(log, _line_tree(), log.attrs, _line_attributes(s, d))
    return s.createDataFrame([(f.choice, b, c, round(f.accuracy, 6), f.cases) for f in forks for b, c in enumerate(f.conditions)], "choice int, branch int, condition string, accuracy double, cases long")


def _detected(s: SparkSession, d: str) -> DataFrame:
    """The attributes of orders that the table of their lines reveals."""
    df = table(s, d, "lineitem").join(table(s, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    found = attributes.detect(df.withColumn("seq", seq), "l_orderkey", "seq")[1]
    return s.createDataFrame([(a.source, a.name, a.kind, a.scale, len(a.values)) for a in found], "source string, name string, kind string, scale int, n_values int")


def _scenarios(s: SparkSession, d: str) -> DataFrame:
    return scenarios.scenarios(line_log(s, d), _line_tree())


def _representatives(s: SparkSession, d: str) -> DataFrame:
    log = line_log(s, d)
    last = log.df.groupBy("case").agg(F.max_by("act", F.struct("ts", "seq")).alias("variant"))
    return attributes.representatives(log.attrs, last, _line_attributes(s, d))


def _family_choices(s: SparkSession, d: str) -> DataFrame:
    log = line_log(s, d)
    return _rounded(skeleton.family_choices(log, families.partition(log, ["status"]))[0])


add("or_fork_conditions", _fork_conditions)
add("detected_attributes", _detected)
_REP = ", o AS (SELECT CAST(o_orderkey AS VARCHAR) AS c, '_' || regexp_replace(o_orderpriority, '[^0-9A-Za-z_]+', '_', 'g') AS priority, o_orderstatus AS status, o_totalprice AS price FROM orders), t AS (SELECT trace[-1] AS variant, o.* FROM cs JOIN o USING (c))"
_REP += "".join(f", m_{a} AS (SELECT variant, '{a}' AS attribute, {a} AS value FROM (SELECT variant, {a}, row_number() OVER (PARTITION BY variant ORDER BY count(*) DESC, {a}) AS k FROM t GROUP BY variant, {a}) WHERE k = 1)" for a in ("priority", "status"))
add("representative_values", _representatives, _REP + " SELECT * FROM m_priority UNION ALL SELECT * FROM m_status UNION ALL SELECT variant, 'price', round_even(quantile_cont(price, 0.5) * 100, 0)::BIGINT::VARCHAR FROM t GROUP BY variant", "li")
add("successions", lambda s, d: dfg.edges(line_log(s, d)), " SELECT a, na AS b, count(*)::BIGINT AS n FROM ev GROUP BY a, na UNION ALL SELECT NULL, a, count(*)::BIGINT FROM ev WHERE idx = 1 GROUP BY a", "li")
add("graph_tree", lambda s, d: s.createDataFrame([(tree.to_json(dfg.discover(line_log(s, d))),)], "tree string"))
add("family_choices", _family_choices)
add("scenarios", lambda s, d: _scenarios(s, d).select("variant", "cases", _r("share").alias("share"), F.to_json("settings").alias("settings"), F.concat_ws(" → ", "trace").alias("trace"), F.size("visited").alias("visited"), F.size("problems").alias("problems")))
add("scenario_coverage", lambda s, d: scenarios.coverage(_scenarios(s, d), scenarios.model_of(_line_tree())))
add("scenario_comparison", lambda s, d: scenarios.compare_all(_scenarios(s, d), "v1").withColumn("agreement", _r("agreement")))

FLAGSHIP = "case_duration_by_segment"

from . import more  # noqa: E402, F401  (adds its queries to those above)
