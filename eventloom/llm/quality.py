"""Host-level quality rules.

Per document: whole-text statistics, the two base rules and five host rules (short, repetitive, symbols,
dup_lines, word_length). Failures of the host rules are summed by host (a documents' table names it
``source``). A host's failure rate is shrunk with an empirical beta prior: the prior's mean and strength come
from the hosts' own rates by the method of moments, so a host with few documents stays near the mean of all
hosts. The strength is at most the mean number of documents of a host, so that an ordinary host's own
documents weigh half or more also where the hosts' rates vary no more than chance lets equal hosts vary.

The limit comes from the hosts, not from a flat rate: a host is blocked for a rule if its rate is above the
mean of all hosts with a posterior probability of CREDIBLE or more (by the posterior's mean and deviation).
The verdict is joined back: a document goes if it fails a rule for which its host is blocked, or the base.
A document that fails no rule stays in any host, and one that fails a rule stays where its host does not.

Defined cases: null or empty texts have no words and fail the base; a null host is a host of its own;
repeated rows count each and share a verdict; a text of any length is read whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WHITE, batch, bounded, map_rows, read, stash

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Posterior probability of a rate above the mean from which a host is blocked, and that in standard deviations.
CREDIBLE = 0.9
DEVIATIONS = NormalDist().inv_cdf(CREDIBLE)
#: Hosts up to which their rates are broadcast, if their names are short; and copies of each rate beyond that.
MAX_HOSTS, SALTS = 200_000, 32
RULES = ("short", "repetitive", "symbols", "dup_lines", "word_length")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
_STATS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("host", T.StringType()),
        *(T.StructField(n, T.LongType()) for n in _COUNTS),
    ]
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(len(w) - window + 1, np.uint64)
    for j in range(window):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - window + 1 + j]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(w) + 1, np.int64)
    starts = np.union1d(order[1:][same], order[:-1][same])
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, lines with a word, repeated words)."""
    if not text:
        return (0,) * 6
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    chars = len(text) - sum(map(text.count, WHITE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        stats = list(zip(*map(text_stats, rows[2].to_pylist()), strict=True)) or [[]] * 6
        yield batch(dict(zip(_STATS.names, [rows[0].to_pylist(), rows[1].to_pylist(), *map(list, stats)], strict=True)), _STATS)


def base_failed() -> F.Column:
    n = F.col("n_words")
    return (n < 20) | (F.col("n_repeat_words") * 100 > n * 30)


def failures() -> dict[str, F.Column]:
    """The host rules; short and repetitive are stricter than the base, so that they can tell of its survivors."""
    n = F.col("n_words")
    return {
        "short": n < 40,
        "repetitive": F.col("n_repeat_words") * 100 > n * 15,
        "symbols": F.col("n_symbols") * 10 > n,
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 30,
        "word_length": (n > 0) & ((F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 15)),
    }


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    return map_rows(docs.select("doc_id", F.col(host).cast("string").alias("host"), "text"), _measured, _STATS)


def host_rates(stats: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """Per host: documents, and for each rule the failures, the shrunk rate and whether it is blocked.

    Moments over hosts: mean m weighted by documents, between-host variance v of the raw rates less their
    mean binomial variance; the prior's strength is m (1 - m) / v - 1, held between 1 and the mean number of
    documents of a host. The posterior of n documents with k failures is Beta(k + m s, n - k + (1 - m) s).
    """
    per = stats.groupBy("host").agg(F.count("*").alias("docs"), *(F.sum(c.cast("long")).alias(f"{r}_n") for r, c in failures().items()))
    per = stash(per, "host-counts")
    prior = []
    for r in RULES:
        n, k = F.col("docs"), F.col(f"{r}_n")
        m, most = F.sum(k) / F.sum(n), F.sum(n) / F.count("*")
        v = F.sum(n * (k / n) * (k / n)) / F.sum(n) - m * m - m * (1 - m) * F.count("*") / F.sum(n)
        strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), most)).otherwise(most)
        prior += [m.alias(f"{r}_m"), strength.alias(f"{r}_s")]
    one = per.agg(*prior).first()  # one row: two numbers a rule; null if there are no hosts
    out = per
    for r in RULES:
        m, s, n, k = one[f"{r}_m"] or 0.0, one[f"{r}_s"] or 1.0, F.col("docs"), F.col(f"{r}_n")
        rate = (k + m * s) / (n + s)
        out = out.withColumn(f"{r}_rate", rate)
        out = out.withColumn(f"{r}_blocked", (rate > m) & (rate - m >= deviations * F.sqrt(rate * (1 - rate) / (n + s + 1))))
    return out


def _with_rates(stats: DataFrame, rates: DataFrame) -> DataFrame:
    """stats with their host's rates: broadcast if those are few and short, else joined with the rates salted."""
    rates = rates.withColumnRenamed("host", "host_")
    same = F.col("host").eqNullSafe(F.col("host_"))
    small = rates.agg(F.count("*"), F.sum(F.octet_length("host_"))).first()
    if small[0] <= MAX_HOSTS and (small[1] or 0) <= 64 * MAX_HOSTS:
        return stats.join(bounded(rates, MAX_HOSTS), same, "left").drop("host_")
    salted = rates.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    return mine.join(salted, same & (F.col("salt") == F.col("salt_")), "left").drop("salt", "salt_", "host_")


def judge_hosts(docs: DataFrame, host: str = "source", deviations: float = DEVIATIONS) -> DataFrame:
    """Per document: its statistics, its host's shrunk rates and verdicts, base_failed and kept."""
    stats = stash(measure(docs, host), "host-stats")
    joined = _with_rates(stats, stash(host_rates(stats, deviations), "host-rates"))
    fail = failures()
    blocked = F.lit(False)
    for r in RULES:
        blocked = blocked | (fail[r] & F.col(f"{r}_blocked"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~blocked)


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_hosts(read(spark, sf_dir, "documents"))
    own = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*own, F.col("docs").alias("host_docs"), *(F.round(f"{r}_rate", 6).alias(f"{r}_rate") for r in RULES), *(f"{r}_blocked" for r in RULES))


#: The failures of the host rules, as ``failures`` has them.
_SQL_RULES = {
    "short": "n_words < 40",
    "repetitive": "n_repeat_words * 100 > n_words * 15",
    "symbols": "n_symbols * 10 > n_words",
    "dup_lines": "n_dup_lines * 100 > n_lines * 30",
    "word_length": "n_words > 0 AND (word_chars < n_words * 2 OR word_chars > n_words * 15)",
}


def _sql() -> str:
    counts = ", ".join(f"sum(({c})::INT)::DOUBLE AS {r}_n" for r, c in _SQL_RULES.items())
    mean = "sum({0}_n) / sum(docs)"
    spread = "sum(docs * ({0}_n / docs) * ({0}_n / docs)) / sum(docs)"
    moments = ", ".join(f"{mean} AS {{0}}_m, {spread} - pow({mean}, 2) - {mean} * (1 - {mean}) * count(*) / sum(docs) AS {{0}}_v".format(r) for r in RULES)
    strength = "CASE WHEN {0}_v > 0 THEN least(greatest({0}_m * (1 - {0}_m) / {0}_v - 1, 1.0), most) ELSE most END AS {0}_s"
    rate = "({0}_n + {0}_m * {0}_s) / (docs + {0}_s) AS {0}_rate"
    limit = f"{{0}}_rate > {{0}}_m AND {{0}}_rate - {{0}}_m >= {DEVIATIONS!r} * sqrt({{0}}_rate * (1 - {{0}}_rate) / (docs + {{0}}_s + 1)) AS {{0}}_blocked"
    each = lambda form: ", ".join(form.format(r) for r in RULES)
    gone = " OR ".join(f"({c}) AND {r}_blocked" for r, c in _SQL_RULES.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
x AS (SELECT rid, i, hash(ws[i:i + 7]) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM x WHERE (rid, h) IN (SELECT (rid, h) FROM x GROUP BY rid, h HAVING count(*) > 1)),
repeated AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(8) r(j) GROUP BY rid),
st AS (SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        len(ls)::BIGINT AS n_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeated ON w.rid = repeated.rid),
per AS (SELECT source AS host, count(*) AS docs, {counts} FROM st GROUP BY source),
mo AS (SELECT sum(docs) / count(*) AS most, {moments} FROM per),
pr AS (SELECT *, {each(strength)} FROM mo),
ra AS (SELECT *, {each(rate)} FROM per, pr),
bl AS (SELECT *, {each(limit)} FROM ra),
j AS (SELECT st.*, bl.*, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM st JOIN bl ON st.source IS NOT DISTINCT FROM bl.host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({gone}) AS kept,
       docs::BIGINT AS host_docs, {each("round({0}_rate, 6) AS {0}_rate")}, {each("{0}_blocked")} FROM j
"""


SQL = _sql()
