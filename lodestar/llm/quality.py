"""Host-level quality rules (operator 4), in DataFrame functions only.

Each document is measured; a document fails the base rules with under 50 words
or with over half of its words in repeated 3-word windows. Failures are added
up by host (here: source), each host's failure rate is shrunk towards all hosts
with a beta prior fitted to the hosts' rates by moments, and a host is rejected
if even the low end of its shrunken rate (mean less Z standard deviations) is
above MAX_RATE. Verdicts are joined back to the documents; a rejected host's
documents go, others stay if they pass.

The aggregation is map-side first, and only rejected hosts are joined back, so
a host with a third of all rows neither meets in one task (AQE splits or
broadcasts by measured size) nor matters to the rest.

Edge cases: null text has no words, so it fails; a null host is a host of its
own; with one host or equal rates the prior is the mean with PRIOR_LIMIT
pseudo-documents; an empty table gives an empty table; repeated rows count each
time; other columns are kept by keep_documents() and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if over this share of its documents fails for sure.
MAX_RATE = 0.5
Z = 3.0
PRIOR_LIMIT = 100.0
SYMBOLS = "#*$%&|<>"


def repeat_words(words):
    """Words that lie in 3-word windows found twice or more in the text.

    Windows are compared by 64-bit hashes within one text: of n windows, a
    wrong match has a chance of under n * n / 2**65.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(s):
        twice = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
        return common.let(F.sort_array(F.transform(twice, lambda e: e["i"])), lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return F.when(F.size(words) < 3, 0).otherwise(common.let(F.sort_array(windows), covered)).cast("long")


def measures(text):
    """The base measures of a text as one struct, words split once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.SPACE_CHARS)) != "")

    def of(words):
        n_dup = common.let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            n_dup.cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
        )

    return common.let(common.words(text), of)


def base_failed(m):
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def rejected_hosts(hosts: DataFrame) -> DataFrame:
    """host, rate of hosts whose documents all go; hosts: host, n documents, k of which fail."""
    # one row: mean and variance of the hosts' rates, and the prior of that mean and variance
    prior = hosts.agg(F.avg(F.col("k") / F.col("n")).alias("m"), F.var_samp(F.col("k") / F.col("n")).alias("v"))
    size = F.when(F.col("v") > 0, F.least(F.lit(PRIOR_LIMIT), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(PRIOR_LIMIT))
    prior = prior.select((F.col("m") * size).alias("a"), ((1 - F.col("m")) * size).alias("b"))
    a, b = F.col("k") + F.col("a"), F.col("n") - F.col("k") + F.col("b")
    rate = a / (a + b)
    low = rate - Z * F.sqrt(rate * (1 - rate) / (a + b + 1))
    return hosts.join(F.broadcast(prior)).where(low > MAX_RATE).select("host", rate.alias("rate"))


def judge(rows: DataFrame) -> DataFrame:
    """rows (host, base_failed, ...) with kept; rows are read twice."""
    hosts = rows.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("base_failed").cast("double")).alias("k"))
    bad = rejected_hosts(hosts).select(F.col("host").alias("bad_host"), F.lit(True).alias("rejected"))
    found = rows.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rejected").isNull()).drop("bad_host", "rejected")


def documents_rules(docs: DataFrame) -> DataFrame:
    """doc_id, host, the base measures, base_failed, kept: one row per row of docs."""
    rows = docs.select("doc_id", F.col("source").alias("host"), measures(F.col("text")).alias("m"))
    rows = rows.select("doc_id", "host", "m.*", base_failed(F.col("m")).alias("base_failed"))
    return judge(common.written(rows))  # narrow rows: texts are read and measured once


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Texts are measured once, for
    the rows that pass; a host's failures are its rows in docs less those, and both
    counts read no text. No text is shuffled."""
    passed = common.written(docs.where(~base_failed(measures(F.col("text")))))
    n = docs.groupBy(F.col("source").alias("host")).agg(F.count("*").cast("double").alias("n"))
    ok = passed.groupBy(F.col("source").alias("ok_host")).agg(F.count("*").cast("double").alias("ok"))
    hosts = n.join(ok, F.col("host").eqNullSafe(F.col("ok_host")), "left").select("host", "n", (F.col("n") - F.coalesce("ok", F.lit(0.0))).alias("k"))
    name = common.fresh(docs, "bad_host")
    # written, so that its size is known and a few hosts are broadcast: texts aren't dealt by host
    bad = common.written(rejected_hosts(hosts).select(F.col("host").alias(name)), docs.count())
    return passed.join(bad, F.col("source").eqNullSafe(F.col(name)), "left_anti")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_rules(common.table(spark, sf_dir, "documents")).drop("host")


_MEASURES_SQL = r"""
t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT *, list_transform(range(0, greatest(len(ws) - 2, 0)), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) AS gs FROM w),
x AS (SELECT row_number() OVER () AS rid, * FROM g),
u AS (SELECT rid, unnest(gs) AS gram, unnest(range(0, len(gs))) AS i FROM x),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM u),
p AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r WHERE c > 1),
q AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM p GROUP BY rid),
b AS (SELECT x.rid, doc_id, source, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM x LEFT JOIN q ON x.rid = q.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed THEN 1.0 ELSE 0.0 END)::DOUBLE AS k FROM f GROUP BY source),
m AS (SELECT avg(k / n) AS m, var_samp(k / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(100.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 100.0 END AS z FROM m),
e AS (SELECT source, (k + m * z) AS a, (n - k + (1 - m) * z) AS c FROM h, s),
bad AS (SELECT source FROM e WHERE a / (a + c) - 3.0 * sqrt(a / (a + c) * (1 - a / (a + c)) / (a + c + 1)) > 0.5)
"""
OP4_SQL = f"WITH {_MEASURES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept FROM f"
