"""URL filter by a character language-model ratio (operator 10), in DataFrame functions only.

Rules decide the urls that they fit, the longest rule first. Urls decided by a
rule train two variable-order Markov models over characters, one of accepted
and one of rejected urls: orders 0 to 3, each smoothed by the next lower one
(Witten-Bell: the weight of a context's lower order is the number of different
characters seen after it). Urls that no rule fits are judged by the difference
of the log likelihoods per character; the threshold is calibrated halfway
between the mean differences of the two training classes.

Counts are aggregated map-side by 4-gram; lower orders are sums of these few
rows. Urls are scored once per distinct text. AQE broadcasts the model only
below the threshold for its measured size, or else splits hot 4-grams.

Edge cases: a null url, or one without `://`, has an empty host and path and
is judged by its (empty) text; without training urls of a class, every url
that no rule fits is allowed; null page_ids pass through; repeated rows give
repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 3
#: The chance of a character that no class has seen, before smoothing.
FLOOR = 1 / 256


def host_and_path(url):
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(common.lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and ruled (the rule's verdict), null without a rule."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = ruled = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        ruled = F.when(fits, verdict) if ruled is None else ruled.when(fits, verdict)
    return rows.select("*", rule.alias("rule"), ruled.alias("ruled"))


def grams(text):
    """The 4-grams of a text, each a character and the 3 before it."""
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - ORDER), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))


def model(rows: DataFrame) -> DataFrame:
    """gram, a and r (counts in accepted and rejected urls), diff (log10 of the
    ratio of the chances); rows: text, ruled, n (copies)."""
    n = lambda verdict: F.sum(F.when(F.col("ruled") == verdict, F.col("n")).otherwise(0))
    level = rows.select(F.explode(grams(F.col("text"))).alias("gram"), "ruled", "n").groupBy("gram").agg(n("allow").alias("a"), n("block").alias("r"))
    level = common.written(level)
    levels = [level]
    for _ in range(ORDER):
        level = level.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        levels.append(level)
    lower = None
    for level in reversed(levels):
        # a window's rows: the characters after one context
        after = Window.partitionBy(F.expr("substring(gram, 1, length(gram) - 1)"))
        chance = {}
        for c in ("a", "r"):
            seen = F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(after)
            below = F.lit(FLOOR) if lower is None else F.col(f"low_{c}")
            total = F.sum(c).over(after)
            chance[f"p_{c}"] = F.when(total > 0, (F.col(c) + seen * below) / (total + seen)).otherwise(below)
        if lower is not None:
            level = level.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower, "suffix")
        level = level.select("gram", "a", "r", *(v.alias(k) for k, v in chance.items()))
        lower = level.select(F.col("gram").alias("suffix"), F.col("p_a").alias("low_a"), F.col("p_r").alias("low_r"))
    return level.select("gram", "a", "r", (F.log10("p_a") - F.log10("p_r")).alias("diff"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    rows = judged(pages, rules).withColumn("text", F.concat("host", "path"))
    texts = common.written(rows.groupBy("text", "ruled").agg(F.count("*").alias("n")))
    fitted = common.written(model(texts))
    mean = lambda c: F.sum(F.col(c) * F.col("diff")) / F.when(F.sum(c) > 0, F.sum(c))
    threshold = fitted.agg(((mean("a") + mean("r")) / 2).alias("threshold"))  # one row
    open_texts = texts.where(F.col("ruled").isNull()).select("text")
    scored = (
        open_texts.select("text", F.explode(grams(F.col("text"))).alias("gram"))
        .join(fitted.select("gram", "diff"), "gram")
        .groupBy("text").agg(F.avg("diff").alias("score"))
        .join(F.broadcast(threshold))
        .select(F.col("text").alias("scored_text"), "score", F.when(F.col("score") < F.col("threshold"), "block").otherwise("allow").alias("guess"))
    )
    # urls that a rule decides need no join, so they don't meet in the task of a null key
    by_rule = rows.where(F.col("ruled").isNotNull()).select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    found = rows.where(F.col("ruled").isNull()).join(scored, F.col("text") == F.col("scored_text"), "left")
    return by_rule.unionByName(found.select("page_id", "host", "path", "rule", F.col("guess").alias("verdict"), "score"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages")).drop("score")


def _op10_sql() -> str:
    chain = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in chain) + " END"
    sql = f"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, host || path AS text, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM hp),
t AS (SELECT text, ruled, count(*) AS n FROM j GROUP BY ALL),
pd AS (SELECT *, chr(2) || chr(2) || chr(2) || text || chr(3) AS padded FROM t),
ex AS (SELECT text, ruled, n, substr(padded, unnest(range(1, length(padded) - 2)), 4) AS gram FROM pd),
g4 AS (SELECT gram, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END)::DOUBLE AS r FROM ex GROUP BY gram),
"""
    for k in (3, 2, 1):
        sql += f"g{k} AS (SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(r) AS r FROM g{k + 1} GROUP BY 1),\n"
    for k in (1, 2, 3, 4):
        low = (lambda c: repr(FLOOR)) if k == 1 else (lambda c: f"l.p_{c}")
        over = "OVER (PARTITION BY substr(g.gram, 1, length(g.gram) - 1))"
        chance = ", ".join(f"CASE WHEN sum(g.{c}) {over} > 0 THEN (g.{c} + (sum(CASE WHEN g.{c} > 0 THEN 1 ELSE 0 END) {over}) * {low(c)}) / (sum(g.{c}) {over} + sum(CASE WHEN g.{c} > 0 THEN 1 ELSE 0 END) {over}) ELSE {low(c)} END AS p_{c}" for c in "ar")
        sql += f"p{k} AS (SELECT g.gram, g.a, g.r, {chance} FROM g{k} g" + (f" JOIN p{k - 1} l ON l.gram = substr(g.gram, 2)" if k > 1 else "") + "),\n"
    return sql + """
d AS (SELECT gram, a, r, log10(p_a) - log10(p_r) AS diff FROM p4),
th AS (SELECT (sum(a * diff) / nullif(sum(a), 0) + sum(r * diff) / nullif(sum(r), 0)) / 2 AS threshold FROM d),
sc AS (SELECT text, avg(diff) AS score FROM ex JOIN d ON ex.gram = d.gram WHERE ruled IS NULL GROUP BY text)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score < threshold THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN sc ON j.ruled IS NULL AND j.text = sc.text, th
"""


OP10_SQL = _op10_sql()
