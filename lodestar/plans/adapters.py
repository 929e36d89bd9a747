"""Views of the test tables in the shape of the engine's inputs, as DataFrames
and as the same SQL for the oracle. They exercise the relational operators at
scale; they are not a claim about real source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.sources import content, hashes
from lodestar.sources.store import spread, stored

COMMENT = text.COMMENT
SQL_N1 = rf"trim(regexp_replace(regexp_replace(%s, '{COMMENT}', ' ', 'g'), '[{text.SPACES}]+', ' ', 'g'))"
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
SQL_TOKENS = "regexp_extract_all(%s, '" + text.TOKEN.replace("'", "''") + "')"
SQL_COMMENT = "(starts_with(t, '//') OR starts_with(t, '/*'))"
SQL_KIND = (
    f"CASE WHEN {SQL_COMMENT} THEN 'comment' WHEN t IN ({_quoted(text.LITERAL_WORDS)}) OR (t[1] IN ('\"', '''', '`') AND length(t) > 1) OR (t[1] >= '0' AND t[1] <= '9') THEN 'LIT'"
    rf" WHEN t IN ({_quoted(text.KEYWORDS)}) THEN t WHEN regexp_matches(t[1], '^[\p{{L}}_$]') THEN 'ID' ELSE t END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(files: DataFrame) -> DataFrame:
    """path and the three hashes of files (path, source), tokenised once."""
    return hashes.token_hashes(spread(files.select("path", "source")))


def _doc_path():
    return F.concat(F.col("source"), F.lit("/src/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".ts").otherwise(".cs"))


def doc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file."""
    return table(spark, sf_dir, "documents").select("doc_id", _doc_path().alias("path"), F.col("text").alias("source"))


def base_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 <> 3")
    return docs.select(_doc_path().alias("path"), F.col("text").alias("source"))


def doc_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(base_files(spark, sf_dir))


def head_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, digit = table(spark, sf_dir, "documents").where("doc_id % 10 <> 7"), F.col("doc_id") % 10
    edited = (
        F.when(digit == 1, F.concat("text", F.lit(" // note"))).when(digit == 2, F.concat("text", F.lit(" changed")))
        .when(digit == 4, F.concat(F.lit("/* hdr */ "), "text")).otherwise(F.col("text"))
    )
    path = F.when(digit == 5, F.concat(F.lit("moved/"), _doc_path())).otherwise(_doc_path())
    return docs.select(path.alias("path"), edited.alias("source"))


def doc_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(head_files(spark, sf_dir))


def doc_both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """doc_base() and doc_head(), stored; a text that both hold, or several files, is tokenised once."""
    own = [f(spark, sf_dir).select("path", "source", F.sha2("source", 256).alias(content.ID)) for f in (base_files, head_files)]
    texts = own[0].unionByName(own[1]).select(content.ID, "source").where("source is not null")
    found = content.once(texts, hashes.token_hashes)
    return tuple(stored(f.select("path", content.ID).join(found, content.ID, "left").drop(content.ID)) for f in own)


def doc_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 = 5")
    return docs.select(_doc_path().alias("from_path"), F.concat(F.lit("moved/"), _doc_path()).alias("to_path"))


_SQL_PATH = "source || '/src/' || lang || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.cs' END"
def _sql_hashed(name: str, raw: str) -> str:
    return f"""{name} AS (SELECT path, sha256(array_to_string(code, chr(1))) AS lexical_hash, sha256(kinds) AS token_hash, sha256(kinds || '#' || (len(every) - len(code))) AS ast_hash
  FROM (SELECT *, array_to_string(list_transform(code, lambda t: {SQL_KIND}), chr(1)) AS kinds FROM (SELECT *, list_filter(every, lambda t: NOT {SQL_COMMENT}) AS code
  FROM (SELECT path, {SQL_TOKENS % 'source'} AS every FROM ({raw})))))"""


SQL_HEAD = f"SELECT CASE WHEN doc_id % 10 = 5 THEN 'moved/' || {_SQL_PATH} ELSE {_SQL_PATH} END AS path, CASE doc_id % 10 WHEN 1 THEN text || ' // note' WHEN 2 THEN text || ' changed' WHEN 4 THEN '/* hdr */ ' || text ELSE text END AS source FROM documents WHERE doc_id % 10 <> 7"
SQL_ALL = _sql_hashed("doc_all", f"SELECT {_SQL_PATH} AS path, text AS source FROM documents")
SQL_DOCS = ",\n".join(
    [
        _sql_hashed("doc_base", f"SELECT {_SQL_PATH} AS path, text AS source FROM documents WHERE doc_id % 10 <> 3"),
        _sql_hashed("doc_head", SQL_HEAD),
        f"renames AS (SELECT {_SQL_PATH} AS from_path, 'moved/' || {_SQL_PATH} AS to_path FROM documents WHERE doc_id % 10 = 5)",
    ]
)


def struct_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    return docs.unionByName(docs.where("doc_id % 10 = 6").select((F.col("doc_id") + 1000000).alias("doc_id"), F.translate("source", "eE", "oO").alias("source")))


SQL_STRUCT = "struct_docs AS (SELECT doc_id, text AS source FROM documents UNION ALL SELECT doc_id + 1000000, translate(text, 'eE', 'oO') FROM documents WHERE doc_id % 10 = 6)"


def line_entities(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(where).select(
        F.lit("line").alias("kind"), F.col("l_orderkey").cast("string").alias("parent"), F.col("l_linenumber").cast("string").alias("name"), F.col("l_suppkey").cast("string").alias("file_path"),
        F.concat("l_returnflag", "l_linestatus").alias("signature"), F.col("l_partkey").cast("string").alias("source"), F.col("l_extendedprice").alias("ord"),
    )


LINE_BASE, LINE_HEAD = "l_shipdate < TIMESTAMP '1998-01-01'", "l_shipdate >= TIMESTAMP '1997-01-01'"
_SQL_LINE = "SELECT 'line' AS kind, l_orderkey::VARCHAR AS parent, l_linenumber::VARCHAR AS name, l_suppkey::VARCHAR AS file_path, l_returnflag || l_linestatus AS signature, l_partkey::VARCHAR AS source, l_extendedprice AS ord FROM lineitem WHERE "
SQL_LINES = f"e_base AS ({_SQL_LINE}{LINE_BASE}), e_head AS ({_SQL_LINE}{LINE_HEAD})"
LINE_ORDER = ("file_path", "source", "ord")


def part_entities(spark: SparkSession, sf_dir: str, drop: int) -> DataFrame:
    return table(spark, sf_dir, "part").where(f"p_partkey % {drop} <> 0").select(
        F.col("p_type").alias("kind"), F.col("p_brand").alias("parent"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("file_path"), F.lit("").alias("signature"),
        F.round(F.col("p_retailprice") * 100).cast("long").cast("string").alias("source"), F.col("p_partkey").alias("ord"),
    )


_SQL_PART = "SELECT p_type AS kind, p_brand AS parent, p_name AS name, p_size::VARCHAR AS file_path, '' AS signature, round(p_retailprice * 100)::BIGINT::VARCHAR AS source, p_partkey AS ord FROM part WHERE p_partkey % {} <> 0"
SQL_PARTS = f"e_base AS ({_SQL_PART.format(7)}), e_head AS ({_SQL_PART.format(5)})"
PART_ORDER = ("file_path", "ord")

#: A prefix for each page_id % 7, so that every component rule fires.
_PREFIXES = ("framework/src/", "npm/ng-packs/packages/", "templates/a/b/", "modules/x/projects/", "modules/", "app/src/", "")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, rest = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1)
    pre = F.get(F.array(*map(F.lit, _PREFIXES)), (F.col("page_id") % 7).cast("int"))
    middle = F.when(F.col("page_id") % 7 == 4, "/src/").otherwise("/")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(pre, host, middle, rest).alias("path"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("snapshot"))


SQL_PAGES = f"""page_paths AS (SELECT page_id, ['{"', '".join(_PREFIXES)}'][page_id % 7 + 1] || regexp_extract(url, '://([^/?#]*)', 1) || CASE WHEN page_id % 7 = 4 THEN '/src/' ELSE '/' END
  || regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS path, 's' || (page_id % 3) AS snapshot FROM pages),
pp AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS p FROM page_paths),
pc AS (SELECT *, list_position(p, 'src') AS src, list_position(p, 'projects') AS prj, len(p) AS n FROM pp),
comp AS (SELECT page_id, path, snapshot, CASE WHEN n = 0 THEN '' WHEN p[1] = 'framework' AND p[2] = 'src' AND n >= 3 THEN array_to_string(p[1:3], '/')
  WHEN p[1] = 'npm' AND p[2] = 'ng-packs' AND p[3] = 'packages' AND n >= 4 THEN array_to_string(p[1:4], '/') WHEN p[1] = 'templates' AND n >= 4 THEN array_to_string(p[1:4], '/')
  WHEN p[1] = 'modules' AND prj > 0 AND prj < n THEN array_to_string(p[1:prj + 1], '/') WHEN p[1] = 'modules' AND src > 1 THEN array_to_string(p[1:src - 1], '/')
  WHEN src = 1 THEN 'src' WHEN src > 1 AND src < n THEN array_to_string(p[1:src + 1], '/') WHEN src > 1 THEN array_to_string(p[1:src - 1], '/') ELSE p[1] END AS id FROM pc)"""

_CONV = "CAST(conv_id{} AS STRING) AS file, role AS kind, CAST(turn AS STRING) AS qualified_name, CAST(turn AS STRING) AS name, role <> 'system' AS exported, {} AS signature, turn AS ord"
_EDIT = "CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN concat(text, '!') ELSE text END"
_BASE, _HEAD = "(conv_id + turn) % 7 <> 0", "(conv_id + turn) % 9 <> 0"


def conv_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(_BASE).selectExpr(*_split(_CONV.format("", "text")))


def conv_head(spark: SparkSession, sf_dir: str, renamed: bool = False) -> DataFrame:
    """renamed: conv_id + 100000 where conv_id % 10 = 5, with a second file left at the old id where conv_id % 20 = 5."""
    rows = table(spark, sf_dir, "conversations").where(_HEAD)
    plain = rows.where("NOT (conv_id % 10 = 5)") if renamed else rows
    found = plain.selectExpr(*_split(_CONV.format("", _EDIT)))
    if renamed:
        found = found.unionByName(rows.where("conv_id % 10 = 5").selectExpr(*_split(_CONV.format(" + 100000", _EDIT)))).unionByName(rows.where("conv_id % 20 = 5").selectExpr(*_split(_CONV.format("", _EDIT))))
    return found


def conv_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("conv_id % 10 = 5").selectExpr("CAST(conv_id AS STRING) AS from_path", "CAST(conv_id + 100000 AS STRING) AS to_path").distinct()


def _split(columns: str) -> list[str]:
    found, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            found.append("")
        else:
            found[-1] += c
    return found


SQL_CONV = f"s_base AS (SELECT {_CONV.format('', 'text')} FROM conversations WHERE {_BASE}), s_head AS (SELECT {_CONV.format('', _EDIT)} FROM conversations WHERE {_HEAD})"
SQL_CONV_RENAMED = (
    f"s_base AS (SELECT {_CONV.format('', 'text')} FROM conversations WHERE {_BASE}), s_head AS (SELECT {_CONV.format('', _EDIT)} FROM conversations WHERE {_HEAD} AND conv_id % 10 <> 5"
    f" UNION ALL SELECT {_CONV.format(' + 100000', _EDIT)} FROM conversations WHERE {_HEAD} AND conv_id % 10 = 5 UNION ALL SELECT {_CONV.format('', _EDIT)} FROM conversations WHERE {_HEAD} AND conv_id % 20 = 5),"
    " s_renames AS (SELECT DISTINCT CAST(conv_id AS STRING) AS from_path, CAST(conv_id + 100000 AS STRING) AS to_path FROM conversations WHERE conv_id % 10 = 5)"
)
