"""Named queries over the adapter views and the SQL that a second engine checks them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import paths, text
from lodestar.operators import changes, clones, findings, linescan
from lodestar.plans import adapters as v
from lodestar.plans import report, samples
from lodestar.sources.store import place, spread, stored
from lodestar.streaming import timeline

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- files

_FILE_DIFF = """fd AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
  WHEN a.lexical_hash IS DISTINCT FROM b.lexical_hash OR a.token_hash IS DISTINCT FROM b.token_hash OR a.ast_hash IS DISTINCT FROM b.ast_hash THEN 'modified' END AS change
  FROM doc_base b FULL JOIN doc_head a ON a.path = b.path),
fc AS (SELECT * FROM fd WHERE change IS NOT NULL),
fr AS (SELECT * FROM fc WHERE NOT (change = 'added' AND path IN (SELECT to_path FROM renames)) AND NOT (change = 'removed' AND path IN (SELECT from_path FROM renames)))"""
_DOCS = f"WITH {v.SQL_DOCS},\n{_FILE_DIFF}"
_RENAMED = "rn AS (SELECT r.from_path, r.to_path, coalesce(b.path IS NOT NULL AND a.path IS NOT NULL AND (a.lexical_hash IS DISTINCT FROM b.lexical_hash OR a.token_hash IS DISTINCT FROM b.token_hash OR a.ast_hash IS DISTINCT FROM b.ast_hash), false) AS content_changed FROM renames r LEFT JOIN doc_base b ON b.path = r.from_path LEFT JOIN doc_head a ON a.path = r.to_path)"


def _file_changes(spark, d):
    return changes.diff_files(*v.doc_both(spark, d))


@query(f"{_DOCS} SELECT * FROM fc")
def file_diff(spark: SparkSession, d: str) -> DataFrame:
    return _file_changes(spark, d)


@query(f"{_DOCS} SELECT * FROM fr")
def file_diff_renames(spark, d):
    return changes.without_renames(_file_changes(spark, d), v.doc_renames(spark, d))


@query(f"{_DOCS}, {_RENAMED} SELECT * FROM rn")
def renamed_files(spark, d):
    return changes.renamed_files(v.doc_renames(spark, d), *v.doc_both(spark, d))


# ---- entities

_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, parent, name ORDER BY {}) AS rn FROM e_{}) WHERE rn = 1"


def _entity_sql(views: str, order: str) -> str:
    return f"""WITH {views}, lb AS ({_LAST.format(order, 'base')}), lh AS ({_LAST.format(order, 'head')}),
amb AS (SELECT kind, parent, name FROM e_base GROUP BY ALL HAVING count(DISTINCT file_path) > 1 UNION SELECT kind, parent, name FROM e_head GROUP BY ALL HAVING count(DISTINCT file_path) > 1),
j AS (SELECT coalesce(h.kind, b.kind) AS k, coalesce(h.parent, b.parent) AS p, coalesce(h.name, b.name) AS n, b.file_path AS bf, h.file_path AS hf, b.signature AS bs, h.signature AS hs, b.source AS bo, h.source AS ho,
  b.rn IS NOT NULL AS inb, h.rn IS NOT NULL AS inh FROM lb b FULL JOIN lh h ON b.kind = h.kind AND b.parent = h.parent AND b.name = h.name),
c AS (SELECT j.*, CASE WHEN NOT inb THEN 'added' WHEN NOT inh THEN 'removed' WHEN bf <> hf AND amb.name IS NULL THEN 'moved' WHEN bs <> hs OR bo <> ho THEN 'modified' END AS change
  FROM j LEFT JOIN amb ON amb.kind = k AND amb.parent = p AND amb.name = n),
ec AS (SELECT change AS kind, coalesce(hf, bf) || '::' || k || '::' || p || '::' || n AS entity_key, n AS name, coalesce(hf, bf) AS file_path, k AS entity_kind, bs AS before_signature, hs AS after_signature,
  bo AS before_source, ho AS after_source, CASE WHEN change = 'moved' THEN bf END AS old_file_path, NULL::VARCHAR AS old_name FROM c WHERE change IS NOT NULL)"""


_LINES = _entity_sql(v.SQL_LINES, "file_path DESC, source DESC, ord DESC")
_PARTS = _entity_sql(v.SQL_PARTS, "file_path DESC, ord DESC")


def _line_diff(spark, d):
    return changes.diff_entities(v.line_entities(spark, d, v.LINE_BASE), v.line_entities(spark, d, v.LINE_HEAD), v.LINE_ORDER)


@query(f"{_LINES} SELECT * FROM ec")
def entity_diff(spark, d):
    return _line_diff(spark, d)


@query(f"{_LINES} SELECT kind, count(*) AS n FROM ec GROUP BY kind")
def entity_diff_counts(spark, d):
    return clones.entity_counts(_line_diff(spark, d), "kind")


@query(f"{_PARTS} SELECT * FROM ec")
def entity_diff_part(spark, d):
    return changes.diff_entities(v.part_entities(spark, d, 7), v.part_entities(spark, d, 5), v.PART_ORDER)


@query(f"{_PARTS} SELECT * FROM amb")
def ambiguous_keys(spark, d):
    return changes.ambiguous_keys(v.part_entities(spark, d, 7), v.part_entities(spark, d, 5))


@query(f"{_LINES} SELECT * FROM ec WHERE kind = 'moved'")
def moved_entities(spark, d):
    return _line_diff(spark, d).where("kind = 'moved'")


@query(f"{_LINES} SELECT DISTINCT file_path FROM ec")
def files_affected(spark, d):
    return changes.files_affected(_line_diff(spark, d))


@query(f"{_LINES} SELECT path, count(*) AS n, min(entity_key) AS first FROM (SELECT file_path AS path, entity_key FROM ec UNION ALL SELECT old_file_path, entity_key FROM ec WHERE old_file_path IS NOT NULL AND old_file_path <> file_path) GROUP BY path")
def changes_by_file(spark, d):
    return changes.by_file(_line_diff(spark, d)).groupBy("path").agg(F.count("*").alias("n"), F.min("entity_key").alias("first"))


@query(f"{_LINES} SELECT * FROM ec WHERE file_path = '7' OR old_file_path = '7'")
def changes_of_file(spark, d):
    return changes.of_file(_line_diff(spark, d), "7")


@query(f"{_LINES} SELECT path, count(*) AS n FROM (SELECT file_path AS path FROM ec UNION ALL SELECT old_file_path FROM ec WHERE old_file_path IS NOT NULL) GROUP BY path")
def path_change_counts(spark, d):
    return clones.path_counts(_line_diff(spark, d))


# ---- symbols


def _symbol_sql(views: str, base_file: str | None) -> str:
    lookup = f"LEFT JOIN s_renames r ON r.{base_file} = h.file" if base_file else ""
    other = "from_path" if base_file == "to_path" else "to_path"
    to = f"coalesce(r.{other}, h.file)" if base_file else "h.file"
    return f"""WITH {views}, sl AS (SELECT *, row_number() OVER (PARTITION BY file, kind, qualified_name ORDER BY ord DESC) AS rn FROM s_base), sh AS (SELECT *, row_number() OVER (PARTITION BY file, kind, qualified_name ORDER BY ord DESC) AS rn FROM s_head),
b0 AS (SELECT * FROM sl WHERE rn = 1), h0 AS (SELECT * FROM sh WHERE rn = 1),
pairs AS (SELECT h.file, {to} AS base_file FROM (SELECT DISTINCT file FROM h0) h {lookup}),
b1 AS (SELECT p.file, b.kind, b.qualified_name, b.name, b.exported, b.signature FROM b0 b JOIN pairs p ON b.file = p.base_file
  UNION ALL SELECT file, kind, qualified_name, name, exported, signature FROM b0 WHERE file NOT IN (SELECT base_file FROM pairs) AND file NOT IN (SELECT file FROM pairs)),
sj AS (SELECT coalesce(h.file, b.file) AS file, coalesce(h.qualified_name, b.qualified_name) AS qualified_name, coalesce(h.name, b.name) AS name, coalesce(h.kind, b.kind) AS symbol_kind,
  CASE WHEN b.file IS NULL THEN 'added' WHEN h.file IS NULL THEN 'removed' WHEN b.signature IS DISTINCT FROM h.signature THEN 'modified' END AS kind,
  coalesce(b.exported, false) OR coalesce(h.exported, false) AS exported, b.signature AS before_signature, h.signature AS after_signature
  FROM b1 b FULL JOIN h0 h ON b.file = h.file AND b.kind = h.kind AND b.qualified_name = h.qualified_name),
sc AS (SELECT * FROM sj WHERE kind IS NOT NULL)"""


_SYMBOLS = _symbol_sql(v.SQL_CONV, None)


def _symbols(spark, d):
    return changes.diff_symbols(v.conv_base(spark, d), v.conv_head(spark, d))


@query(f"{_SYMBOLS} SELECT * FROM sc")
def symbol_changes(spark, d):
    return _symbols(spark, d)


@query(f"{_symbol_sql(v.SQL_CONV_RENAMED, 'from_path')} SELECT * FROM sc")
def symbol_changes_observed_rename(spark, d):
    return changes.diff_symbols(v.conv_base(spark, d), v.conv_head(spark, d, True), v.conv_renames(spark, d), "observed")


@query(f"{_symbol_sql(v.SQL_CONV_RENAMED, 'to_path')} SELECT * FROM sc")
def symbol_changes_resolved_rename(spark, d):
    return changes.diff_symbols(v.conv_base(spark, d), v.conv_head(spark, d, True), v.conv_renames(spark, d), "resolved")


@query(f"{_SYMBOLS} SELECT * FROM sc WHERE exported")
def api_changes(spark, d):
    return changes.api_changes(_symbols(spark, d))


# ---- clones and components


@query(f"SELECT doc_id, group_key, n AS group_size FROM (SELECT doc_id, group_key, count(*) OVER (PARTITION BY group_key) AS n FROM (SELECT doc_id, sha256({v.SQL_N1 % 'text'}) AS group_key FROM documents)) WHERE n >= 2 AND group_key IS NOT NULL")
def exact_clones(spark, d):
    hashed = stored(spread(v.doc_all(spark, d)).select("doc_id", text.exact_hash(F.col("source")).alias("exact_hash")))
    return clones.exact_clones(hashed).drop("exact_hash")


@query(f"""WITH {v.SQL_STRUCT}, a AS (SELECT doc_id, {v.SQL_N1 % 'source'} AS n1, {v.SQL_TOKENS % 'source'} AS every FROM struct_docs),
b AS (SELECT doc_id, n1, len(every) AS nt, sha256(array_to_string(list_transform(every, lambda t: {v.SQL_KIND}), chr(1))) AS shape FROM a),
c AS (SELECT doc_id, nt, shape, count(*) OVER (PARTITION BY n1) AS nx FROM b), e AS (SELECT shape AS group_key, count(*) AS group_size FROM c WHERE nt >= 15 GROUP BY shape HAVING count(*) >= 2 AND NOT bool_and(nx >= 2))
SELECT doc_id, group_key, group_size FROM c JOIN e ON shape = group_key AND nt >= 15""")
def structural_clones(spark, d):
    hashed = stored(clones.with_fingerprints(spread(v.struct_docs(spark, d))).select("doc_id", "exact_hash", "shape_hash"))
    return clones.structural_clones(hashed).select("doc_id", "group_key", "group_size")


def _groups(df):
    return df.select("fingerprint", "n", "page", F.array_join("members", ",").alias("members"))


#: The page of a path in a group of n, as clones.page_of() has it.
_PAGE = "(CASE WHEN n <= 1000 THEN 0 ELSE ('0x' || substr(md5(path), 1, 8))::BIGINT % ceil(n / 1000)::BIGINT END)"
_PAGES = f"SELECT fingerprint, n, {_PAGE} AS page, string_agg(path, ',' ORDER BY path) AS members FROM (SELECT path, %s AS fingerprint, count(*) OVER (PARTITION BY %s) AS n FROM doc_all WHERE %s IS NOT NULL) WHERE n > 1 GROUP BY ALL"


def _all_hashed(spark, d, fingerprint):
    """path and fingerprint of every document, stored: sizes and members of groups both read it, and texts are tokenised once."""
    return stored(v.hashed(v.doc_all(spark, d)).select("path", fingerprint))


@query(f"WITH {v.SQL_ALL} " + _PAGES.replace("%s", "lexical_hash"))
def lexical_clone_groups(spark, d):
    return _groups(clones.clone_groups(_all_hashed(spark, d, "lexical_hash"), "lexical_hash"))


@query(f"WITH {v.SQL_ALL} " + _PAGES.replace("%s", "token_hash"))
def token_clone_groups(spark, d):
    return _groups(clones.clone_groups(_all_hashed(spark, d, "token_hash"), "token_hash"))


@query(f"WITH {v.SQL_ALL} SELECT lexical_hash AS fingerprint, path, n FROM (SELECT *, count(*) OVER (PARTITION BY lexical_hash) AS n FROM doc_all WHERE lexical_hash IS NOT NULL) WHERE n > 1")
def clone_members(spark, d):
    return clones.clone_members(stored(_all_hashed(spark, d, "lexical_hash")), "lexical_hash")


_DRIFT = f"""dd AS (SELECT *, bool_or(coalesce(now, '∅') <> coalesce(first_now, '∅')) OVER (PARTITION BY fp) AS differ FROM (SELECT b.path, b.token_hash AS fp, h.token_hash AS now, count(*) OVER (PARTITION BY b.token_hash) AS n,
  min(coalesce(h.token_hash, '∅')) OVER (PARTITION BY b.token_hash) AS first_now FROM doc_base b LEFT JOIN doc_head h ON b.path = h.path WHERE b.token_hash IS NOT NULL) WHERE n > 1),
dr AS (SELECT fp AS fingerprint, n AS n_members, {_PAGE} AS page, fp || CASE WHEN {_PAGE} > 0 THEN format('|{{:010d}}', {_PAGE}) ELSE '' END AS position, string_agg(path, ',' ORDER BY path) AS members, string_agg(path, ',' ORDER BY path) FILTER (now IS DISTINCT FROM fp) AS changed_members,
  string_agg('`' || path || '`', ', ' ORDER BY path) AS tm, string_agg('`' || path || '`', ', ' ORDER BY path) FILTER (now IS DISTINCT FROM fp) AS tc, min(path) AS first
  FROM dd WHERE differ GROUP BY ALL)"""


@query(f"{_DOCS}, {_DRIFT} SELECT fingerprint, n_members, page, members, coalesce(changed_members, '') AS changed_members FROM dr")
def clone_drift(spark, d):
    found = clones.clone_drift(*v.doc_both(spark, d))
    return found.select("fingerprint", "n_members", "page", F.array_join("members", ",").alias("members"), F.array_join("changed_members", ",").alias("changed_members"))


@query(f"WITH {v.SQL_PAGES} SELECT id, regexp_extract(id, '[^/]*$') AS label, n AS file_count, {_PAGE} AS page, string_agg(path, ',' ORDER BY path) AS files FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM comp) GROUP BY ALL")
def component_rollup(spark, d):
    return clones.component_rollup(v.page_paths(spark, d)).select("id", "label", "file_count", "page", F.array_join("files", ",").alias("files"))


@query(f"WITH {v.SQL_PAGES} SELECT id, count(*) FILTER (snapshot = 's0') AS base_count, count(*) FILTER (snapshot = 's1') AS head_count, count(*) FILTER (snapshot = 's1') - count(*) FILTER (snapshot = 's0') AS delta FROM comp WHERE snapshot <> 's2' GROUP BY id")
def component_compare(spark, d):
    p = v.page_paths(spark, d)
    return clones.component_compare(clones.component_rollup(p.where("snapshot = 's0'")), clones.component_rollup(p.where("snapshot = 's1'")))


@query(f"WITH {v.SQL_PAGES} SELECT id, " + ", ".join(f"CASE WHEN count(*) FILTER (snapshot = '{s}') = 0 THEN '—' ELSE (count(*) FILTER (snapshot = '{s}'))::VARCHAR END AS {s}" for s in ("s0", "s1", "s2")) + " FROM comp GROUP BY id")
def component_timeline(spark, d):
    return clones.component_timeline(v.page_paths(spark, d), ["s0", "s1", "s2"])


@query(ORACLE_SQL["component_timeline"])
def timeline_stream(spark, d):
    """Three reports' components saved, followed by a stream of all that is there, and pivoted."""
    root, pages = place(spark), stored(v.page_paths(spark, d))
    for name in ("s0", "s1", "s2"):
        report.save({"head_components": clones.component_rollup(pages.where(F.col("snapshot") == name))}, f"{root}/reports/{name}")
    timeline.follow(timeline.saved_components(spark, f"{root}/reports"), f"{root}/table", f"{root}/offsets").awaitTermination()
    return timeline.timeline(spark, f"{root}/table", ["s0", "s1", "s2"])


# ---- paths and text


@query(f"WITH {v.SQL_PAGES} SELECT page_id, path FROM page_paths WHERE path = 'framework/src' OR starts_with(path, 'framework/src/') OR path = 'templates/a' OR starts_with(path, 'templates/a/')")
def path_scope(spark, d):
    return v.page_paths(spark, d).where(paths.matches_filters(F.col("path"), ["./framework\\src/", "templates/a"])).select("page_id", "path")


@query(f"WITH {v.SQL_PAGES}, f AS (SELECT DISTINCT regexp_replace(id, '^.*?/', 'x/') AS id FROM comp WHERE page_id % 5 = 0 UNION SELECT id FROM comp WHERE page_id % 3 = 0) SELECT page_id, path FROM page_paths WHERE EXISTS (SELECT 1 FROM f WHERE path = id OR starts_with(path, id || '/'))")
def path_scope_table(spark, d):
    pages = v.page_paths(spark, d).withColumn("id", paths.component_id(F.col("path")))
    other = pages.where("page_id % 5 = 0").select(F.regexp_replace("id", "^.*?/", "x/").alias("filter"))
    return paths.in_scope(pages, other.unionByName(pages.where("page_id % 3 = 0").select(F.col("id").alias("filter")))).select("page_id", "path")


_GEN = "CASE page_id % 5 WHEN 0 THEN 'a/Obj/x.cs' WHEN 1 THEN 'a/node_modules/' || page_id WHEN 2 THEN 'a/b.Generated.cs' WHEN 3 THEN 'a\\dist\\c.ts' ELSE 'src/objects/d.ts' END"


@query(f"SELECT page_id, path, len(list_filter(string_split(replace(lower(path), chr(92), '/'), '/'), lambda s: s IN ('bin', 'obj', 'dist', 'node_modules', 'generated', 'vendor'))) > 0 OR ends_with(lower(path), '.generated.cs') OR ends_with(lower(path), '.g.cs') AS ignored FROM (SELECT page_id, {_GEN} AS path FROM pages)")
def ignored_paths(spark, d):
    n = F.col("page_id")
    path = F.when(n % 5 == 0, "a/Obj/x.cs").when(n % 5 == 1, F.concat(F.lit("a/node_modules/"), n.cast("string"))).when(n % 5 == 2, "a/b.Generated.cs").when(n % 5 == 3, "a\\dist\\c.ts").otherwise("src/objects/d.ts")
    return v.table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("ignored", paths.is_ignored(F.col("path")))


@query("SELECT doc_id, (CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) END)::BIGINT AS code_lines FROM documents")
def code_lines(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.code_lines(F.col("text")).alias("code_lines"))


@query(f"SELECT doc_id, {v.SQL_N1 % 'text'} AS normalized FROM documents")
def normalize_text(spark, d):
    return v.doc_all(spark, d).select("doc_id", text.normalize(F.col("source")).alias("normalized"))


@query(f"""WITH {v.SQL_ALL} SELECT * FROM doc_all""")
def file_hashes(spark, d):
    return v.hashed(v.doc_all(spark, d))


_FOLD = "{'code': 0::BIGINT, 'comment': 0::BIGINT, 'blank': 0::BIGINT, 'open': false, 'l': %s}"


@query(f"""WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), lambda s: {_FOLD % "trim(s, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"}) END AS ls FROM documents),
f AS (SELECT doc_id, list_reduce(ls, lambda a, x: {{'code': a.code + CASE WHEN x.l <> '' AND NOT (a.open OR starts_with(x.l, '/*') OR starts_with(x.l, '//')) THEN 1 ELSE 0 END,
  'comment': a.comment + CASE WHEN x.l <> '' AND (a.open OR starts_with(x.l, '/*') OR starts_with(x.l, '//')) THEN 1 ELSE 0 END, 'blank': a.blank + CASE WHEN x.l = '' THEN 1 ELSE 0 END,
  'open': CASE WHEN x.l = '' THEN a.open WHEN a.open THEN NOT contains(x.l, '*/') WHEN starts_with(x.l, '/*') THEN NOT contains(substr(x.l, 3), '*/') ELSE false END, 'l': x.l}}, {_FOLD % "''"}) AS m FROM l)
SELECT doc_id, m.code AS code, m.comment AS comment, m.blank AS blank FROM f""")
def line_metrics(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.line_metrics(F.col("text")).alias("m")).select("doc_id", "m.*")


@query(ORACLE_SQL["line_metrics"])
def line_metrics_scan(spark, d):
    return linescan.text_metrics(v.table(spark, d, "documents"), "doc_id", "text")


@query("""WITH b AS (SELECT p_partkey, list_transform(range(0, length(hex(encode(p_name))) // 2), lambda i: ('0x' || substr(hex(encode(p_name)), 2 * i::INT + 1, 2))::HUGEINT) AS bs FROM part),
h AS (SELECT p_partkey, list_reduce(bs, lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h FROM b)
SELECT p_partkey, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS hash FROM h""")
def fnv64(spark, d):
    return v.table(spark, d, "part").select("p_partkey", text.fnv1a_64(F.col("p_name")).alias("hash"))


@query("SELECT page_id, CASE WHEN lower(regexp_extract(url, '\\.([^./]+)$', 1)) = 'cs' THEN 'CSharp' WHEN lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('ts', 'tsx') THEN 'TypeScript' END AS language FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.TS' WHEN 1 THEN '.cs' WHEN 2 THEN '.tsx' ELSE '.txt' END AS url FROM pages)")
def language_detect(spark, d):
    n = F.col("page_id") % 4
    path = F.concat("url", F.when(n == 0, ".TS").when(n == 1, ".cs").when(n == 2, ".tsx").otherwise(".txt"))
    return v.table(spark, d, "pages").select("page_id", paths.language(path).alias("language"))


# ---- findings and reports


def _findings(spark, d):
    (base, head), renames = v.doc_both(spark, d), v.doc_renames(spark, d)
    symbols = stored(_symbols(spark, d))
    return findings.all_findings(
        findings.file_findings(changes.without_renames(changes.diff_files(base, head), renames)),
        findings.clone_findings(clones.clone_groups(head, "lexical_hash")),
        findings.rename_findings(changes.renamed_files(renames, base, head)),
        findings.symbol_findings(symbols),
        findings.api_findings(symbols),
        findings.drift_findings(clones.clone_drift(base, head)),
    )


_FINDINGS = f"""{_SYMBOLS}, {v.SQL_DOCS},
{_FILE_DIFF}, {_RENAMED}, {_DRIFT},
cg AS (SELECT fingerprint, {_PAGE} AS page, fingerprint || CASE WHEN {_PAGE} > 0 THEN format('|{{:010d}}', {_PAGE}) ELSE '' END AS position, string_agg('`' || path || '`', ', ' ORDER BY path) AS tm, min(path) AS first
  FROM (SELECT path, lexical_hash AS fingerprint, count(*) OVER (PARTITION BY lexical_hash) AS n FROM doc_head WHERE lexical_hash IS NOT NULL) WHERE n > 1 GROUP BY ALL),
sp AS (SELECT *, file || '|' || CASE kind WHEN 'removed' THEN '1' ELSE '0' END || '|' || symbol_kind || '|' || qualified_name AS position FROM sc),
fi AS (SELECT CASE change WHEN 'modified' THEN 0 WHEN 'added' THEN 1 ELSE 2 END AS section, path AS position, 'file.' || change AS code, path AS subject, CASE change WHEN 'modified' THEN 'Medium' ELSE 'Low' END AS severity, CASE change WHEN 'modified' THEN 0.96 ELSE 0.95 END::DOUBLE AS confidence, 0.0::DOUBLE AS risk_score,
  upper(change[1]) || change[2:] || ' `' || path || '`' AS title, CASE change WHEN 'removed' THEN path || ' was removed from the head revision' ELSE path || ' symbols: <none>' END AS detail FROM fr
UNION ALL SELECT 3, position, 'clone.exact', first, 'Medium', 0.99, 0.0, 'Exact clone group', 'Exact clone group across ' || tm FROM cg
UNION ALL SELECT 4, to_path, 'file.renamed', to_path, CASE WHEN content_changed THEN 'Medium' ELSE 'Low' END, 0.98, 0.0, 'Renamed `' || from_path || '` -> `' || to_path || '`', 'Renamed `' || from_path || '` -> `' || to_path || '`' || CASE WHEN content_changed THEN ' with content changes' ELSE ' with content preserved' END FROM rn
UNION ALL SELECT 5, position, 'symbol.' || kind, qualified_name, CASE kind WHEN 'added' THEN 'Low' ELSE 'Medium' END, 0.97, 0.0, upper(kind[1]) || kind[2:] || ' symbol `' || qualified_name || '`', file || CASE kind WHEN 'added' THEN ' now defines `' WHEN 'removed' THEN ' no longer defines `' ELSE ' changed `' END || qualified_name || '` (' || symbol_kind || ')' FROM sp
UNION ALL SELECT 6, position, 'api.' || CASE kind WHEN 'modified' THEN 'changed' ELSE kind END, qualified_name, CASE kind WHEN 'added' THEN 'Low' WHEN 'removed' THEN 'High' ELSE 'Medium' END, 0.99, CASE kind WHEN 'added' THEN 0.2 WHEN 'removed' THEN 0.98 ELSE 0.82 END,
  CASE kind WHEN 'added' THEN 'Added' WHEN 'removed' THEN 'Removed' ELSE 'Changed' END || ' API `' || qualified_name || '`', 'exported `' || qualified_name || CASE kind WHEN 'added' THEN '` is now available in ' WHEN 'removed' THEN '` is no longer available in ' ELSE '` changed in ' END || file FROM sp WHERE exported
UNION ALL SELECT 7, position, 'clone.drift', first, 'Medium', 0.97, 0.0, 'Clone drift detected', 'Clone group drifted across ' || tm || '; changed members: ' || coalesce(tc, '') FROM dr)"""


@query(f"{_FINDINGS} SELECT * FROM fi")
def all_findings(spark, d):
    return _findings(spark, d)


QUERIES["findings"] = QUERIES.pop("all_findings")
ORACLE_SQL["findings"] = ORACLE_SQL.pop("all_findings")


@query(f"{_FINDINGS} SELECT *, row_number() OVER (ORDER BY section, position, code, subject, title, detail) - 1 AS idx FROM fi")
def findings_index(spark, d):
    return findings.numbered(_findings(spark, d))


_LINES = f"""hs AS (SELECT path AS file, ord, split_part(line, ' ', 1) AS name, ord + 1 AS start_line, length(line) + 1 AS end_column FROM (SELECT path, unnest(range(0, len(ls))) AS ord, unnest(ls) AS line FROM (SELECT path, string_split(source, chr(10)) AS ls FROM ({v.SQL_HEAD})))),
names AS (SELECT file, string_agg(name, ', ' ORDER BY ord, name) AS names FROM hs GROUP BY file),
gm AS (SELECT h.path, h.lexical_hash AS fingerprint, count(*) OVER (PARTITION BY h.lexical_hash) AS n FROM doc_head h WHERE h.lexical_hash IS NOT NULL),
ev AS (SELECT 'file.' || change AS code, path AS subject, CASE change WHEN 'modified' THEN 0 WHEN 'added' THEN 1 ELSE 2 END AS section, path AS position, change || ' file: ' || path AS message, CASE WHEN change <> 'removed' THEN [path] ELSE [] END AS fs FROM fr
UNION ALL SELECT 'file.renamed', to_path, 4, to_path, 'rename: ' || from_path || ' -> ' || to_path, [to_path] FROM rn
UNION ALL SELECT 'clone.exact', min(path), 3, fingerprint || CASE WHEN {_PAGE} > 0 THEN format('|{{:010d}}', {_PAGE}) ELSE '' END, 'exact clone group: ' || string_agg('`' || path || '`', ', ' ORDER BY path), list(path ORDER BY path) FROM gm WHERE n > 1 GROUP BY fingerprint, {_PAGE}
UNION ALL SELECT 'clone.drift', first, 7, position, 'clone drift: ' || tm || '; changed members: ' || coalesce(tc, ''), CASE WHEN changed_members IS NULL THEN [] ELSE string_split(changed_members, ',') END FROM dr),
sp2 AS (SELECT code, subject, section, position, message, i, f FROM (SELECT *, unnest(range(1, greatest(1, len(fs)) + 1)) AS i FROM ev), LATERAL (SELECT fs[i] AS f)),
er AS (SELECT code, subject, section, position, message, i, h.* FROM sp2 LEFT JOIN hs h ON h.file = sp2.f),
en AS (SELECT *, row_number() OVER (PARTITION BY section, position ORDER BY file IS NULL, i, ord, name) - 1 AS nth, count(file) OVER (PARTITION BY section, position) AS found FROM er)"""


def _line_symbols(spark, d):
    """The lines of head's files as its symbols, each named by its first word."""
    lines = v.head_files(spark, d).select("path", F.posexplode(F.split("source", "\n")).alias("ord", "line"))
    place = {"start_line": F.col("ord") + 1, "start_column": F.lit(1), "end_line": F.col("ord") + 1, "end_column": F.length("line") + 1}
    return findings.with_spans(lines.select(F.col("path").alias("file"), "ord", F.substring_index("line", " ", 1).alias("name"), *(c.alias(k) for k, c in place.items())))


def _findings_with_evidence(spark, d):
    (base, head), renames = v.doc_both(spark, d), v.doc_renames(spark, d)
    symbols = stored(_line_symbols(spark, d))
    return findings.all_findings(
        findings.file_findings(changes.without_renames(changes.diff_files(base, head), renames), symbols, head),
        findings.rename_findings(changes.renamed_files(renames, base, head), symbols),
        findings.clone_findings(clones.clone_groups(head, "lexical_hash"), symbols),
        findings.drift_findings(clones.clone_drift(base, head), symbols),
    )


@query(f"{_DOCS}, {_RENAMED}, {_DRIFT}, {_LINES} SELECT section, position, code, subject, nth::BIGINT AS nth, message, file, start_line::INT AS start_line, CASE WHEN file IS NOT NULL THEN 1 END AS start_column, start_line::INT AS end_line, end_column::INT AS end_column FROM en WHERE file IS NOT NULL OR (found = 0 AND nth = 0)")
def finding_evidence(spark, d):
    return findings.evidence_rows(_findings_with_evidence(spark, d))


@query(f"{_DOCS}, {_LINES.partition('gm AS')[0].rstrip().rstrip(',')} SELECT path AS subject, 'file.' || change AS code, CASE change WHEN 'removed' THEN path || ' was removed from the head revision' ELSE path || ' symbols: ' || coalesce(names, '<none>') END AS detail FROM fr LEFT JOIN names ON file = path")
def findings_named(spark, d):
    base, head = v.doc_both(spark, d)
    found = findings.file_findings(changes.without_renames(changes.diff_files(base, head), v.doc_renames(spark, d)), stored(_line_symbols(spark, d)), head)
    return found.select("subject", "code", "detail")


@query(f"{_FINDINGS} SELECT * FROM fi WHERE risk_score > 0 ORDER BY risk_score DESC, section, position LIMIT 5")
def risk_top5(spark, d):
    return findings.top_risks(_findings(spark, d))


@query(f"{_FINDINGS} SELECT code, severity, count(*) AS n FROM fi GROUP BY code, severity")
def finding_counts(spark, d):
    return clones.entity_counts(_findings(spark, d), "code", "severity")


def _phrase(n: str, one: str, many: str) -> str:
    return f"CASE WHEN {n} = 0 THEN NULL WHEN {n} = 1 THEN '1 {one}' ELSE {n} || ' {many}' END"


_COUNTS = """n AS (SELECT count(*) FILTER (code = 'file.added') AS added, count(*) FILTER (code = 'file.modified') AS modified, count(*) FILTER (code = 'file.removed') AS removed, count(*) FILTER (code = 'file.renamed') AS renamed,
  count(*) FILTER (code = 'clone.exact') AS clones, count(*) FILTER (section = 5) AS symbols, count(*) FILTER (section = 6) AS apis, count(*) FILTER (code = 'clone.drift') AS drifts FROM fi)"""
_PARTS_SQL = ", ".join(
    _phrase(c, a, b)
    for c, a, b in [("added", "added file", "added files"), ("modified", "modified file", "modified files"), ("removed", "removed file", "removed files"), ("renamed", "renamed file", "renamed files"),
                    ("clones", "exact clone group", "exact clone groups"), ("symbols", "symbol change", "symbol changes"), ("apis", "api change", "api changes")]
)


@query(f"""{_FINDINGS}, {_COUNTS}, p AS (SELECT drifts, list_filter([{_PARTS_SQL}], lambda x: x IS NOT NULL) AS a FROM n)
SELECT CASE len(a) WHEN 0 THEN 'No relevant changes detected.' WHEN 1 THEN 'Detected ' || a[1] || '.' WHEN 2 THEN 'Detected ' || a[1] || ' and ' || a[2] || '.' ELSE 'Detected ' || array_to_string(a[:-2], ', ') || ', and ' || a[-1] || '.' END
  || CASE WHEN drifts > 0 THEN ' Also detected ' || drifts || CASE WHEN drifts = 1 THEN ' clone drift group.' ELSE ' clone drift groups.' END ELSE '' END AS summary FROM p""")
def report_summary(spark, d):
    n = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast("long")
    code, section = F.col("code"), F.col("section")
    counts = _findings(spark, d).agg(
        n(code == "file.added").alias("added"), n(code == "file.modified").alias("modified"), n(code == "file.removed").alias("removed"), n(code == "file.renamed").alias("renamed"),
        n(code == "clone.exact").alias("clones"), n(section == 5).alias("symbols"), n(section == 6).alias("apis"), n(code == "clone.drift").alias("drifts"),
    )
    return findings.summary(counts)


_CHANGE = ("kind", "entity_key", "name", "file_path", "entity_kind", "before_signature", "after_signature", "before_source", "after_source", "old_file_path", "old_name")
_FINDING = ("section", "position", "code", "subject", "severity", "confidence", "risk_score", "title", "detail")
_as_json = lambda names: "to_json({" + ", ".join(f"'{n}': {n}" for n in names) + "})::VARCHAR"


@query(f"{_LINES} SELECT {_as_json(_CHANGE)} AS change FROM ec")
def manifest_json(spark, d):
    return _line_diff(spark, d).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("change"))


@query(f"{_FINDINGS} SELECT {_as_json(_FINDING)} AS finding FROM fi")
def report_json(spark, d):
    return _findings(spark, d).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("finding"))


QUERIES |= samples.QUERIES
ORACLE_SQL |= samples.ORACLE_SQL
