"""The finding rules: file, clone, symbol and API changes as one scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators.numbering import indexed

#: code: severity, confidence, risk score, section in the report. Fixed values.
RULES = {
    "file.modified": ("Medium", 0.96, 0.0, 0),
    "file.added": ("Low", 0.95, 0.0, 1),
    "file.removed": ("Low", 0.95, 0.0, 2),
    "clone.exact": ("Medium", 0.99, 0.0, 3),
    "file.renamed": ("Low", 0.98, 0.0, 4),
    "symbol.added": ("Low", 0.97, 0.0, 5),
    "symbol.removed": ("Medium", 0.97, 0.0, 5),
    "symbol.modified": ("Medium", 0.97, 0.0, 5),
    "api.added": ("Low", 0.99, 0.20, 6),
    "api.removed": ("High", 0.99, 0.98, 6),
    "api.changed": ("Medium", 0.99, 0.82, 6),
    "clone.drift": ("Medium", 0.97, 0.0, 7),
}
TOP_RISKS = 5


def _case(code: Column, i: int) -> Column:
    found = None
    for name, rule in RULES.items():
        found = F.when(code == name, F.lit(rule[i])) if found is None else found.when(code == name, F.lit(rule[i]))
    return found


def _say(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


SPAN = ("file", "start_line", "start_column", "end_line", "end_column")


def with_spans(symbols: DataFrame) -> DataFrame:
    """symbols with their place as one column, span."""
    return symbols.withColumn("span", F.struct(*SPAN))


SPANS = "array<struct<file:string,start_line:int,start_column:int,end_line:int,end_column:int>>"


def _rows(df: DataFrame, code: Column, subject: Column, position: Column, title: Column, detail: Column, severity: Column | None = None, message: Column | None = None, spans: Column | None = None) -> DataFrame:
    """Findings; position orders those of one section. With spans also their evidence, one message and the places it is about."""
    none = F.array().cast(SPANS)
    evidence = [] if spans is None else [F.array(F.struct(message.alias("message"), F.coalesce(spans, none).alias("spans"))).alias("evidence")]
    rows = df.select(
        *evidence, code.alias("code"), subject.alias("subject"), position.alias("position"), title.alias("title"), detail.alias("detail"), (F.lit(None).cast("string") if severity is None else severity).alias("own")
    )
    c = F.col("code")
    return rows.select(
        _case(c, 3).alias("section"), "position", "code", "subject", F.coalesce("own", _case(c, 0)).alias("severity"), _case(c, 1).alias("confidence"), _case(c, 2).alias("risk_score"), "title", "detail", *(["evidence"] if evidence else [])
    )


def _file_spans(symbols: DataFrame, key: str) -> DataFrame:
    """key (the file), names and spans of its symbols in order."""
    placed = "span" in symbols.columns
    some = F.sort_array(F.collect_list(F.struct("ord", "name", *(["span"] if placed else []))))
    found = symbols.groupBy(F.col("file").alias(key)).agg(some.alias("s"))
    return found.select(key, F.array_join("s.name", ", ").alias("names"), *([F.col("s.span").alias("spans")] if placed else []))


def file_findings(changes: DataFrame, symbols: DataFrame | None = None, head: DataFrame | None = None) -> DataFrame:
    """changes: path, change; symbols (file, name, ord, span): named in the detail. With head
    (path), changes of files that it lacks are left out, but for removals."""
    path, message, spans = F.col("path"), None, None
    if head is not None:
        here = head.select("path", F.lit(True).alias("here")).distinct()
        changes = changes.join(here, "path", "left").where("change = 'removed' OR here").drop("here")
    if symbols is not None:
        changes = changes.join(_file_spans(symbols, "path"), "path", "left")
        if "spans" in changes.columns:
            message = _say(F.col("change"), " file: ", path)
            spans = F.when(F.col("change") != "removed", F.col("spans"))
    else:
        changes = changes.withColumn("names", F.lit(None).cast("string"))
    detail = F.when(F.col("change") == "removed", _say(path, " was removed from the head revision")).otherwise(_say(path, " symbols: ", F.coalesce("names", F.lit("<none>"))))
    return _rows(changes, _say("file.", F.col("change")), path, path, _say(F.initcap("change"), " `", path, "`"), detail, None, message, spans)


def rename_findings(renamed: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """renamed: from_path, to_path, content_changed; symbols: those of head, for the evidence."""
    title = _say("Renamed `", F.col("from_path"), "` -> `", F.col("to_path"), "`")
    how = F.when(F.col("content_changed"), " with content changes").otherwise(" with content preserved")
    more = ()
    if symbols is not None:
        renamed = renamed.join(_file_spans(symbols, "to_path"), "to_path", "left")
        more = (_say("rename: ", F.col("from_path"), " -> ", F.col("to_path")), F.col("spans"))
    return _rows(renamed, F.lit("file.renamed"), F.col("to_path"), F.col("to_path"), title, _say(title, how), F.when(F.col("content_changed"), "Medium"), *more)


def _member_spans(groups: DataFrame, symbols: DataFrame, members: str) -> DataFrame:
    """groups with the spans of some members' symbols, in the order of members. A row is a page of a
    group, so its spans are those of a bounded number of files."""
    own = symbols.select("file", "ord", "span")
    found = groups.select("fingerprint", "page", F.posexplode(members).alias("at", "file")).join(own, "file")
    spans = found.groupBy("fingerprint", "page").agg(F.sort_array(F.collect_list(F.struct("at", "ord", "span"))).alias("s")).select("fingerprint", "page", F.col("s.span").alias("spans"))
    return groups.join(spans, ["fingerprint", "page"], "left")


def _page_position() -> Column:
    """A group's fingerprint; its further pages follow the first."""
    return F.concat(F.col("fingerprint"), F.when(F.col("page") > 0, F.format_string("|%010d", "page")).otherwise(""))


def clone_findings(groups: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """A finding for each page of a group."""
    names = text.backtick_list(F.col("members"))
    more = () if symbols is None else (None, _say("exact clone group: ", names), F.col("spans"))
    groups = groups if symbols is None else _member_spans(groups, symbols, "members")
    return _rows(groups, F.lit("clone.exact"), F.get("members", F.lit(0)), _page_position(), F.lit("Exact clone group"), _say("Exact clone group across ", names), *more)


def drift_findings(drifts: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """A finding for each page of a group."""
    said = _say(text.backtick_list(F.col("members")), "; changed members: ", text.backtick_list(F.col("changed_members")))
    more = () if symbols is None else (None, _say("clone drift: ", said), F.col("spans"))
    drifts = drifts if symbols is None else _member_spans(drifts, symbols, "changed_members")
    return _rows(drifts, F.lit("clone.drift"), F.get("members", F.lit(0)), _page_position(), F.lit("Clone drift detected"), _say("Clone group drifted across ", said), *more)


def _change_evidence(changes: DataFrame) -> tuple:
    """Severity of its own, message and spans (before, then after) for _rows()."""
    if "before_span" not in changes.columns:
        return ()
    spans = F.filter(F.array("before_span", "after_span"), lambda s: s.isNotNull())
    return None, _say("symbol change: ", F.col("qualified_name"), " in ", F.col("file")), spans


def _change_position() -> Column:
    """By file; there additions and modifications before removals, each by kind and name."""
    return F.concat_ws("|", "file", F.when(F.col("kind") == "removed", "1").otherwise("0"), "symbol_kind", "qualified_name")


def symbol_findings(changes: DataFrame) -> DataFrame:
    name, kind = _say("`", F.col("qualified_name"), "`"), F.col("kind")
    verb = F.when(kind == "added", " now defines ").when(kind == "removed", " no longer defines ").otherwise(" changed ")
    return _rows(changes, _say("symbol.", kind), F.col("qualified_name"), _change_position(), _say(F.initcap(kind), " symbol ", name), _say(F.col("file"), verb, name, " (", F.col("symbol_kind"), ")"), *_change_evidence(changes))


def api_findings(changes: DataFrame) -> DataFrame:
    kind, name = F.col("kind"), _say("`", F.col("qualified_name"), "`")
    word = F.when(kind == "modified", "changed").otherwise(kind)
    how = F.when(kind == "added", " is now available in ").when(kind == "removed", " is no longer available in ").otherwise(" changed in ")
    return _rows(changes.where("exported"), _say("api.", word), F.col("qualified_name"), _change_position(), _say(F.initcap(word), " API ", name), _say("exported ", name, how, F.col("file")), *_change_evidence(changes))


def all_findings(*parts: DataFrame) -> DataFrame:
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p, allowMissingColumns=True)
    return found


def numbered(findings: DataFrame) -> DataFrame:
    """findings with idx, their place in the whole report: by section, position and what else tells them apart."""
    return indexed(findings, ["section", "position", "code", "subject", "title", "detail"])


def evidence_rows(findings: DataFrame) -> DataFrame:
    """section, position, code, subject, nth, message, file, start_line, start_column, end_line, end_column: a row
    for each span of each finding's evidence, in order (nth, from 0); one with nulls for evidence without spans."""
    named = findings.select("section", "position", "code", "subject", F.explode("evidence").alias("e"))
    return named.select("section", "position", "code", "subject", F.col("e.message").alias("message"), F.posexplode_outer("e.spans").alias("nth", "span")).select(
        "section", "position", "code", "subject", F.coalesce("nth", F.lit(0)).cast("long").alias("nth"), "message", *(F.col(f"span.{c}").alias(c) for c in SPAN)
    )


def top_risks(findings: DataFrame, n: int = TOP_RISKS) -> DataFrame:
    """The findings of highest risk; ties in the order of the report."""
    order = [F.desc("risk_score"), "section", "position"]
    return findings.where("risk_score > 0").orderBy(*order).limit(n)


def summary(counts: DataFrame) -> DataFrame:
    """summary (string) of one row of counts: added, modified, removed, renamed, clones, symbols, apis, drifts."""
    names = [("added", "added file", "added files"), ("modified", "modified file", "modified files"), ("removed", "removed file", "removed files"), ("renamed", "renamed file", "renamed files"),
             ("clones", "exact clone group", "exact clone groups"), ("symbols", "symbol change", "symbol changes"), ("apis", "api change", "api changes")]
    parts = F.filter(F.array(*(F.when(F.col(c) > 0, text.count_phrase(F.col(c), one, many)) for c, one, many in names)), lambda x: x.isNotNull())
    said = F.when(F.size(parts) == 0, "No relevant changes detected.").otherwise(_say("Detected ", text.join_phrases(parts), "."))
    drift = F.when(F.col("drifts") > 0, _say(" Also detected ", text.count_phrase(F.col("drifts"), "clone drift group", "clone drift groups"), ".")).otherwise("")
    return counts.select(F.concat(said, drift).alias("summary"))
