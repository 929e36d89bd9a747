"""Column expressions over repository paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directories whose files are ignored, and endings of generated files.
IGNORED_SEGMENTS = ("bin", "obj", "dist", "node_modules", "generated", "vendor")
IGNORED_ENDINGS = (".generated.cs", ".g.cs")


def normalize_path(path: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", ""), F.lit("/"))


def matches_filters(path: Column, filters: list[str]) -> Column:
    """Whether a path is a filter or lies under one; no filters: always."""
    if not filters:
        return F.lit(True)
    found, own = F.lit(False), normalize_path(path)
    for f in filters:
        wanted = normalize_path(F.lit(f))
        found = found | (own == wanted) | own.startswith(F.concat(wanted, F.lit("/")))
    return found


def in_scope(files: DataFrame, filters: DataFrame, path: str = "path") -> DataFrame:
    """The rows of files whose path is one of filters (filter) or lies under one; without
    rows in filters, all. A path meets the filters by its folders, in an equal join."""
    wanted = filters.select(normalize_path(F.col("filter")).alias("_filter")).distinct()
    if wanted.isEmpty():
        return files
    parts = F.split(normalize_path(F.col(path)), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = files.select(path).distinct().select(path, F.explode(folders).alias("_filter")).join(wanted, "_filter", "left_semi").select(path).distinct()
    return files.join(hits, path, "left_semi")


def is_ignored(path: Column) -> Column:
    low = F.lower(F.translate(path, "\\", "/"))
    ends = F.lit(False)
    for e in IGNORED_ENDINGS:
        ends = ends | low.endswith(e)
    return F.exists(F.split(low, "/"), lambda s: s.isin(*IGNORED_SEGMENTS)) | ends


def is_source(path: Column) -> Column:
    """TypeScript or C# by its ending, case-sensitive."""
    return path.rlike(r"\.(ts|tsx|cs)$")


def language(path: Column) -> Column:
    """CSharp, TypeScript or null by the ending in any case."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(end == "cs", "CSharp").when(end.isin("ts", "tsx"), "TypeScript")


def prefix(parts: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(parts, 1, n), "/")


def component_id(path: Column) -> Column:
    """The component that a path belongs to; rules in order, the first that fits."""
    p = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: s != "")
    at = lambda i: F.get(p, F.lit(i))
    size, src, projects = F.size(p), F.array_position(p, "src").cast("int"), F.array_position(p, "projects").cast("int")
    return (
        F.when(size == 0, "")
        .when((at(0) == "framework") & (at(1) == "src") & (size >= 3), prefix(p, 3))
        .when((at(0) == "npm") & (at(1) == "ng-packs") & (at(2) == "packages") & (size >= 4), prefix(p, 4))
        .when((at(0) == "templates") & (size >= 4), prefix(p, 4))
        .when((at(0) == "modules") & (projects > 0) & (projects < size), prefix(p, projects + 1))
        .when((at(0) == "modules") & (src > 1), prefix(p, src - 1))
        .when(src == 1, "src")
        .when((src > 1) & (src < size), prefix(p, src + 1))
        .when(src > 1, prefix(p, src - 1))
        .otherwise(at(0))
    )


def label(component: Column) -> Column:
    return F.element_at(F.split(component, "/"), -1)
