"""Clone groups, clone drift and component rollups, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import paths, text
from lodestar.sources.store import stored

MIN_TOKENS = 15


def with_fingerprints(entities: DataFrame, source: str = "source", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """entities with exact_hash (of the normalised source) and shape_hash (of the kinds of
    its tokens, null with under min_tokens), but for those that it has. Texts are
    read once; callers that use both clone operators store the result without them."""
    found = entities
    if "exact_hash" not in found.columns:
        found = found.withColumn("exact_hash", text.exact_hash(F.col(source)))
    if "shape_hash" not in found.columns:
        found = found.withColumn("_tokens", text.tokens(F.col(source))).withColumn("shape_hash", text.shape_hash(F.col("_tokens"), min_tokens)).drop("_tokens")
    return found


def exact_clones(entities: DataFrame, source: str = "source") -> DataFrame:
    """entities with group_key and group_size, of groups of two or more with equal normalised source.

    Sizes are aggregated map-side and joined back, so no group meets in one task
    unless AQE finds it small.
    """
    hashed = F.col("exact_hash") if "exact_hash" in entities.columns else text.exact_hash(F.col(source))
    return _members(entities.withColumn("group_key", hashed), "group_key")


def _members(keyed: DataFrame, key: str) -> DataFrame:
    sizes = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("group_size")).where("group_size >= 2")
    return keyed.join(sizes, key)


def structural_clones(entities: DataFrame, source: str = "source", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """entities with group_key and group_size, of groups of two or more with equal
    token shapes of min_tokens tokens or more, less groups in which every
    member's exact source is shared by two entities anywhere."""
    keyed = with_fingerprints(entities, source, min_tokens)
    exact = keyed.groupBy("exact_hash").agg(F.count("*").alias("_n"))
    # one row for each shape and source, so that only these meet
    shapes = keyed.where("shape_hash is not null").groupBy("shape_hash", "exact_hash").agg(F.count("*").alias("_here")).join(exact, "exact_hash")
    groups = shapes.groupBy(F.col("shape_hash").alias("group_key")).agg(F.sum("_here").alias("group_size"), F.bool_and(F.col("_n") >= 2).alias("_all")).where("group_size >= 2 and not _all")
    found = keyed.withColumn("group_key", F.col("shape_hash")).join(groups.drop("_all"), "group_key")
    return found.drop(*(c for c in ("exact_hash", "shape_hash") if c not in entities.columns))


def clone_members(files: DataFrame, fingerprint: str) -> DataFrame:
    """fingerprint, path, n: a row for each member of groups of two or more. At any
    size of group; clone_groups() puts a group in one row, for reports."""
    rows = files.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("fingerprint"), "path")
    return rows.join(rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"), "fingerprint")


#: Members of a page of a group, about; a group of fewer is one page.
PAGE = 1000


def page_of(member: Column, size: Column, most: int = PAGE) -> Column:
    """The page of a member of a group of that size, by a hash: pages are about equal, and no task numbers a group."""
    pages = F.greatest(F.lit(1), F.ceil(size / most))
    return F.when(pages == 1, F.lit(0)).otherwise(F.conv(F.substring(F.md5(member.cast("binary")), 1, 8), 16, 10).cast("long") % pages).cast("long")


def clone_groups(files: DataFrame, fingerprint: str, most: int = PAGE) -> DataFrame:
    """fingerprint, n (of the group), page, members (sorted) of files (path, ...) that share a non-null
    fingerprint: a row for each page, so that no row grows with a group."""
    members = clone_members(files, fingerprint).withColumn("page", page_of(F.col("path"), F.col("n"), most))
    return members.groupBy("fingerprint", "n", "page").agg(F.sort_array(F.collect_list("path")).alias("members"))


def clone_drift(base: DataFrame, head: DataFrame, most: int = PAGE) -> DataFrame:
    """fingerprint, n_members (of the group), page, members, changed_members of base token groups whose
    members' head tokens differ among themselves, a row for each page; a missing head file is a value of its own."""
    member = base.where("token_hash is not null").select("path", F.col("token_hash").alias("fingerprint"))
    member = stored(member.join(head.select("path", F.col("token_hash").alias("now")), "path", "left"))
    changed = ~F.col("now").eqNullSafe(F.col("fingerprint"))
    value = F.coalesce("now", F.lit("∅"))
    groups = member.groupBy("fingerprint").agg(F.count("*").alias("n_members"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    groups = groups.where("n_members >= 2 and lo != hi").drop("lo", "hi")  # then some member has changed
    pages = member.join(groups, "fingerprint").withColumn("page", page_of(F.col("path"), F.col("n_members"), most))
    return pages.groupBy("fingerprint", "n_members", "page").agg(
        F.sort_array(F.collect_list("path")).alias("members"), F.sort_array(F.collect_list(F.when(changed, F.col("path")))).alias("changed_members")
    )


def component_rollup(files: DataFrame, most: int = PAGE) -> DataFrame:
    """id, label, file_count (of the component), page, files (sorted, with duplicates): a row for each page."""
    found = files.select(paths.component_id(F.col("path")).alias("id"), "path")
    sized = found.join(found.groupBy("id").agg(F.count("*").alias("file_count")), "id")
    pages = sized.withColumn("page", page_of(F.col("path"), F.col("file_count"), most)).groupBy("id", "file_count", "page")
    return pages.agg(F.sort_array(F.collect_list("path")).alias("files")).withColumn("label", paths.label(F.col("id")))


def component_compare(base: DataFrame, head: DataFrame) -> DataFrame:
    """id, base_count, head_count, delta of two rollups."""
    b, h = (side.select("id", F.col("file_count").alias(f"{k}_count")).distinct() for k, side in (("base", base), ("head", head)))
    found = b.join(h, "id", "full_outer").select("id", F.coalesce("base_count", F.lit(0)).cast("long").alias("base_count"), F.coalesce("head_count", F.lit(0)).cast("long").alias("head_count"))
    return found.withColumn("delta", F.col("head_count") - F.col("base_count"))


def component_timeline(files: DataFrame, snapshots: list[str]) -> DataFrame:
    """id and a column of file counts for each snapshot (files: path, snapshot); missing: —"""
    counts = files.withColumn("id", paths.component_id(F.col("path"))).groupBy("id").pivot("snapshot", snapshots).count()
    return counts.select("id", *(F.coalesce(F.col(s).cast("string"), F.lit("—")).alias(s) for s in snapshots))


def bundle_timeline(bundles: DataFrame) -> DataFrame:
    """bundle, id, file_count of the components of saved reports (see report_bundles()), one
    after the other; missing columns of older reports are no error."""
    part = F.explode("head_components").alias("c")
    return bundles.select("bundle", part).select("bundle", "c.id", F.col("c.file_count").cast("long").alias("file_count"))


def entity_counts(changes: DataFrame, *by: Column | str) -> DataFrame:
    return changes.groupBy(*by).agg(F.count("*").alias("n"))


def path_counts(changes: DataFrame) -> DataFrame:
    """Changes by each path that they touch, old or new."""
    touched = changes.select(F.explode(F.array_distinct(F.array_compact(F.array("file_path", "old_file_path")))).alias("path"))
    return touched.groupBy("path").agg(F.count("*").alias("n"))
