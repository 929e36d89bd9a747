"""Differences between two snapshots, as joins over DataFrames.

All comparisons are null-safe. A key that occurs more than once is decided by
last_wins(). Only narrow columns take part in the joins' shuffles where the
caller passes hashes instead of texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHES = ("lexical_hash", "token_hash", "ast_hash")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in that order; a window limit runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _differ(names: Sequence[str]) -> Column:
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"b_{n}").eqNullSafe(F.col(f"a_{n}"))
    return ~same


def _both(base: DataFrame, head: DataFrame, keys: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Full outer join: the keys, before and after columns as b_ and a_, in_base, in_head."""
    side = lambda df, x: df.select(*(F.col(k).alias(f"{x}k_{k}") for k in keys), *(F.col(c).alias(f"{x}_{c}") for c in rest), F.lit(True).alias(f"{x}_in"))
    b, a = side(base, "b"), side(head, "a")
    cond = None
    for k in keys:
        c = b[f"bk_{k}"].eqNullSafe(a[f"ak_{k}"])
        cond = c if cond is None else cond & c
    found = b.join(a, cond, "full_outer")
    return found.select(*(F.coalesce(f"ak_{k}", f"bk_{k}").alias(k) for k in keys), *(F.col(f"{x}_{c}") for x in "ba" for c in rest), F.col("b_in").isNotNull().alias("in_base"), F.col("a_in").isNotNull().alias("in_head"))


def diff_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, change (added, removed, modified) of files (path, hashes; ord if paths repeat).
    Of rows that repeat a path the last by ord counts, or without ord the one with the greatest hashes."""
    last = lambda df: last_wins(df, ["path"], [F.col(c) for c in (["ord"] if "ord" in df.columns else HASHES)])
    found = _both(last(base), last(head), ["path"], HASHES)
    change = F.when(~F.col("in_base"), "added").when(~F.col("in_head"), "removed").when(_differ(HASHES), "modified")
    return found.select("path", change.alias("change")).where("change is not null")


def without_renames(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """File changes less the additions and removals that renames (from_path, to_path) explain."""
    added = renames.select(F.col("to_path").alias("path"), F.lit("added").alias("change"))
    removed = renames.select(F.col("from_path").alias("path"), F.lit("removed").alias("change"))
    return changes.join(added.unionByName(removed), ["path", "change"], "left_anti")


def renamed_files(renames: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """from_path, to_path, content_changed; false if either side is missing."""
    side = lambda df, x, key: df.select(F.col("path").alias(key), F.lit(True).alias(f"{x}_in"), *(F.col(h).alias(f"{x}_{h}") for h in HASHES))
    found = renames.join(side(base, "b", "from_path"), "from_path", "left").join(side(head, "a", "to_path"), "to_path", "left")
    return found.select("from_path", "to_path", F.coalesce(F.col("b_in") & F.col("a_in") & _differ(HASHES), F.lit(False)).alias("content_changed"))


IDENTITY = ("kind", "parent", "name")


def ambiguous_keys(base: DataFrame, head: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Identity keys that lie in more than one file of either snapshot."""
    many = lambda df: df.groupBy(*keys).agg(F.min("file_path").alias("lo"), F.max("file_path").alias("hi")).where("lo != hi").select(*keys)
    return many(base).unionByName(many(head)).distinct()


def entity_key(file_path: Column, kind: Column, parent: Column, name: Column) -> Column:
    return F.concat_ws("::", file_path, kind, F.coalesce(parent, F.lit("")), name)


def diff_entities(base: DataFrame, head: DataFrame, order: Sequence[str] = ("file_path", "ord")) -> DataFrame:
    """Entity-level changes of entities (kind, parent, name, file_path, signature, source, ord).

    moved (another file, and the key isn't ambiguous) comes before modified
    (signature or source differ). parent null counts as empty. Of entities that
    share an identity key the last by order counts; where a key spans files any
    choice is as good, and this one is deterministic.
    """
    fill = lambda df: df.withColumn("parent", F.coalesce("parent", F.lit("")))
    base, head = fill(base), fill(head)
    unsure = ambiguous_keys(base, head).select(*(F.col(k).alias(f"u_{k}") for k in IDENTITY))
    rest = ["file_path", "signature", "source"]
    last = lambda df: last_wins(df, IDENTITY, [F.col(c) for c in order])
    found = _both(last(base), last(head), IDENTITY, rest)
    found = found.join(unsure, [F.col(k) == F.col(f"u_{k}") for k in IDENTITY], "left")
    moved = (F.col("b_file_path") != F.col("a_file_path")) & F.col("u_name").isNull()
    change = F.when(~F.col("in_base"), "added").when(~F.col("in_head"), "removed").when(moved, "moved").when(_differ(["signature", "source"]), "modified")
    found = found.withColumn("change", change).where("change is not null")
    file = F.coalesce("a_file_path", "b_file_path")
    return found.select(
        F.col("change").alias("kind"), entity_key(file, F.col("kind"), F.col("parent"), F.col("name")).alias("entity_key"), "name", file.alias("file_path"), F.col("kind").alias("entity_kind"),
        F.col("b_signature").alias("before_signature"), F.col("a_signature").alias("after_signature"), F.col("b_source").alias("before_source"), F.col("a_source").alias("after_source"),
        F.when(F.col("change") == "moved", F.col("b_file_path")).alias("old_file_path"), F.lit(None).cast("string").alias("old_name"),
    )


def by_file(changes: DataFrame) -> DataFrame:
    """changes with path, one row for each file that they touch (file_path and
    old_file_path), in order of path, entity key and kind."""
    touched = F.explode(F.array_distinct(F.array_compact(F.array("file_path", "old_file_path"))))
    return changes.withColumn("path", touched).orderBy("path", "entity_key", "kind")


def of_file(changes: DataFrame, path: str) -> DataFrame:
    """The changes of one file, under its old or its new path."""
    return changes.where((F.col("file_path") == path) | F.col("old_file_path").eqNullSafe(path))


def files_affected(changes: DataFrame) -> DataFrame:
    return changes.select("file_path").distinct()


SYMBOL_REST = ("name", "exported", "signature")


def diff_symbols(base: DataFrame, head: DataFrame, renames: DataFrame | None = None, rename_mode: str = "observed") -> DataFrame:
    """Symbol changes of symbols (file, kind, qualified_name, name, exported, signature, ord).

    rename_mode: "observed" looks a head file's base file up by the rename whose
    from_path is the head path, as the tool whose results are matched does;
    "resolved" by the one whose to_path it is. A base file that no head file
    took is removed as a whole, unless a head file has its path. Where both sides
    have a column span, the result has before_span and after_span.
    """
    spans = ["span"] if "span" in base.columns and "span" in head.columns else []
    keys = ["file", "kind", "qualified_name"]
    base, head = (last_wins(df, keys, [F.col("ord")]) for df in (base, head))
    files = head.select("file").distinct()
    if renames is None:
        pairs = files.select("file", F.col("file").alias("base_file"))
    else:
        key, to = ("from_path", "to_path") if rename_mode == "observed" else ("to_path", "from_path")
        lookup = renames.select(F.col(key).alias("file"), F.col(to).alias("other"))
        pairs = files.join(lookup, "file", "left").select("file", F.coalesce("other", "file").alias("base_file"))
    paired = base.withColumnRenamed("file", "base_file").join(pairs, "base_file")
    taken = pairs.select(F.col("base_file").alias("file")).unionByName(files).distinct()
    rest = base.join(taken, "file", "left_anti")
    found = _both(paired.drop("base_file").withColumn("origin", F.col("file")).unionByName(rest.withColumn("origin", F.col("file"))), head, keys, [*SYMBOL_REST, *spans])
    kind = F.when(~F.col("in_base"), "added").when(~F.col("in_head"), "removed").when(_differ(["signature"]), "modified")
    exported = F.coalesce("b_exported", F.lit(False)) | F.coalesce("a_exported", F.lit(False))
    return found.select(
        "file", "qualified_name", F.coalesce("a_name", "b_name").alias("name"), F.col("kind").alias("symbol_kind"), kind.alias("kind"), exported.alias("exported"),
        F.col("b_signature").alias("before_signature"), F.col("a_signature").alias("after_signature"),
        *(F.col(f"{x}_{s}").alias(f"{n}_{s}") for s in spans for x, n in (("b", "before"), ("a", "after"))),
    ).where("kind is not null")


def api_changes(symbol_changes: DataFrame) -> DataFrame:
    return symbol_changes.where("exported")
