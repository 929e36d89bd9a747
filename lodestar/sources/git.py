"""Source files of git revisions and of a working tree as DataFrames.

Names come NUL-separated, so names that git would quote are read as they are.
Revisions are listed by the ``git`` data source, by subtree; each task reads its blobs by one `git cat-file --batch`.
The repository must be readable on the executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import paths
from lodestar.sources import git_source

SKIPPED_DIRS = ("node_modules", "target")


def _revision(spark: SparkSession, repo: str, rev: str, **options: str) -> DataFrame:
    git_source.git(repo, "rev-parse", f"{rev}^{{tree}}")  # what is wrong with a name, said by git before Spark starts
    git_source.register(spark)
    return spark.read.format("git").options(rev=rev, **options).load(os.path.abspath(repo))  # tasks have folders of their own


def tracked_files(spark: SparkSession, repo: str, rev: str) -> DataFrame:
    """path and oid of each file of a revision, whatever its ending."""
    return _revision(spark, repo, rev, endings="", contents="false").select("path", "oid")


def files_at(spark: SparkSession, repo: str, rev: str, filters: list[str] | None = None, strict: bool = False, also: DataFrame | None = None) -> DataFrame:
    """rev, path, source of the TypeScript and C# files of a revision that pass the
    filters or are in ``also`` (path), chosen before any blob is read. Blobs are read
    by object id, one at a time, so any name will do. A blob that is missing or
    isn't UTF-8 is left out, or with strict an error."""
    options = {"strict": str(strict).lower()}
    if also is None or not filters:
        return _revision(spark, repo, rev, scope=json.dumps(filters or []), **options).select("rev", "path", "source")
    listed = _revision(spark, repo, rev, contents="false", **options).select("path", "oid")
    extra = also.select(F.col("path").alias("also")).distinct()
    wanted = listed.join(extra, listed["path"] == F.col("also"), "left").where(F.col("also").isNotNull() | paths.matches_filters(F.col("path"), filters)).select("path", "oid")
    repo = os.path.abspath(repo)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for path, _, source in git_source.blobs(repo, rev, ((p, o) for b in batches for p, o in zip(b["path"], b["oid"], strict=True)), strict):
            rows.append((rev, path, source))
            size += len(source)
            if size > git_source.HELD_BYTES or len(rows) == git_source.HELD_ROWS:
                yield pd.DataFrame(rows, columns=["rev", "path", "source"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["rev", "path", "source"])

    return wanted.mapInPandas(read, "rev string, path string, source string")


def changed_files(spark: SparkSession, repo: str, base: str, head: str, filters: list[str] | None = None) -> DataFrame:
    """path, kind (added, modified, deleted, renamed, copied), from_path; a rename or copy passes if either side does."""
    for rev in (base, head):
        git_source.git(repo, "rev-parse", f"{rev}^{{tree}}")
    git_source.register(spark)
    found = spark.read.format("git_changes").options(base=base, head=head).load(os.path.abspath(repo))
    return found.where(paths.matches_filters(F.col("path"), filters or []) | F.coalesce(paths.matches_filters(F.col("from_path"), filters or []), F.lit(False)))


def working_tree(spark: SparkSession, root: str, filters: list[str] | None = None) -> DataFrame:
    """path, source of a directory's TypeScript and C# files; hidden, node_modules and target are skipped."""
    rows, root = [], os.path.abspath(root)
    for top, dirs, names in os.walk(root):
        dirs[:] = [x for x in dirs if not x.startswith(".") and x not in SKIPPED_DIRS]
        rows += [(os.path.relpath(os.path.join(top, n), root),) for n in names if not n.startswith(".")]
    listed = spark.createDataFrame(rows, "path string")
    wanted = listed.where(paths.is_source(F.col("path")) & paths.matches_filters(F.col("path"), filters or []))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for p in batch["path"]:
                try:
                    with open(os.path.join(root, p), encoding="utf-8") as f:
                        found.append((p, f.read()))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(found, columns=["path", "source"])

    return wanted.mapInPandas(read, "path string, source string")


def revision_paths(changed: DataFrame) -> DataFrame:
    """side (base, head), path of the files that each change is about: added and copied
    ones of head, deleted ones of base, modified ones of both, renamed ones under their
    own name of either."""
    kind, path = F.col("kind"), F.col("path")
    at = lambda side, p: F.struct(F.lit(side).alias("side"), p.alias("path"))
    base = F.when(kind == "renamed", at("base", F.col("from_path"))).when(kind.isin("modified", "deleted"), at("base", path))
    head = F.when(kind != "deleted", at("head", path))
    return changed.select(F.inline(F.array_compact(F.array(base, head))))


def report_bundles(spark: SparkSession, files: list[str]) -> DataFrame:
    """Reports written as JSON, one row each, with the file that it came from."""
    return spark.read.json(files, multiLine=True).withColumn("bundle", F.input_file_name())
