"""Work on file contents, done once for each distinct content.

Two revisions share most of their files, and so do two runs. A content's id is the
hash of its text and of what else the result depends on; each id is worked on
once, whichever revisions and paths hold it, and rows are joined back by id. With
a folder to keep results in, ids that it has are not worked on again: what is new is added as a
batch of its own, so a run that fails leaves the folder as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources import parse
from lodestar.sources.store import stored

ID = "content_id"


def content_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def once(contents: DataFrame, work: Callable[[DataFrame], DataFrame], keep: str | None = None) -> DataFrame:
    """The rows of work(frame) of distinct contents. contents: ID and what work reads, which is the same for one ID;
    work's rows carry ID. keep: a folder shared by runs; ids that it has are read from there."""
    spark = contents.sparkSession
    others = [c for c in contents.columns if c != ID]
    distinct = contents.groupBy(ID).agg(*(F.first(c).alias(c) for c in others))
    if keep is None:
        return stored(work(distinct))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{keep}/done")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        distinct = distinct.join(spark.read.parquet(f"{keep}/done").select(ID), ID, "left_anti")
    distinct, batch = stored(distinct), F.lit(uuid.uuid4().hex).alias("batch")
    work(distinct).select("*", batch).write.mode("append").parquet(f"{keep}/rows")
    distinct.select(ID, batch).write.mode("append").parquet(f"{keep}/done")  # rows of a batch that isn't here don't count
    done = spark.read.parquet(f"{keep}/done").join(contents.select(ID).distinct(), ID, "left_semi")
    return spark.read.parquet(f"{keep}/rows").join(done, [ID, "batch"]).drop("batch")


def parsed(sides: dict[str, DataFrame], what: str, keep: str | None = None) -> dict[str, DataFrame]:
    """parse_files() of each side's files (path, source), each content read once; keep: see once()."""
    column = {"errors": "path", "fingerprints": "path", "symbols": "file", "entities": "file_path"}[what]
    ending = F.lower(F.regexp_extract("path", r"\.[^./]*$", 0))
    own = {side: files.select("path", "source", content_id(F.lit(what), ending, F.col("source")).alias(ID)) for side, files in sides.items()}
    every = None
    for files in own.values():
        named = files.select(ID, F.concat(F.col(ID), ending).alias("path"), "source")
        every = named if every is None else every.unionByName(named)

    def work(contents: DataFrame) -> DataFrame:
        return parse.parse_files(contents.select("path", "source"), what).withColumn(ID, F.substring(column, 1, 64))

    rows = once(every, work, keep)
    order = [c.split()[0] for c in parse._PARSERS[what][1].split(", ")]
    place = lambda c: F.col("own_path").alias(c) if c == column else F.col(c)
    found = {}
    for side, files in own.items():
        joined = files.select(ID, F.col("path").alias("own_path")).join(rows, ID)
        if what == "symbols":
            joined = joined.withColumn("file", F.col("own_path"))
        found[side] = joined.select(*(place(c) for c in order))
    return found
