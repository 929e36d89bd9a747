"""What several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources import store

#: The white space between words, as a class body for Java's and RE2's regexes.
SPACE = r"\x20\x09-\x0D"
#: The same characters, one by one.
SPACE_CHARS = " \t\n\x0b\x0c\r"
ROWS_A_FILE = 10_000


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: later jobs
    start from the files, and a lost executor costs only its running tasks.
    rows: about how many narrow rows it has; they go to one file for each ROWS_A_FILE
    of them, where there would be more files."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = store.place(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, texts: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts of about size bytes of the texts in that column (one text
    at least), so that a worker holds few texts as Python objects at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size)))
        yield batch.slice(start, stop - start)
        start = stop


def texts(docs: DataFrame, *others: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, text and any others of docs, for a Python operator, whose Arrow batches are
    bounded by rows and bytes (store.bound_batches())."""
    store.bound_batches(docs.sparkSession)
    return docs.select(*ids, "text", *others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """name, or a longer one that is none of the columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def having_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (doc_id, distinct). Ids grow with the input, so they
    are never broadcast; texts stream past a hash table of their partition's ids."""
    name = fresh(docs, "kept_id")
    return docs.join(ids.select(F.col("doc_id").alias(name)).hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(docs: DataFrame, size: int) -> int:
    """At least the session's shuffle partitions, and so many that each gets about size bytes of
    docs' files by the planner's statistics, which read no data. Without files they are unknown."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffle_partitions(docs.sparkSession), -(-known // size) if known < 1 << 56 else 0)


def let(value, body):
    """body(value) as a column, with value evaluated once per row: a lambda's
    variable is bound, where a column used twice could be expanded twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(column):
    """A-Z to a-z, and no other letter."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(column):
    """The words of a text as an array; null or blank: empty."""
    trimmed = F.btrim(F.coalesce(column, F.lit("")), F.lit(SPACE_CHARS))
    return F.filter(F.split(trimmed, f"[{SPACE}]+"), lambda w: w != "")
