"""Narrow tables that several steps of a plan read, written once.

They go to the folder that driver and executors share (``spark.checkpoint.dir``,
or the context's checkpoint folder), so a lost executor costs only its running
tasks and no text is tokenised twice.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[tuple[SparkSession, str]]] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder. A local master, whose tasks share the driver's disk, may do
    without: a temporary folder then. On a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def place(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by clean() or when the process ends."""
    path = f"{folder(spark).rstrip('/')}/lodestar-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Below so many bytes of files a table may lie in fewer splits than there are cores.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it is small by the planner's statistics; a larger table
    has splits enough, and its texts aren't moved. For work that costs more than reading."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df


#: Bounds of the Arrow batches that Python operators read.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows and about BATCH_BYTES bytes, or the
    session's own lower bounds: texts can be long, and a batch is buffered by the JVM,
    outside its heap, and again by the worker. One row longer than that is a batch of its own."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _bytes(size: str) -> int:
    """A setting's number, with a unit of bytes or without."""
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit.rstrip("b")[:1] or " ")


def clean(spark: SparkSession) -> None:
    """Delete what was written; frames that read it can't be used any more."""
    context = spark.sparkContext
    for _, path in _written.pop(context.applicationId, []):
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean_all() -> None:
    for held in list(_written.values()):
        try:
            clean(held[0][0])
        except Exception:  # the context has ended; a local folder can still go
            for _, path in held:
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
