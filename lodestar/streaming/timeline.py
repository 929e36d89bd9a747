"""A timeline of component sizes that grows as reports are saved.

``report.save()`` writes a report's tables as JSON lines, head_components among them. A file stream over the
folders of many reports adds each new one to the timeline's table; a checkpoint says which files
have been read, so a stopped stream goes on where it was. A micro-batch overwrites its own
partition of the table (batch=n), so a batch that is run again after a failure
adds nothing twice. The table is long: a batch costs what it brings, whatever came before. ``timeline()``
pivots it.

Edge cases: a report that comes again, whole or in part, and pages of one component count once, the largest size
standing; a missing size or id is left out; columns that a report lacks or has
beside these are no error; no reports give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What is read of a saved head_components table.
COMPONENTS = "id string, file_count long"
ROWS = "report string, id string, file_count long"
MISSING = "—"


def saved_components(spark: SparkSession, reports: str, files_a_batch: int | None = None) -> DataFrame:
    """The stream of report (the folder's name), id, file_count of reports saved as ``reports``/name/head_components."""
    reader = spark.readStream.schema(COMPONENTS)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))
    return reader.json(f"{reports}/*/head_components").select(name.alias("report"), "id", "file_count")


def follow(components: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start adding a stream of (report, id, file_count) to the timeline's table; trigger: as of writeStream.trigger
    (availableNow=True: what is there, then end)."""

    def add(batch: DataFrame, number: int) -> None:
        sizes = batch.where("id is not null and file_count is not null").groupBy("report", "id").agg(F.max("file_count").alias("file_count"))
        sizes.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return components.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def sizes(spark: SparkSession, table: str) -> DataFrame:
    """report, id, file_count of all batches so far; none before the first one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ROWS)
    rows = spark.read.schema(ROWS).parquet(f"{table}/batch=*")
    return rows.groupBy("report", "id").agg(F.max("file_count").alias("file_count"))


def timeline(spark: SparkSession, table: str, reports: list[str] | None = None) -> DataFrame:
    """id and a column for each report, by name (or those asked for), with the component's size or —."""
    rows = sizes(spark, table)
    names = reports if reports is not None else [r[0] for r in rows.select("report").distinct().orderBy("report").collect()]  # one for each column of the result
    rows = rows if reports is None else rows.where(F.col("report").isin(names))
    if not names:
        return rows.select("id").distinct()
    pivoted = rows.groupBy("id").pivot("report", names).agg(F.max("file_count"))
    quoted = [(n, F.col(f"`{n.replace('`', '``')}`")) for n in names]
    return pivoted.select("id", *(F.coalesce(c.cast("string"), F.lit(MISSING)).alias(n) for n, c in quoted))
