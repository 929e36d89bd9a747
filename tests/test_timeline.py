"""The timeline by a stream: any split into batches gives the table of one read."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import clones
from lodestar.plans import report
from lodestar.streaming import timeline

REPORTS = {
    "r1": ["src/a/x.ts", "src/a/y.ts", "lib/b/z.ts"],
    "r2": ["src/a/x.ts", "lib/b/z.ts", "lib/b/w.ts", "new/c/d.ts"],
    "r 3%": ["new/c/d.ts"],
}


def save(spark, root, name):
    files = spark.createDataFrame([(p,) for p in REPORTS[name]], "path string")
    report.save({"head_components": clones.component_rollup(files, 1)}, f"{root}/{name}")  # pages of one member


def shown(spark, table, *names):
    return sorted(tuple(r) for r in timeline.timeline(spark, table, *names).collect())


def want(spark):
    files = spark.createDataFrame([(p, n) for n, ps in REPORTS.items() for p in ps], "path string, snapshot string")
    return sorted(tuple(r) for r in clones.component_timeline(files, sorted(REPORTS)).collect())


@pytest.mark.parametrize("files_a_batch", [None, 1])
def test_batches_give_what_one_read_gives(spark, tmp_path, files_a_batch):
    root, table, offsets = (str(tmp_path / x) for x in ("reports", "table", "offsets"))
    for name in REPORTS:
        save(spark, root, name)
    timeline.follow(timeline.saved_components(spark, root, files_a_batch), table, offsets).awaitTermination()
    assert shown(spark, table) == want(spark)
    assert (spark.read.parquet(table).select("batch").distinct().count() > 1) == (files_a_batch == 1)


def test_goes_on_where_it_was(spark, tmp_path):
    root, table, offsets = (str(tmp_path / x) for x in ("reports", "table", "offsets"))
    assert shown(spark, table) == [] and shown(spark, table, ["r1"]) == []
    for name in REPORTS:
        save(spark, root, name)
        timeline.follow(timeline.saved_components(spark, root), table, offsets).awaitTermination()
        assert timeline.sizes(spark, table).where(F.col("report") == name).count() > 0
    assert shown(spark, table) == want(spark)
    timeline.follow(timeline.saved_components(spark, root), table, offsets).awaitTermination()  # nothing new
    assert shown(spark, table) == want(spark) and timeline.timeline(spark, table, ["r2"]).columns == ["id", "r2"]


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    root, table = str(tmp_path / "reports"), str(tmp_path / "table")
    save(spark, root, "r1")
    for offsets in ("one", "two"):  # a lost checkpoint: batch 0 again
        timeline.follow(timeline.saved_components(spark, root), table, str(tmp_path / offsets)).awaitTermination()
    assert timeline.sizes(spark, table).count() == 2 and spark.read.parquet(table).count() == 2


def test_odd_rows(spark, tmp_path):
    folder = tmp_path / "reports" / "odd" / "head_components"
    folder.mkdir(parents=True)
    rows = [{"id": "a", "file_count": 2, "report": "x"}, {"id": "a", "file_count": 2}, {"id": None, "file_count": 1}, {"id": "b"}, {}]
    (folder / "part.json").write_text("\n".join(map(json.dumps, rows)))
    timeline.follow(timeline.saved_components(spark, str(tmp_path / "reports")), str(tmp_path / "t"), str(tmp_path / "o")).awaitTermination()
    assert shown(spark, str(tmp_path / "t")) == [("a", "2")]
