"""Contents are parsed once, in one run and across runs."""

import pytest

from lodestar.plans import report, samples
from lodestar.sources import content, parse

A, B, C = samples.TS, samples.TS.replace("Square", "Circle"), samples.CS


@pytest.fixture(scope="module")
def sides(spark):
    rows = {"base": [("src/a.ts", A), ("src/copy.ts", A), ("src/c.cs", C), ("same.ts", "x" * 5), ("same.cs", "x" * 5)], "head": [("src/a.ts", B), ("src/copy.ts", A), ("src/c.cs", C), ("src/none.ts", None), ("note.txt", A)]}
    return {k: spark.createDataFrame(v, "path string, source string") for k, v in rows.items()}


@pytest.mark.parametrize("what", ["symbols", "entities", "fingerprints", "errors"])
def test_parsed_once(sides, what):
    """The rows are those of parsing every file."""
    found = content.parsed(sides, what)
    for side, files in sides.items():
        want = parse.parse_files(files, what)
        assert found[side].columns == want.columns
        assert sorted(map(str, found[side].collect())) == sorted(map(str, want.collect()))


def test_kept_between_runs(spark, sides, tmp_path):
    keep = str(tmp_path / "kept")
    count = lambda: spark.read.parquet(f"{keep}/done").count()
    first = content.parsed(sides, "symbols", keep)
    want = {k: sorted(map(str, f.collect())) for k, f in first.items()}
    # of ten files: A.ts, B.ts, C.cs, the two of five letters, the empty one and the text
    assert count() == 7
    again = content.parsed(sides, "symbols", keep)
    assert {k: sorted(map(str, f.collect())) for k, f in again.items()} == want and count() == 7
    more = {"head": spark.createDataFrame([("new/place.ts", A), ("new.ts", A + "export function more() { return 1 }")], "path string, source string")}
    found = content.parsed(more, "symbols", keep)["head"]
    assert sorted(map(str, found.collect())) == sorted(map(str, parse.parse_files(more["head"], "symbols").collect())) and count() == 8
    # rows of a batch that did not end are not there
    spark.read.parquet(f"{keep}/rows").selectExpr("* EXCEPT (batch)", "'lost' AS batch").limit(3).write.mode("append").parquet(f"{keep}/rows")
    assert {k: sorted(map(str, f.collect())) for k, f in content.parsed(sides, "symbols", keep).items()} == want


def test_report_of_kept_rows(spark, sides, tmp_path):
    renames = spark.createDataFrame([], "from_path string, to_path string")
    plain = report.render(report.analyze(*sides.values(), renames), "json")
    assert report.render(report.analyze(*sides.values(), renames, keep=str(tmp_path)), "json") == plain
    assert report.render(report.analyze(*sides.values(), renames, keep=str(tmp_path)), "json") == plain
