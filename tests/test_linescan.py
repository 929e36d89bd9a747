"""The scan over cut texts against the fold over whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import linescan

PIECES = ["", " \t", "x = 1", "// said", "/* one */", "/* opens", "still", "ends */", "/*/", "a /* b", "*/ c", "/**/ d", "\r", "/* a */ /* b"]


def by_hand(source):
    """The rules, line by line."""
    code = comment = blank = 0
    inside = False
    lines = source.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        line = line.strip(" \t\r\x0b\x0c")
        if not line:
            blank += 1
        elif inside:
            comment += 1
            inside = "*/" not in line
        elif line.startswith("/*"):
            comment += 1
            inside = "*/" not in line[2:]
        elif line.startswith("//"):
            comment += 1
        else:
            code += 1
    return code, comment, blank


def sample(n, seed=7):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) + rng.choice(["", "\n"]) for _ in range(n)]


@pytest.mark.parametrize("lines_a_run", [1, 3, 1000])
def test_cut_at_any_line(spark, lines_a_run):
    texts = sample(150)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    found = {r["id"]: tuple(r)[1:] for r in linescan.text_metrics(df, "id", "t", lines_a_run).collect()}
    assert found == {i: by_hand(t) for i, t in enumerate(texts)}
    fold = df.select("id", text.line_metrics(F.col("t")).alias("m")).select("id", "m.*")
    assert found == {r["id"]: tuple(r)[1:] for r in fold.collect()}


def test_rounds_of_composition(spark, monkeypatch):
    """A few runs at a time, over several rounds, give what one does."""
    texts = sample(12, 3)
    rows = spark.createDataFrame([(i, k, line) for i, t in enumerate(texts) for k, line in enumerate(t.removesuffix("\n").split("\n") if t else [])], "id int, at long, line string").coalesce(1)
    found = linescan.compose(linescan.stored(linescan.runs(rows, ["id", "at"], "line")), ["id"], ["at", "n"], 2)
    assert {r["id"]: tuple(r)[1:] for r in found.collect()} == {i: by_hand(t) for i, t in enumerate(texts) if t}


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "\n", 9), (None, "a", 9), (4, "/* a\nb", 9), (4, "/* a\nb", 9)], "id int, t string, code int")
    found = sorted((tuple(r) for r in linescan.text_metrics(df, "id", "t").collect()), key=str)
    assert found == sorted([(1, None, None, None), (2, 0, 0, 0), (3, 0, 0, 1), (None, 1, 0, 0), (4, 0, 2, 0), (4, 0, 2, 0)], key=str)
    assert linescan.text_metrics(df.limit(0), "id", "t").collect() == []


def test_large_file_in_several_tasks(spark, tmp_path):
    block = "\n".join(["/* opens", *["inside"] * 20_000, "ends */", *["x = 1;"] * 20_000, ""]) + "\n"
    (tmp_path / "a.ts").write_text(block * 30)
    (tmp_path / "b.ts").write_text("")
    (tmp_path / "c.ts").write_text("// c\r\n\r\nlet c")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        assert spark.read.text(str(tmp_path / "a.ts")).rdd.getNumPartitions() > 4
        found = {r["file"].rsplit("/", 1)[1]: tuple(r)[1:] for r in linescan.file_metrics(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {"a.ts": tuple(30 * x for x in by_hand(block)), "c.ts": (1, 1, 1)}
