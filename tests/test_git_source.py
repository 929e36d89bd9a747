"""The git data source: partitions by subtree, pushed filters, strictness."""

import subprocess

import pytest
from pyspark.sql import functions as F

from lodestar.sources import git, git_source

from .test_core import repo  # noqa: F401

FILES = {f"{a}/{b}/{n}.ts": f"// {a} {b} {n}\n" for a in ("src", "lib", "srcs") for b in ("x", "y") for n in range(3)}


@pytest.fixture
def tree(repo):  # noqa: F811
    repo(**{"top.ts": "let top\n", "top.txt": "no source\n"}, **FILES)
    return str(repo.path)


def read(spark, root, **options):
    git_source.register(spark)
    return spark.read.format("git").options(**options).load(root)


def shown(root, path):
    return subprocess.run(["git", "-C", root, "show", f"HEAD:{path}"], check=True, capture_output=True).stdout.decode()


@pytest.mark.parametrize("pieces", [1, 4, 256])
def test_every_file_once(spark, tree, pieces):
    found = read(spark, tree, pieces=pieces).collect()
    assert sorted(r["path"] for r in found) == sorted([*FILES, "top.ts"])
    assert all(r["source"] == shown(tree, r["path"]) and r["rev"] == "HEAD" and len(r["oid"]) == 40 for r in found)
    assert {(r["path"], r["source"]) for r in found} == {(r["path"], r["source"]) for r in git.files_at(spark, tree, "HEAD").collect()}
    assert read(spark, tree, pieces=pieces).rdd.getNumPartitions() >= min(pieces, 5)


def test_filters_are_pushed(spark, tree):
    some = read(spark, tree).where(F.col("path").startswith("src/") & F.col("path").endswith("1.ts") & (F.length("source") > 0))
    assert sorted(r["path"] for r in some.collect()) == ["src/x/1.ts", "src/y/1.ts"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "EndsWith" not in plan and "length(source" in plan  # those on path left the plan for the reader
    assert read(spark, tree).where(F.col("path").isin("src/x/1.ts", "lib/y/2.ts", "gone.ts")).count() == 2
    assert read(spark, tree).where(F.col("path") == "top.ts").count() == 1 and read(spark, tree).where("path is null").count() == 0
    assert read(spark, tree).where("path like '%/y/%' or path = 'top.ts'").count() == 10


def test_ruled_out_folders_are_not_listed(tree):
    reader = git_source.GitReader({"path": tree})
    rest = list(reader.pushFilters([git_source.StringStartsWith(("path",), "src/x"), git_source.StringStartsWith(("source",), "a"), git_source.EqualTo(("path",), "src/x/1.ts")]))
    assert [f.attribute for f in rest] == [("source",)]
    assert [p.prefix for p in reader.partitions()] == ["", "src/", "src/x/"]
    scoped = git_source.GitReader({"path": tree, "scope": '["./lib\\\\x", "top.ts"]'})
    assert [p.prefix for p in scoped.partitions()] == ["", "lib/", "lib/x/"]
    assert sorted(path for p in scoped.partitions() for path, _ in scoped.listed(p)) == ["lib/x/0.ts", "lib/x/1.ts", "lib/x/2.ts", "top.ts"]


def test_large_folder_is_shared_out(tree, monkeypatch):
    monkeypatch.setattr(git_source, "FOLDER_BYTES", 40)
    reader = git_source.GitReader({"path": tree})
    pieces = reader.partitions()
    assert max(p.parts for p in pieces) > 2
    assert sorted(path for p in pieces for path, _ in reader.listed(p)) == sorted([*FILES, "top.ts"])
    assert sum(b.num_rows for p in pieces for b in reader.read(p)) == len(FILES) + 1


def test_no_contents_and_any_ending(spark, tree):
    rows = read(spark, tree, contents="false", endings="").collect()
    assert len(rows) == len(FILES) + 2 and {r["source"] for r in rows} == {None}
    assert git.tracked_files(spark, tree, "HEAD").count() == len(rows)


def test_odd_blobs_and_revisions(spark, repo):  # noqa: F811
    repo(**{"a.ts": b"\xff\xfe", "b.ts": "", "c.ts": "let c\n" * 100_000})
    root = str(repo.path)
    assert {r["path"]: len(r["source"]) for r in read(spark, root).collect()} == {"b.ts": 0, "c.ts": 600_000}
    with pytest.raises(Exception, match="UnicodeDecodeError|utf-8"):
        read(spark, root, strict="true").collect()
    with pytest.raises(subprocess.CalledProcessError):
        git.files_at(spark, root, "nowhere")
    repo.git("rm", "-q", "-r", ".")
    repo.git("commit", "-qm", "empty")
    assert read(spark, root).count() == 0 and read(spark, root, rev="HEAD~1").count() == 2


def test_scope_and_also(spark, tree):
    also = spark.createDataFrame([("lib/x/0.ts",), ("gone.ts",), (None,)], "path string")
    found = git.files_at(spark, tree, "HEAD", ["src/x"], True, also).collect()
    assert sorted(r["path"] for r in found) == ["lib/x/0.ts", "src/x/0.ts", "src/x/1.ts", "src/x/2.ts"]
    assert all(r["source"] == shown(tree, r["path"]) for r in found)


def test_changes(spark, repo):  # noqa: F811
    repo(**{"a.ts": "let a\n" * 9, "b.ts": "b\n", "c.ts": "c\n"})
    repo.git("mv", "a.ts", "d.ts")
    repo.git("rm", "-q", "b.ts")
    repo(**{"c.ts": "changed\n", "e\nf.ts": "e\n"})
    rows = git.changed_files(spark, str(repo.path), "HEAD~1", "HEAD").collect()
    assert {tuple(r) for r in rows} == {("d.ts", "renamed", "a.ts"), ("b.ts", "deleted", None), ("c.ts", "modified", None), ("e\nf.ts", "added", None)}
    assert git.changed_files(spark, str(repo.path), "HEAD", "HEAD").count() == 0
