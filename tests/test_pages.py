"""Groups in pages, and the running index."""

from lodestar.functions import paths
from lodestar.operators import clones, findings
from lodestar.operators.numbering import indexed


def test_a_large_group_has_bounded_rows(spark):
    files = spark.range(30_000).selectExpr("concat('src/d', id % 7, '/f', id, '.ts') AS path", "CASE WHEN id % 10 = 0 THEN concat('g', id % 500) WHEN id % 10 < 9 THEN 'all' END AS h")
    got = clones.clone_groups(files, "h", 100).collect()
    want: dict = {}
    for r in files.collect():
        want.setdefault(r["h"], []).append(r["path"])
    assert max(len(r["members"]) for r in got) < 200 and len(got) > 240
    for h, members in want.items():
        pages = [r for r in got if r["fingerprint"] == h]
        assert sorted(p for r in pages for p in r["members"]) == (sorted(members) if h else [])
        assert all(r["members"] == sorted(r["members"]) and r["n"] == len(members) for r in pages)
        assert len(pages) == 1 or len(members) > 100
    positions = [r["position"] for r in findings.clone_findings(clones.clone_groups(files, "h", 100)).collect()]
    assert len(set(positions)) == len(positions) == len(got)
    rolled = clones.component_rollup(files, 100)
    assert max(len(r["files"]) for r in rolled.collect()) < 200 and rolled.selectExpr("sum(size(files))").first()[0] == 30_000
    assert clones.component_compare(rolled, rolled).where("base_count != head_count or delta != 0").count() == 0
    assert clones.component_compare(rolled, rolled).count() == files.select(paths.component_id(files["path"])).distinct().count()


def test_drift_in_pages(spark):
    base = spark.range(3000).selectExpr("concat('f', id) AS path", "CASE WHEN id < 2900 THEN 'a' ELSE 'b' END AS token_hash")
    head = spark.range(2999).selectExpr("concat('f', id) AS path", "CASE WHEN id = 5 THEN 'c' WHEN id < 2900 THEN 'a' ELSE 'b' END AS token_hash")
    got = clones.clone_drift(base, head, 100).collect()
    assert {r["fingerprint"]: r["n_members"] for r in got} == {"a": 2900, "b": 100} and max(len(r["members"]) for r in got) < 200
    changed = sorted(p for r in got for p in r["changed_members"])
    assert changed == ["f2999", "f5"] and sum(len(r["members"]) for r in got) == 3000
    assert clones.clone_drift(base, base).count() == 0


def test_index(spark):
    """Against a numbering of all rows by one process; ties get numbers of their own."""
    rows = spark.range(5000).selectExpr("id % 13 AS a", "concat('x', id * 7 % 101) AS b", "id")
    got = sorted(indexed(rows, ["a", "b"]).collect(), key=lambda r: r["idx"])
    assert [r["idx"] for r in got] == list(range(5000))
    assert [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in rows.collect()) and sorted(r["id"] for r in got) == list(range(5000))
    assert indexed(rows.limit(0), ["a"]).count() == 0


def test_clone_groups_tokenise_once(spark):
    """Sizes and members of the groups read stored hashes: no text is tokenised in what is left of the plan."""
    from lodestar.plans import catalogue

    for name in ("token_clone_groups", "lexical_clone_groups"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan
