import json
import os
import random
import re
import subprocess

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar import api, cli
from lodestar.functions import paths, text
from lodestar.operators import changes, clones
from lodestar.plans import catalogue, report, samples
from lodestar.sources import git as git_source
from lodestar.sources import parse, store

DATA = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert names == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.select(*(f'"{n}"' for n in names)).fetchall()))


def test_bound_batches(spark):
    """Python operators get batches of few bytes, and a lower bound of the session stays."""
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    held = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        for own, then in (("128m", str(store.BATCH_BYTES)), ("64MB", str(store.BATCH_BYTES)), ("2m", "2m")):
            spark.conf.set(size, own)
            spark.conf.set(rows, "500")
            store.bound_batches(spark)
            assert (spark.conf.get(size), spark.conf.get(rows)) == (then, "500")
        rows_of = lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"]) for b in batches)
        sizes = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("abcdefghij"), 100_000)).mapInArrow(rows_of, "n long")
        assert max(r["n"] for r in sizes.collect()) <= 3  # rows of 1 MB, batches of 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_text(spark):
    assert one(spark, "a /* x */ b // c\n\tdé /* open", text.normalize) == "a b dé"
    assert one(spark, "a\n// b\n/* c\n*/\n\nd", text.line_metrics).asDict() == {"code": 2, "comment": 3, "blank": 1}
    assert [one(spark, x, text.code_lines) for x in ("", "a", "a\n", "a\n\nb\n")] == [0, 1, 1, 3]
    h = 0xCBF29CE484222325
    for b in "héllo".encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert one(spark, "héllo", text.fnv1a_64) % 2**64 == h
    assert one(spark, "", text.fnv1a_64) % 2**64 == 0xCBF29CE484222325
    assert one(spark, "a\\b/c", text.short_path) == "b/c" and one(spark, "abc", lambda c: text.truncate(c, 2)) == "a…" and one(spark, "x/" + "y" * 9, lambda c: text.wrap_label(c, 5)) == ["x", "yyyy…"]
    assert one(spark, "abcdef", lambda c: text.wrap_label(c, 4)) == ["abc", "def"] and one(spark, "abc", lambda c: text.wrap_label(c, 4)) == ["abc"] and one(spark, "'x'", text.snippet) == "'x'"
    kinds = lambda x: one(spark, x, lambda c: F.transform(text.tokens(c), text.kind))
    assert kinds("if (a) { b('//x', 1.5e3, `t`) } // end") == ["if", "(", "ID", ")", "{", "ID", "(", "LIT", ",", "LIT", ",", "LIT", ")", "}", "comment"]
    hashes = lambda x: spark.createDataFrame([(x,)], "x string").select(text.tokens(F.col("x")).alias("t")).select(*text.token_hashes(F.col("t")).values()).first()
    assert hashes("b(a)") == hashes("b( a\u00a0)\n") and hashes("if (a) b()")[1] != hashes("while (a) b()")[1] and hashes("b(a)")[1] == hashes("c(d)")[1] and hashes("b(a)")[0] != hashes("c(d)")[0]
    assert hashes("b(a)")[:2] == hashes("b(a) // x")[:2] and hashes("b(a)")[2] != hashes("b(a) // x")[2] and hashes("b('a // b')")[0] != hashes("b('a")[0]
    assert one(spark, "a/b/c", text.short_path) == "b/c" and one(spark, "<a&'\">", text.html_escape) == "&lt;a&amp;&#39;&quot;&gt;"
    joined = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "p array<string>").select(text.join_phrases(F.col("p"))).collect()
    assert [r[0] for r in joined] == ["", "a", "a and b", "a, b, and c"]


@pytest.mark.parametrize(
    ("path", "want"),
    [("framework/src/A/b.cs", "framework/src/A"), ("npm/ng-packs/packages/core/x.ts", "npm/ng-packs/packages/core"), ("templates/a/b/c/d.ts", "templates/a/b/c"), ("modules/x/projects/y/z.ts", "modules/x/projects/y"),
     ("modules/x/src/y.ts", "modules/x"), ("src/a.ts", "src"), ("app/src/core/a.ts", "app/src/core"), ("app/src", "app"), ("a/b.ts", "a"), ("", "")],
)
def test_components(spark, path, want):
    assert one(spark, path, paths.component_id) == want


def test_paths(spark):
    match = lambda p, f: one(spark, p, lambda c: paths.matches_filters(c, f))
    assert match("src/a.ts", []) and match("src/a.ts", ["src/a.ts"]) and match(".\\src\\a.ts", ["./src/"]) and not match("srcs/a.ts", ["src"])
    assert one(spark, "a/Node_Modules/x", paths.is_ignored) and one(spark, "x.G.cs", paths.is_ignored) and not one(spark, "object/x.cs", paths.is_ignored)


def test_parse():
    ts = {(r["kind"], r["name"], r["parent"]) for r in parse.entities("a.ts", samples.TS)}
    assert {("interface", "Shape", None), ("function", "draw", None), ("class", "Square", None), ("method", "load", "Square"), ("constructor", "constructor", "Square"), ("property", "side", "Square")} <= ts
    assert {"export", "async"} <= set(next(r for r in parse.entities("a.ts", samples.TS) if r["name"] == "draw")["qualifiers"])
    cs = {(r["kind"], r["name"]): r for r in parse.symbols("a.cs", samples.CS)}
    assert cs["Class", "Store"]["exported"] and cs["Method", "CountAsync"]["exported"] and not cs["Method", "Twice"]["exported"]
    assert not any(n == "_name" for _, n in cs)
    assert not {r["kind"] for r in parse.symbols("a.ts", samples.TS)} & {"Method"}
    rng = random.Random(1)
    for _ in range(600):  # malformed source never raises
        bad = "".join(rng.choice(["class ", "export ", "function ", "{", "}", "(", ")", '"', "`", "${", "/*", "a ", ";", "=>", "\n", "public ", "<", ">", "/", "[", "]", "type ", "= ", "const ", "record ", "#"]) for _ in range(40))
        for path in ("a.ts", "a.cs"):
            parse.entities(path, bad), parse.symbols(path, bad), parse.fingerprints(path, bad)
    assert parse.entities("a.txt", samples.TS) == [] and parse.symbols("Makefile", samples.TS) == [] and parse.fingerprints("a.py", "x") is None


def declared(path, source):
    return [(r["kind"], r["name"], r["parent"]) for r in parse.entities(path, source)]


def test_lines_end_statements():
    assert declared("a.ts", "export const a = 1\nexport function b(x) { return x }\nclass C {\n  size = 1\n  label: string\n  run() {}\n}\n") == [("function", "b", None), ("class", "C", None), ("property", "size", "C"), ("property", "label", "C"), ("method", "run", "C")]
    names = [(r["kind"], r["name"], r["signature"]) for r in parse.symbols("a.ts", "type A =\n  | string\n  | number\nexport type B<T extends { x: 1 }> = Map<string, T>\nfunction f(): void {}\nconst n = i++\nfunction g() {}\n")]
    assert names == [("TypeAlias", "A", "type A =\n  | string\n  | number"), ("TypeAlias", "B", "type B<T extends { x: 1 }> = Map<string, T>"), ("Function", "f", "function f(): void {}"), ("Function", "g", "function g() {}")]
    assert declared("a.ts", "const p = xs\n  .map(x => x)\n  .join()\nfunction after() {}") == [("function", "after", None)]


def test_expressions_in_scripts():
    assert declared("a.ts", "const q = s.replace(/[\"'/]/g, '')\nfunction next() { return a / b / c }\nfunction last() {}") == [("function", "next", None), ("function", "last", None)]
    assert declared("a.ts", "const t = `a ${f(`}`)} {`\nfunction next() {}") == [("function", "next", None)]
    found = parse.entities("a.ts", "export const go = () => {\n  function inner() {}\n}\nexport default class D<T> extends B<{ a: T }> {\n  private async *load<U>(x: U): Promise<{ a: U }> { }\n  get v() { return 1 }\n  abstract w(): void;\n  constructor();\n  constructor(a?: number) { super() }\n  #p = { if: 1 };\n  [key]() {}\n}\nconst o = { run(a) { return a }, other: 1 }\nnamespace N { export function deep() {} }\n")
    assert [(r["kind"], r["name"], r["parent"], r["qualifiers"], r["signature"]) for r in found] == [
        ("function", "inner", None, ["export"], "inner()"), ("class", "D", None, ["export"], "D"), ("method", "load", "D", ["async"], "(x: U)"), ("method", "v", "D", [], "()"), ("constructor", "constructor", "D", [], "(a?: number)"),
        ("property", "#p", "D", [], ""), ("method", "[key]", "D", [], "()"), ("method", "run", None, [], "(a)"), ("function", "deep", None, ["export"], "deep()"),
    ]
    assert parse.entities("a.ts", "class A { private static run() {} }", accessibility=True)[1]["qualifiers"] == ["private", "static"]
    assert [(r["name"], r["exported"]) for r in parse.symbols("a.ts", "abstract class A {}\nexport abstract class B {}\nexport namespace N { class C {} }")] == [("C", True)]


def test_members_of_csharp():
    cs = "namespace A.B;\n[Serializable]\npublic sealed class S<T> : Base<T>, IX where T : class {\n  [Inject] private readonly IFoo<Bar> _foo = new();\n  public IEnumerable<T> M<U>(Func<T, U> f) where U : struct => f(null);\n  public (int, string) Pair() { return (1, \"}\"); }\n  public S(int a) : base(a) { }\n  public string this[int i] { get => null; }\n  public static S<T> operator +(S<T> a, S<T> b) => a;\n  public event Action E;\n  public int P { get; set; } = 3;\n  ~S() { }\n  private class Inner { void Deep() { } }\n  delegate void D(int x);\n  const string V = @\"a\"\"b{\";\n}\npublic record struct R(int X);\nstruct V { public void InStruct() { } }\npublic interface IX { void Put(); int Q { get; } }\n"
    assert declared("a.cs", cs) == [("class", "S", None), ("method", "M", "S"), ("method", "Pair", "S"), ("constructor", "S", "S"), ("class", "Inner", "S"), ("method", "Deep", "Inner"), ("method", "InStruct", None), ("interface", "IX", None)]
    assert next(r for r in parse.entities("a.cs", cs) if r["name"] == "M")["signature"] == "IEnumerable<T> (Func<T, U> f)"
    assert [(r["kind"], r["name"], r["exported"]) for r in parse.symbols("a.cs", cs)] == [
        ("Class", "S", True), ("Method", "M", True), ("Method", "Pair", True), ("Constructor", "S", True), ("Property", "P", True), ("Class", "Inner", False), ("Method", "Deep", False), ("Record", "R", True), ("Method", "InStruct", True), ("Interface", "IX", True),
        ("Method", "Put", False), ("Property", "Q", False),
    ]


def test_fingerprints(spark):
    hashes = lambda x, path="a.ts": tuple(parse.fingerprints(path, x)[k] for k in ("lexical_hash", "token_hash", "ast_hash"))
    assert hashes("b(a)") == hashes(" b( a )\n") and hashes("f(x)")[0] != hashes("g(y)")[0] and hashes("f(x)")[1:] == hashes("g(y)")[1:]
    assert hashes("if (a) { b() }")[1] != hashes("while (a) { b() }")[1] and hashes("f('// a')")[0] != hashes("f('//  a')")[0]
    plain, outer, inner = hashes("f() { g() }"), hashes("/* c */ f() { g() }"), hashes("f() { /* c */ g() }")
    assert plain[:2] == outer[:2] == inner[:2] and len({plain[2], outer[2], inner[2]}) == 3  # a comment counts where it lies
    assert inner == hashes("f() { /* other words */ g() }") and hashes("x", "a.cs") == hashes("x")
    body = "{ const total = a + b; for (const x of list) { total += x } return total }"
    e = [dict(r) for r in parse.entities("a.ts", f"function one(a, b, list) {body}\nfunction two(c, d, list) {body.replace('a + b', 'c + d')}\nfunction three(c, d, list) {body.replace('for', 'while')}")]
    frame = spark.createDataFrame([(r["name"], r["source"], r["shape_hash"]) for r in e], "name string, source string, shape_hash string")
    assert sorted(r["name"] for r in clones.structural_clones(frame).collect()) == ["one", "two"]
    again = spark.createDataFrame([(r["name"], r["source"]) for r in e], "name string, source string")
    assert sorted(r["name"] for r in clones.structural_clones(again).collect()) == ["one", "two"]


def entity(**k):
    return {"kind": "function", "parent": None, "name": "f", "file_path": "a.ts", "signature": "s", "source": "x", "ord": 1} | k


SCHEMA = "kind string, parent string, name string, file_path string, signature string, source string, ord int"


def test_entities(spark):
    frame = lambda *rows: spark.createDataFrame([tuple(entity(**r).values()) for r in rows], SCHEMA)
    diff = lambda a, b: sorted((r["kind"], r["name"], r["old_file_path"]) for r in changes.diff_entities(a, b).collect())
    assert diff(frame({}), frame({})) == []
    assert diff(frame({}), frame({"signature": "t"})) == [("modified", "f", None)]
    assert diff(frame({}), frame({"file_path": "b.ts", "source": "y"})) == [("moved", "f", "a.ts")]
    assert diff(frame({}, {"name": "g"}), frame({}, {"name": "h"})) == [("added", "h", None), ("removed", "g", None)]
    assert diff(frame({}, {"file_path": "b.ts"}), frame({"file_path": "c.ts"})) == []  # ambiguous, same content
    e = frame({}, {"name": "g", "source": "x // c"}, {"name": "h", "source": "z"})
    assert sorted(r["name"] for r in clones.exact_clones(e).collect()) == ["f", "g"]


def test_changes_by_file(spark):
    frame = lambda *rows: spark.createDataFrame([tuple(entity(**r).values()) for r in rows], SCHEMA)
    diff = changes.diff_entities(frame({}, {"name": "g"}), frame({"file_path": "b.ts"}, {"name": "g", "signature": "t"}))
    assert [(r["path"], r["name"], r["kind"]) for r in changes.by_file(diff).collect()] == [("a.ts", "g", "modified"), ("a.ts", "f", "moved"), ("b.ts", "f", "moved")]
    assert sorted(r["name"] for r in changes.of_file(diff, "a.ts").collect()) == ["f", "g"] and [r["name"] for r in changes.of_file(diff, "b.ts").collect()] == ["f"]
    files = lambda *rows: spark.createDataFrame([(p, h, h, h, i) for i, (p, h) in enumerate(rows)], "path string, lexical_hash string, token_hash string, ast_hash string, ord int")
    found = changes.diff_files(files(("a", "1"), ("a", "2"), (None, "3")), files(("a", "9"), ("a", "2"), (None, "4"), ("c", "5"))).collect()
    assert sorted(map(tuple, found), key=str) == [("c", "added"), (None, "modified")]
    scope = lambda *f: sorted(r["path"] for r in paths.in_scope(spark.createDataFrame([("src/a.ts",), ("srcs/a.ts",), ("lib/x/y.cs",)], "path string"), spark.createDataFrame([(x,) for x in f], "filter string")).collect())
    assert scope() == ["lib/x/y.cs", "src/a.ts", "srcs/a.ts"] and scope("./src/") == ["src/a.ts"] and scope("lib\\x", "srcs/a.ts") == ["lib/x/y.cs", "srcs/a.ts"] and scope("./") == []


@pytest.fixture
def repo(tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    def write(**files):
        for name, content in files.items():
            path = tmp_path / name.replace("__", "/").replace("_dot_", ".")
            path.parent.mkdir(exist_ok=True, parents=True)
            path.write_bytes(content if isinstance(content, bytes) else content.encode())
        git("add", "-A")
        git("commit", "-qm", "next")

    git("init", "-q")
    write.git, write.path = git, tmp_path
    return write


TOTAL = "export function total(items: number[]) { return items.length; }\n"
SUMMED = "export function total(items: number[]) { let n = 0; for (const i of items) n += i; return n; }\n"


def test_repository(spark, repo):
    repo(src__a_dot_ts=TOTAL, src__b_dot_ts=SUMMED, src__c_dot_cs="public class C { void Broken( { }\n", src__d_dot_ts="export function scale(a: number) { return a; }\n")
    repo(src__a_dot_ts=SUMMED, src__d_dot_ts="export function scale(a: number, b: number) { return a * b; }\n")
    root = str(repo.path)
    tables = report.analyze_repo(spark, root, "HEAD~1", "HEAD")
    said = report.render(tables, "pr-comment")
    assert "2 modified files, 1 exact clone group" in said and "- risk 82%: Changed API `total`" in said
    page = report.render(tables, "html")
    assert report.render(tables, "json").startswith("{") and 'id="data"' in page and f"slice(0, {report.SHOWN})" in page and "bundles" in page and "</script" not in page.split('type="application/json">')[1].split("</script>")[0]
    rows = report._rows(tables)
    assert [f["section"] for f in rows["findings"]] == sorted(f["section"] for f in rows["findings"]) and [f["subject"] for f in rows["findings"] if f["section"] == 0] == ["src/a.ts", "src/d.ts"]
    found = {(f["code"], f["title"]): f for f in rows["findings"]}
    spans = found["api.changed", "Changed API `total`"]["evidence"][0]["spans"]
    assert [(s["file"], s["start_line"], s["start_column"], s["end_line"]) for s in spans] == [("src/a.ts", 1, 8, 1)] * 2
    assert [s["end_column"] for s in spans] == [len(TOTAL), len(SUMMED)]
    assert found["file.modified", "Modified `src/a.ts`"]["evidence"][0]["message"] == "modified file: src/a.ts"
    clone = found["clone.exact", "Exact clone group"]["evidence"][0]
    assert clone["message"] == "exact clone group: `src/a.ts`, `src/b.ts`" and [s["file"] for s in clone["spans"]] == ["src/a.ts", "src/b.ts"]
    report.save(tables, str(repo.path / "out"))
    bundle = repo.path / "bundle.json"
    bundle.write_text(report.render(tables, "json"))
    bundles = git_source.report_bundles(spark, [str(bundle)])
    assert [tuple(r)[1:] for r in clones.bundle_timeline(bundles).collect()] == [(c["id"], c["file_count"]) for c in rows["head_components"]]
    assert bundles.select("summary").first()[0] == rows["summary"] and spark.read.json(str(repo.path / "out/findings")).count() == len(rows["findings"])
    out = repo.path / "out.txt"
    assert cli.main(["diff", "--repo", root, "-o", str(out)], spark) == 0 and "[~] function scale (src/d.ts)" in out.read_text()
    assert cli.main(["duplicates", "--repo", root, "-o", str(out)], spark) == 0 and "Exact clones: 1 group(s)" in out.read_text()
    for flags, said in ((["--prompt"], "  - before: `scale(a: number)`"), (["--html"], 'id="q"'), (["--html", "--prompt", "--json"], '"files_affected": ['), (["--explain", "textwrap:dedent", "--json"], '"summary": "Below')):
        assert cli.main(["diff", "--repo", root, "-o", str(out), *flags], spark) == 0 and said in out.read_text() and '"view"' not in out.read_text().split("{")[0]
    assert cli.main(["duplicates", "--repo", root, "--prompt", "-o", str(out)], spark) == 0 and "### Group 1" in out.read_text()
    assert cli.main(["report", "--repo", root, "--base", "HEAD~1", "--head", "HEAD", "-o", str(out)], spark) == 0 and out.read_text().startswith("# Change Report")


def test_command_line_errors_and_names(spark, repo, monkeypatch, capsys):
    repo(a_dot_ts="function f() { return 1 }\n")
    repo(a_dot_ts="function f(x) { return x }\n")
    assert cli.main(["report", "--repo", str(repo.path), "--base", "no-such", "--head", "HEAD"], spark) == 1 and "no-such" in capsys.readouterr().err
    assert cli.main(["report", "--nothing"], spark) == 1 and "usage" in capsys.readouterr().err
    assert cli.main(["report", "--repo", ".", "--base", "a", "--head", "b", "--format", "pdf"], spark) == 1 and "pdf" in capsys.readouterr().err
    monkeypatch.chdir(repo.path)
    assert cli.main(["diff", "--json"], spark) == 0
    name = re.fullmatch(r"Saved to: (lodestar-\d{4}-\d\d-\d\dT\d\d-\d\d-\d\d\.json)", capsys.readouterr().err.strip())
    assert name and json.loads((repo.path / name[1]).read_text())["changes"][0]["kind"] == "modified"


def test_renames_across_the_scope(spark, repo):
    body = "export class Box {\n" + "".join(f"  m{i}(a: number) {{ return a * {i}; }}\n" for i in range(12)) + "}\n"
    repo(a__x_dot_ts=body, b__y_dot_ts="export const y = 1\n", a__z_dot_txt="x" * 50)
    repo.git("mv", "a/x.ts", "b/x.ts")
    repo.git("mv", "a/z.txt", "b/z.txt")
    repo(b__x_dot_ts=body.replace("a * 3", "a + 3"))
    all_, scoped = ({f["subject"]: f for f in report._rows(report.analyze_repo(spark, str(repo.path), "HEAD~1", "HEAD", f))["findings"] if f["code"] == "file.renamed"} for f in (None, ["b"]))
    assert all_ == scoped and set(all_) == {"b/x.ts", "b/z.txt"}
    assert all_["b/x.ts"]["severity"] == "Medium" and all_["b/x.ts"]["detail"].endswith("with content changes") and all_["b/z.txt"]["severity"] == "Low"
    evidence = all_["b/x.ts"]["evidence"][0]
    assert evidence["message"] == "rename: a/x.ts -> b/x.ts" and [s["file"] for s in evidence["spans"]] == ["b/x.ts"]
    rows = report._rows(report.analyze_repo(spark, str(repo.path), "HEAD~1", "HEAD", ["b"]))
    assert sum(r["kind"] == "removed" and r["file"] == "a/x.ts" for r in rows["symbol_changes"]) == 1
    changed = git_source.changed_files(spark, str(repo.path), "HEAD~1", "HEAD")
    assert {("base", "a/x.ts"), ("head", "b/x.ts")} <= set(map(tuple, git_source.revision_paths(changed).collect()))


def test_odd_files(spark, repo, tmp_path):
    repo(**{"a\nb_dot_ts": "function f() {}\n", "é ü_dot_cs": "class C { }\n", "bad_dot_ts": b"\xff\xfe function g() {}"})
    root = str(repo.path)
    assert sorted(r["path"] for r in git_source.files_at(spark, root, "HEAD").collect()) == ["a\nb.ts", "é ü.cs"]
    with pytest.raises(Exception, match="utf-8"):
        git_source.files_at(spark, root, "HEAD", strict=True).collect()
    assert sorted(r["path"] for r in git_source.working_tree(spark, root).collect()) == ["a\nb.ts", "é ü.cs"]
    assert git_source.files_at(spark, root, "HEAD", ["é ü.cs"]).count() == 1


def test_stored_tables(spark):
    df = store.stored(spark.range(5))
    files = [x.removeprefix("file://") for x in df.inputFiles()]
    assert df.count() == 5 and all(map(os.path.exists, files))
    store.clean(spark)
    assert not any(map(os.path.exists, files))


def test_api(spark):
    files = lambda *rows: spark.createDataFrame(rows, "path string, source string")
    tables = api.build_report(files(("a.ts", TOTAL)), files(("a.ts", SUMMED), ("b.ts", TOTAL)))
    assert report._rows(tables)["summary"] == "Detected 1 added file, 1 modified file, 2 symbol changes, and 2 api changes."
    assert all(hasattr(api, name) for name in api.__all__)
    hashes = api.parse_files(files(("a.ts", TOTAL), ("b.ts", TOTAL), ("c.ts", TOTAL.replace("items", "rows"))), "fingerprints")
    after = api.parse_files(files(("a.ts", TOTAL), ("b.ts", SUMMED), ("c.ts", TOTAL)), "fingerprints")
    assert api.detect_exact_clone_groups(hashes).select("members").first()[0] == ["a.ts", "b.ts"]
    assert [(r["n_members"], r["changed_members"]) for r in api.detect_clone_drifts(hashes, after).collect()] == [(3, ["b.ts"])]


def test_prompts():
    assert "No structural changes" in report.diff_prompt({"from_ref": "a", "to_ref": "b", "changes": [], "files_affected": [], "view": []})
    assert "No duplicates" in report.duplicates_prompt({"exact": [], "structural": []})
    e = {"name": "f", "file_path": "a.ts", "start_line": 1, "source": "x" * 300}
    said = report.advice({"exact": [[e, e]], "structural": [[e]]}, lambda p: p)
    assert len(said) == 2 and "x" * 300 in said[0] and "Structural" in said[1]


def test_line_metrics_covers_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    found = catalogue.QUERIES["line_metrics"](spark, "/root/testdata/sf0.001")
    assert sorted(r["doc_id"] for r in found.collect()) == want and any(i % 10 == 7 for i in want)
