"""Whole comparisons and their renderings. What is rendered comes to the driver;
everything before stays in DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import changes, clones, findings
from lodestar.sources import content, git, parse
from lodestar.sources.store import stored


def file_hashes(files: DataFrame) -> DataFrame:
    """path and three hashes: of the tokens, of their kinds, and of the tree of brackets with its comments."""
    return parse.parse_files(files, "fingerprints")


def entity_changes(base_files: DataFrame, head_files: DataFrame) -> DataFrame:
    ordered = lambda f: parse.parse_files(f, "entities").withColumn("ord", F.col("start_line"))
    return changes.diff_entities(ordered(base_files), ordered(head_files))


def analyze(base_files: DataFrame, head_files: DataFrame, renames: DataFrame, rename_mode: str = "observed", keep: str | None = None) -> dict[str, DataFrame]:
    """The tables of a report over files (path, source) and renames (from_path, to_path).
    Each content is parsed once, whichever revisions hold it; keep: a folder in which later runs find the rows."""
    sides = {"base": base_files, "head": head_files}
    hashes, symbols = ({k: stored(f) for k, f in content.parsed(sides, what, keep and f"{keep}/{what}").items()} for what in ("fingerprints", "symbols"))
    base, head = hashes["base"], hashes["head"]
    base_symbols, head_symbols = (findings.with_spans(symbols[k]) for k in sides)
    symbols = stored(changes.diff_symbols(base_symbols, head_symbols, renames, rename_mode))
    files = stored(changes.without_renames(changes.diff_files(base, head), renames))
    groups, drifts = stored(clones.clone_groups(head, "lexical_hash")), stored(clones.clone_drift(base, head))
    found = findings.all_findings(
        findings.file_findings(files, head_symbols, head), findings.clone_findings(groups, head_symbols), findings.rename_findings(changes.renamed_files(renames, base, head), head_symbols),
        findings.symbol_findings(symbols), findings.api_findings(symbols), findings.drift_findings(drifts, head_symbols),
    )
    return {
        "change_set": files, "clone_groups": groups, "renames": renames, "symbol_changes": symbols, "api_changes": changes.api_changes(symbols), "clone_drift": drifts,
        "findings": found, "base_components": clones.component_rollup(base), "head_components": clones.component_rollup(head),
    }


def analyze_repo(spark: SparkSession, repo: str, base: str, head: str, filters: list[str] | None = None, rename_mode: str = "observed") -> dict[str, DataFrame]:
    """The tables of a report between two revisions. A change in scope has both of its
    sides read, so a rename that leaves or enters the scope is still compared."""
    changed = git.changed_files(spark, repo, base, head, filters)
    also = git.revision_paths(changed)
    renamed = changed.where("kind = 'renamed'").select(F.col("from_path"), F.col("path").alias("to_path"))
    base_files, head_files = (git.files_at(spark, repo, rev, filters, True, also.where(F.col("side") == side)) for side, rev in (("base", base), ("head", head)))
    return analyze(base_files, head_files, renamed, rename_mode)


#: Order of each table where it is shown.
ORDER = {
    "change_set": ["path"], "clone_groups": ["fingerprint", "page"], "renames": ["to_path"], "symbol_changes": ["file", "symbol_kind", "qualified_name"], "api_changes": ["file", "symbol_kind", "qualified_name"],
    "clone_drift": ["fingerprint", "page"], "findings": ["section", "position"], "base_components": ["id", "page"], "head_components": ["id", "page"],
}


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as JSON lines in a folder of its own, written by the tasks: for results too large to show.
    Findings carry their place in the report, idx."""
    for name, df in tables.items():
        df = findings.numbered(df) if name == "findings" else df
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def _rows(tables: dict[str, DataFrame]) -> dict:
    """What the renderings show, in order, on the driver."""
    shown = tables | {"findings": tables["findings"].withColumn("risk", text.format_percent(F.col("risk_score")))}
    found: dict = {k: [r.asDict(recursive=True) for r in df.orderBy(*ORDER[k]).collect()] for k, df in shown.items()}
    kinds = [r["change"] for r in found["change_set"]]
    counts = {k: kinds.count(k) for k in ("added", "modified", "removed")} | {"renamed": len(found["renames"]), "clones": len(found["clone_groups"]), "symbols": len(found["symbol_changes"]), "apis": len(found["api_changes"]), "drifts": len(found["clone_drift"])}
    spark = tables["findings"].sparkSession
    found["summary"] = findings.summary(spark.createDataFrame([tuple(counts.values())], list(counts))).first()[0]
    return found


def markdown(rows: dict[str, list[dict]]) -> str:
    line = lambda f: f"- {f['title']}: {f['detail']}"
    out = ["# Change Report", "", rows["summary"], "", "## Highlights"]
    for title, section in (("Symbol Changes", 5), ("API Changes", 6)):
        some = [line(f) for f in rows["findings"] if f["section"] == section]
        out += ["", f"## {title}", *some] if some else []
    return "\n".join([*out, *([line(f) for f in rows["findings"]] or ["- No relevant changes detected."])]) + "\n"


def pr_comment(rows: dict[str, list[dict]]) -> str:
    risky = sorted((f for f in rows["findings"] if f["risk_score"] > 0), key=lambda f: -f["risk_score"])[: findings.TOP_RISKS]
    said = [f"- risk {f['risk']}: {f['title']} — {f['detail']}" for f in risky] or ["- No high-risk API changes detected."]
    return "\n".join(["## Risk", *said]) + "\n\n" + markdown(rows)


def as_json(rows: dict) -> str:
    plain = rows | {"findings": [{k: v for k, v in f.items() if k not in ("risk", "position")} for f in rows["findings"]]}
    return json.dumps(plain, indent=2, ensure_ascii=False)


def script_safe(data: str) -> str:
    """JSON that can stand in a page's script element."""
    return data.replace("</", "<\\/")


_HEAD = """<!doctype html><meta charset="utf-8"><title>%s</title><style>
body { font: 15px system-ui; margin: 2rem; } table { border-collapse: collapse; } td, th { padding: .2rem .8rem; text-align: left; border-bottom: 1px solid #ccc; }
.pill { border: 1px solid #999; border-radius: 1em; padding: .1em .6em; margin-right: .4em; } code { background: #f2f2f2; }
</style><h1>%s</h1><script id="data" type="application/json">%s</script>
"""

#: Findings shown on a report's page; the JSON has all of them.
SHOWN = 12

_REPORT = """<p id="s"></p><p id="pills"></p><h2>Compare</h2><table id="c"></table><h2>Findings</h2><ul id="f"></ul>
<h2>Timeline</h2><input type="file" id="more" multiple accept=".json"><table id="t"></table><script>
const d = JSON.parse(document.getElementById("data").textContent), bundles = [d], at = id => document.getElementById(id);
const put = (parent, tag, ...texts) => { for (const x of texts) { const e = document.createElement(tag); e.textContent = x; parent.append(e); } };
at("s").textContent = d.summary;
for (const [name, code] of [["API removed", "api.removed"], ["API changed", "api.changed"], ["Clone drift", "clone.drift"]])
  { put(at("pills"), "span", `${name}: ${d.findings.filter(f => f.code === code).length}`); at("pills").lastChild.className = "pill"; }
const sizes = side => new Map(d[side + "_components"].map(c => [c.id, c])), base = sizes("base"), head = sizes("head");
put(at("c").insertRow(), "th", "component", "base", "head", "change", "files");
for (const id of [...new Set([...base.keys(), ...head.keys()])].sort()) {
  const b = base.get(id), h = head.get(id), n = c => c ? c.file_count : 0, delta = n(h) - n(b);
  put(at("c").insertRow(), "td", id, n(b), n(h), (delta > 0 ? "+" : "") + delta, (h || b).files.join(", "));
}
for (const f of d.findings.slice(0, SHOWN)) put(at("f"), "li", `${f.code} ${f.title}: ${f.detail}`);
if (d.findings.length > SHOWN) put(at("f"), "li", `and ${d.findings.length - SHOWN} more`);
function draw() {
  const cell = (b, id) => (b.head_components.find(c => c.id === id) || {file_count: "—"}).file_count;
  at("t").replaceChildren();
  for (const id of [...new Set(bundles.flatMap(b => b.head_components.map(c => c.id)))].sort()) put(at("t").insertRow(), "td", id, ...bundles.map(b => cell(b, id)));
}
at("more").onchange = async e => { for (const f of e.target.files) bundles.push(JSON.parse(await f.text())); draw(); };
draw();
</script>
"""

_EXPLORER = """<p id="s"></p><p id="counts"></p><input id="q" placeholder="filter files"><table id="files"></table><h2 id="name"></h2><ul id="changes"></ul><script>
const d = JSON.parse(document.getElementById("data").textContent), at = id => document.getElementById(id);
const put = (parent, tag, text) => { const e = document.createElement(tag); e.textContent = text; parent.append(e); return e; };
at("s").textContent = d.summary_line;
for (const [kind, n] of Object.entries(d.by_kind)) put(at("counts"), "span", `${kind}: ${n}`).className = "pill";
function show(path) {
  at("name").textContent = path; at("changes").replaceChildren();
  for (const c of d.view.filter(c => c.file_path === path || c.old_file_path === path)) {
    const li = put(at("changes"), "li", `${c.marker} ${c.icon} ${c.name}` + (c.old_file_path ? ` (from ${c.old_file_path})` : ""));
    if (c.before_signature !== c.after_signature) for (const s of [c.before_signature, c.after_signature]) if (s) put(put(li, "div", ""), "code", s);
  }
}
function list() {
  at("files").replaceChildren();
  for (const f of d.files.filter(f => f.path.includes(at("q").value))) {
    const row = at("files").insertRow(); row.title = f.path;
    for (const line of f.label) put(row, "td", line);
    if (f.label.length < 2) put(row, "td", "");
    put(row, "td", f.n); row.onclick = () => show(f.path);
  }
}
at("q").oninput = list; list(); if (d.files.length) show(d.files[0].path);
</script>
"""


def html(rows: dict) -> str:
    """A page that compares the components, shows the first findings and a timeline of
    component sizes, to which reports written as JSON can be added."""
    return _HEAD % ("Change report", "Change report", script_safe(as_json(rows))) + _REPORT.replace("SHOWN", str(SHOWN))


def diff_html(m: dict) -> str:
    """The page of an entity diff: its files with a filter and counts, and the changes of the one chosen, old paths included."""
    said = f"{m['from_ref']} → {m['to_ref']}: {len(m['changes'])} change(s), {len(m['files_affected'])} file(s)"
    data = m | {"summary_line": m["summary"] or said}
    return _HEAD % ("Entity changes", "Entity changes", script_safe(json.dumps(data, ensure_ascii=False))) + _EXPLORER


FORMATS = {"markdown": markdown, "json": as_json, "pr-comment": pr_comment, "html": html}


def render(tables: dict[str, DataFrame], form: str = "markdown") -> str:
    return FORMATS[form](_rows(tables))


#: Characters of a label's line in the explorer.
LABEL = 40
#: What a manifest has beside its fields, for the renderings alone.
_VIEW = ("view", "files", "by_kind")


def manifest(entity_diff: DataFrame, from_ref: str, to_ref: str) -> dict:
    """A diff on the driver: its fields, and what the renderings show of it."""
    diff = stored(entity_diff)
    shown = diff.select("*", text.marker(F.col("kind")).alias("marker"), text.kind_icon(F.col("entity_kind")).alias("icon")).orderBy("file_path", "entity_key")
    view = [r.asDict() for r in shown.collect()]
    files = clones.path_counts(diff).select("path", "n", text.wrap_label(F.col("path"), LABEL).alias("label")).orderBy("path")
    return {
        "from_ref": from_ref, "to_ref": to_ref, "changes": [{k: v for k, v in r.items() if k not in ("marker", "icon")} for r in view],
        "files_affected": [r["file_path"] for r in changes.files_affected(diff).orderBy("file_path").collect()], "summary": None,
        "view": view, "files": [r.asDict() for r in files.collect()], "by_kind": {r["kind"]: r["n"] for r in clones.entity_counts(diff, "kind").orderBy("kind").collect()},
    }


def manifest_json(m: dict) -> str:
    return json.dumps({k: v for k, v in m.items() if k not in _VIEW}, indent=2, ensure_ascii=False)


def listing(m: dict) -> str:
    out = [f"Structural diff: {m['from_ref']} → {m['to_ref']}", f"Files affected: {len(m['files_affected'])}", f"Total changes: {len(m['changes'])}", ""]
    for c in m["view"]:
        out.append(f"  [{c['marker']}] {c['entity_kind']} {c['name']} ({c['file_path']})")
        if c["kind"] == "moved":
            out += [f"      from: {c['old_file_path']}", f"      to:   {c['file_path']}"]
        if c["before_signature"] is not None and c["after_signature"] is not None and c["before_signature"] != c["after_signature"]:
            out += [f"      before: {c['before_signature']}", f"      after:  {c['after_signature']}"]
    return "\n".join(out) + "\n"


def clone_rows(entities: DataFrame) -> DataFrame:
    """kind_of_clone (exact, structural), group_key, group_size and the entities of both."""
    hashed = stored(clones.with_fingerprints(entities))
    each = [f(hashed).withColumn("kind_of_clone", F.lit(name)) for name, f in (("exact", clones.exact_clones), ("structural", clones.structural_clones))]
    return each[0].unionByName(each[1])


def duplicates(entities: DataFrame) -> dict[str, list[list[dict]]]:
    """Exact and structural clone groups of entities, each with its members in order."""
    found: dict = {"exact": {}, "structural": {}}
    snippet = text.snippet(F.col("source")).alias("source")
    rows = clone_rows(entities).orderBy("kind_of_clone", "group_key", "file_path", "start_line")
    for r in rows.select("kind_of_clone", "group_key", "name", "file_path", "start_line", snippet).collect():
        found[r["kind_of_clone"]].setdefault(r["group_key"], []).append({k: r[k] for k in ("group_key", "name", "file_path", "start_line", "source")})
    return {k: list(v.values()) for k, v in found.items()}


def duplicates_listing(groups: dict[str, list[list[dict]]]) -> str:
    out = []
    for name in ("exact", "structural"):
        out.append(f"{name.capitalize()} clones: {len(groups[name])} group(s)")
        out += ["  " + " ↔ ".join(f"{e['name']} ({e['file_path']}:{e['start_line']})" for e in g) for g in groups[name]]
    return "\n".join(out) + "\n"


def diff_prompt(m: dict) -> str:
    """Markdown that asks a reader or a model to judge an entity diff."""
    head = f"Below is a structural diff of a repository ({m['from_ref']} → {m['to_ref']}). Summarize it, name the signature changes, and say which callers may be affected.\n\n"
    if not m["changes"]:
        return head + "No structural changes detected.\n"
    out = [head + f"**{len(m['changes'])} change(s) across {len(m['files_affected'])} file(s)**", ""]
    for c in m["view"]:
        out.append(f"- [{c['marker']}] **{c['name']}** `{c['file_path']}` ({c['entity_kind']})")
        before, after = c["before_signature"], c["after_signature"]
        if None not in (before, after) and before != after:
            out += [f"  - before: `{before}`", f"  - after:  `{after}`"]
    whole = manifest_json(m)
    return "\n".join([*out, "", "<details><summary>Full JSON manifest</summary>", "", "```json", whole, "```", "</details>"]) + "\n"


def duplicates_prompt(groups: dict[str, list[list[dict]]]) -> str:
    """Markdown that asks for a way to merge each clone group."""
    out = ["Below are groups of duplicated code. For each, say whether its members do the same, how to merge them, and what to call the result.", ""]
    for name in ("exact", "structural"):
        if groups[name]:
            out += [f"## {name.capitalize()} clones ({len(groups[name])} group(s))", ""]
        for i, group in enumerate(groups[name], 1):
            out.append(f"### Group {i}")
            for e in group:
                out += [f"**{e['name']}** (`{e['file_path']}` line {e['start_line']})", "```", e["source"], "```", ""]
    return "\n".join(out if any(groups.values()) else [*out, "No duplicates detected."]) + "\n"


#: Turns a prompt into text; the caller supplies it, and nothing here opens a connection.
Narrator = Callable[[str], str]


def explained(m: dict, narrator: Narrator) -> dict:
    """A manifest whose summary is what the narrator says of it."""
    return m | {"summary": narrator(diff_prompt(m))}


def advice(groups: dict[str, list[list[dict]]], narrator: Narrator) -> list[str]:
    """What the narrator says of each clone group, exact ones first."""
    return [narrator(duplicates_prompt({"exact": [], "structural": []} | {name: [g]})) for name in ("exact", "structural") for g in groups[name]]
