"""Queries over source files generated from whole documents, one for each, for the parsers; and
two files of our own for unit tests. A document's text stands in an element's text or in a
comment before the declarations, whose rows, moved down by the text's lines, the SQL has."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.sources import parse

TS = """export interface Shape { area(): number; }
export async function draw(shape: Shape, scale: number): Promise<string> { return `size ${shape.area() * scale}`; }
export class Square implements Shape {
  private side = 2; // length
  constructor(side: number) { this.side = side; }
  async load(url: string): Promise<void> { if (url) { await fetch(url); } }
  area(): number { return this.side * this.side; }
}
type Name = string;
function helper(a) { return a }
"""
CS = """namespace Demo {
  public interface IStore { void Put(string key); }
  public class Store : IStore {
    private readonly string _name;
    public Store(string name) { _name = name; }
    public string Name { get; set; }
    public async Task<int> CountAsync(string key) { return await Run(key); }
    private int Twice(int n) => n * 2;
    public void Put(string key) { }
  }
}
"""

#: Declarations of a generated file: kind of entity and of symbol, name, lines, columns,
#: source, signature, qualifiers, parent, exported; # stands for the document's id, % for its n_chars, and in _FILES
#: @ for its text, without the signs of TAKEN.
_TS = [
    ("class", "Class", "Doc#", 2, 5, 8, 2, "class Doc# extends Base {\n  size = %\n  read(at: number): Map<string, number[]> { return `<${at}>` }\n}", "Doc#", "export", None, True),
    ("property", None, "size", 3, 3, 3, 0, "size = %", "", "", "Doc#", False),
    ("method", None, "read", 4, 4, 3, 0, "read(at: number): Map<string, number[]> { return `<${at}>` }", "(at: number)", "", "Doc#", False),
    ("function", "Function", "inner#", 7, 7, 3, 61, "function inner#(x): boolean { return /[\"']\\//.test(x) || %", "inner#(x): boolean", "export", None, True),
    (None, "TypeAlias", "Id#", 9, 9, 1, 18, "type Id# = string", "", "", None, False),
]
_CS = [
    ("class", "Class", "Doc#", 2, 6, 1, 2, "public class Doc# {\n  private readonly int _n = %;\n  public IEnumerable<T> Read<T>(string key) where T : class { yield break; }\n  public int Size => %;\n}", "Doc#", "public", None, True),
    ("method", "Method", "Read", 4, 4, 3, 77, "public IEnumerable<T> Read<T>(string key) where T : class { yield break; }", "IEnumerable<T> (string key)", "public", "Doc#", True),
    (None, "Property", "Size", 5, 5, 3, 0, "public int Size => %;", "", "", "Doc#", True),
    (None, "Record", "P#", 7, 7, 1, 0, "record struct P#(int X);", "", "", None, False),
]
TAKEN = "<>{}*/"
_FILES = {
    "ts": "// generated\nconst note# = () => <p title={`#`}>it's // {note#}@</p>;\nexport " + _TS[0][7] + "\nexport const go# = () => {\n  " + _TS[3][7] + " }\n}\n" + _TS[4][7] + "\n",
    "cs": "/* it's @ */ namespace N#;\n" + _CS[0][7] + "\n" + _CS[3][7] + "\n",
}
_TS[3] = (*_TS[3][:7], _TS[3][7] + " }", *_TS[3][8:])


def _files(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("string").alias("n"), F.when(F.col("doc_id") % 2 == 0, "tsx").otherwise("cs").alias("ending"), F.translate(F.coalesce("text", F.lit("")), TAKEN, " " * len(TAKEN)).alias("text"))
    source = F.when(F.col("ending") == "tsx", _FILES["ts"]).otherwise(_FILES["cs"])
    filled = F.replace(F.replace(F.replace(source, F.lit("#"), F.col("id")), F.lit("%"), F.col("n")), F.lit("@"), F.col("text"))
    return docs.select(F.concat(F.lit("src/d"), "id", F.lit("."), "ending").alias("path"), filled.alias("source"))


def parse_entities(spark, d):
    found = parse.parse_files(_files(spark, d), "entities")
    return found.drop("shape_hash").withColumn("qualifiers", F.array_join("qualifiers", ","))


def parse_symbols(spark, d):
    return parse.parse_files(_files(spark, d), "symbols")


def _texts(spark, d):
    """Whole documents as files of either language, errors and all."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ending = F.element_at(F.array(F.lit(".ts"), F.lit(".tsx"), F.lit(".cs")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return docs.select(F.concat(F.lit("text/d"), F.col("doc_id").cast("string"), ending).alias("path"), F.col("text").alias("source"))


def _cut(spark, d):
    """The generated files, each broken off somewhere."""
    part = F.crc32(F.col("path").cast("binary")) % 1000
    return _files(spark, d).withColumn("source", F.substring("source", F.lit(1), (F.length("source") * part / 1000).cast("int")))


def parse_errors(spark, d):
    return parse.parse_files(_cut(spark, d), "errors")


def syntax_hashes(spark, d):
    return parse.parse_files(_texts(spark, d), "fingerprints")


QUERIES: dict = {"parse_entities": parse_entities, "parse_symbols": parse_symbols, "parse_errors": parse_errors, "syntax_hashes": syntax_hashes}


def _literal(text: str | None) -> str:
    if text is None:
        return "NULL::VARCHAR"
    quoted = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"replace(replace({quoted}, '#', doc_id::VARCHAR), '%', n_chars::VARCHAR)"


def _sql(kind: int) -> str:
    parts = []
    for ending, digit, rows in (("ts", 0, _TS), ("cs", 1, _CS)):
        path, ord_, more = f"'src/d' || doc_id || '.{ending}{'x' * (ending == 'ts')}'", 0, int(ending == "ts")
        line = lambda n: f"({n + more} + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))::INT"  # noqa: B023, E731
        for row in rows:
            if row[kind] is None:
                continue
            name, start, end, column, _, source, signature, qualifiers, parent, exported = row[2:]
            if kind == 0:
                columns = {"kind": f"'{row[0]}'", "name": _literal(name), "file_path": path, "start_line": line(start), "end_line": line(end), "source": _literal(source), "signature": _literal(signature), "qualifiers": _literal(qualifiers), "parent": _literal(parent)}
            else:
                last = source.rpartition("\n")[2]
                at = f"length({_literal(last)}) + {column if chr(10) not in source else 1}"
                columns = {"file": path, "kind": f"'{row[1]}'", "qualified_name": _literal(name), "name": _literal(name), "exported": str(exported).lower(), "signature": _literal(source), "start_line": line(start), "start_column": f"{column}::INT", "end_line": line(end), "end_column": f"({at})::INT", "ord": f"{ord_}::BIGINT"}
                ord_ += 1
            parts.append("SELECT " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM documents WHERE doc_id % 2 = {digit}")
    return " UNION ALL ".join(parts)


ORACLE_SQL = {"parse_entities": _sql(0), "parse_symbols": _sql(1)}
