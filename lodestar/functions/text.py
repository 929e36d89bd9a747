"""Column expressions over source text and report phrases; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A block comment (to the end if it isn't closed) or a line comment. Strings are not recognised.
COMMENT = r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*"
SNIPPET = 300
#: White space of any kind, and tokens of source text: comments, strings, numbers,
#: words, other characters. The body of a character class, and a pattern; Java and RE2 read both alike.
SPACES = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_QUOTED = "|".join(rf"{q}[^{q}\\{stop}]*(?:\\(?s:.)[^{q}\\{stop}]*)*{q}" for q, stop in (('"', r"\n"), ("'", r"\n"), ("`", "")))
TOKEN = rf"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|{_QUOTED}|[0-9][\p{{L}}\p{{N}}_.]*|[\p{{L}}_$][\p{{L}}\p{{N}}_$]*|=>|[^{SPACES}]"
#: Words of TypeScript and C# that aren't names.
KEYWORDS = (
    "abstract", "any", "as", "async", "await", "base", "bool", "boolean", "break", "byte", "case", "catch", "char", "checked", "class", "const", "continue", "debugger", "decimal", "declare", "default", "delegate",
    "delete", "do", "double", "else", "enum", "event", "explicit", "export", "extends", "extern", "finally", "fixed", "float", "for", "foreach", "from", "function", "get", "goto", "if", "implements", "implicit",
    "import", "in", "infer", "init", "instanceof", "int", "interface", "internal", "is", "keyof", "let", "lock", "long", "module", "namespace", "never", "new", "number", "object", "of", "operator", "out", "override",
    "params", "partial", "private", "protected", "public", "readonly", "record", "ref", "return", "sbyte", "sealed", "set", "short", "sizeof", "stackalloc", "static", "string", "struct", "super", "switch", "symbol",
    "this", "throw", "try", "type", "typeof", "uint", "ulong", "unchecked", "undefined", "unknown", "unsafe", "ushort", "using", "var", "virtual", "void", "volatile", "when", "where", "while", "with", "yield",
)
LITERAL_WORDS = ("true", "false", "null")
#: Between the parts that a hash covers.
JOIN = "\x01"


def normalize(source: Column) -> Column:
    """Source without comments, white space (any Unicode kind) collapsed and trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(source, COMMENT, " "), r"(?U)\s+", " "))


def exact_hash(source: Column) -> Column:
    return F.sha2(normalize(source), 256)


def tokens(source: Column) -> Column:
    """Tokens of source text, comments among them."""
    return F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0))


def is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def kind(token: Column) -> Column:
    """What a token is whatever a name or a value says: keywords and signs stay, names are ID, values LIT."""
    first = F.substring(token, 1, 1)
    quoted = first.isin('"', "'", "`") & (F.length(token) > 1)
    return (
        F.when(is_comment(token), "comment").when(token.isin(*LITERAL_WORDS) | quoted | first.between("0", "9"), "LIT")
        .when(token.isin(*KEYWORDS), token).when(first.rlike(r"^[\p{L}_$]"), "ID").otherwise(token)
    )


def token_hashes(every: Column) -> dict[str, Column]:
    """lexical_hash, token_hash and ast_hash from tokens(). White space and comments
    don't count, but for the number of comments in ast_hash."""
    code = F.filter(every, lambda t: ~is_comment(t))
    kinds = F.array_join(F.transform(code, kind), JOIN)
    return {
        "lexical_hash": F.sha2(F.array_join(code, JOIN), 256), "token_hash": F.sha2(kinds, 256),
        "ast_hash": F.sha2(F.concat(kinds, F.lit("#"), (F.size(every) - F.size(code)).cast("string")), 256),
    }


def shape_hash(every: Column, least: int) -> Column:
    """Hash of the kinds of tokens(), comments among them; null with under ``least``."""
    return F.when(F.size(every) >= least, F.sha2(F.array_join(F.transform(every, kind), JOIN), 256))


def lines(source: Column) -> Column:
    """Lines of a text; a final line feed ends the last line and adds none."""
    return F.when(source == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(source, r"\n\z", ""), "\n"))


def code_lines(source: Column) -> Column:
    return F.size(lines(source)).cast("long")


def line_metrics(source: Column) -> Column:
    """struct(code, comment, blank): a fold over the lines that remembers whether
    a block comment is open. A line that starts as code is code throughout and
    opens no block."""
    start = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("code", "comment", "blank")), F.lit(False).alias("open"))

    def step(s: Column, raw: Column) -> Column:
        line = F.btrim(raw, F.lit(" \t\r\x0b\x0c"))
        blank = line == ""
        starts = line.startswith("/*")
        comment = s["open"] | starts | line.startswith("//")
        still = F.when(blank, s["open"]).when(s["open"], ~line.contains("*/")).when(starts, ~F.substring(line, 3, 1 << 30).contains("*/")).otherwise(False)
        add = lambda name, when: (s[name] + F.when(when, 1).otherwise(0)).alias(name)
        return F.struct(add("code", ~blank & ~comment), add("comment", ~blank & comment), add("blank", blank), still.alias("open"))

    return F.aggregate(lines(source), start, step, lambda s: F.struct(s["code"].alias("code"), s["comment"].alias("comment"), s["blank"].alias("blank")))


def format_percent(value: Column) -> Column:
    return F.format_string("%.0f%%", value * 100)


def count_phrase(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, f"1 {one}").otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def join_phrases(parts: Column) -> Column:
    """a / a and b / a, b, and c"""
    size = F.size(parts)
    rest = F.array_join(F.slice(parts, 1, F.greatest(size - 1, F.lit(1))), ", ")
    return F.when(size == 0, "").when(size == 1, F.get(parts, F.lit(0))).when(size == 2, F.array_join(parts, " and ")).otherwise(F.concat(rest, F.lit(", and "), F.element_at(parts, -1)))


def backtick_list(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")


def snippet(source: Column, size: int = SNIPPET) -> Column:
    return F.substring(source, 1, size)


def filename_stamp(time: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if time is None else time, "yyyy-MM-dd'T'HH-mm-ss")


def marker(kind: Column) -> Column:
    return F.when(kind == "added", "+").when(kind == "removed", "-").when(kind == "modified", "~").when(kind == "moved", "→").otherwise("↩")


def kind_icon(kind: Column) -> Column:
    return (
        F.when(kind.isin("function", "method"), "fn").when(kind == "class", "cls").when(kind == "interface", "ifc")
        .when(kind == "enum", "enum").when(kind == "property", "prop").when(kind == "constructor", "ctor").otherwise(F.substring(kind, 1, 3))
    )


def truncate(value: Column, most: int) -> Column:
    """value, with an ellipsis in place of what is over ``most`` characters."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, max(0, most - 1)), F.lit("…"))).otherwise(value)


def short_path(path: Column, most: int | None = None) -> Column:
    """The last two segments."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    found = F.coalesce(F.when(F.size(parts) <= 2, path).otherwise(F.array_join(F.slice(parts, -2, 2), "/")), F.lit(""))
    return found if most is None else truncate(found, most)


def wrap_label(path: Column, most: int) -> Column:
    """A short path as one line, or as two: its folder and its name, or its halves."""
    label = short_path(path, 64)
    parts, half = F.split(label, "/"), F.ceil(F.length(label) / 2).cast("int")
    folder, name = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/"), F.element_at(parts, -1)
    first = F.when(F.size(parts) > 1, folder).otherwise(F.substr(label, F.lit(1), half))
    second = F.when(F.size(parts) > 1, name).otherwise(F.substr(label, half + 1, F.length(label)))
    return F.when(F.length(label) <= most, F.array(label)).otherwise(F.array(truncate(first, most), truncate(second, most)))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fnv1a_64(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes as a signed 64-bit pattern, by a fold over
    two 32-bit halves (products wrap, which 64-bit ones may not under ANSI)."""
    h = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    positions = F.when(F.length(h) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.length(h) / 2 - 1).cast("int")))
    low32 = F.lit(0xFFFFFFFF)
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(s: Column, i: Column) -> Column:
        x = s["lo"].bitwiseXOR(byte(i))
        lo = x * 0x1B3
        hi = s["hi"] * 0x1B3 + F.shiftleft(x, 8).bitwiseAND(low32) + F.shiftright(lo, 32)
        return F.struct(hi.bitwiseAND(low32).alias("hi"), lo.bitwiseAND(low32).alias("lo"))

    return F.aggregate(positions, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))
