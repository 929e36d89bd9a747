"""Declarations of TypeScript and C# files as rows, by a scan over tokens.

Not a full grammar: declarations are recognised by their keywords, brackets and
ends of statements, so any input gives a result. entities() keeps kind, parent,
signature and qualifiers; symbols() keeps the whole text as signature and what
is exported; fingerprints() hashes a file's tokens and shape; errors() says where
brackets don't balance. Files of other languages have no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodestar.functions.text import KEYWORDS, LITERAL_WORDS
from lodestar.sources import store, tree
from lodestar.sources.lexer import Token, lex, matching

ENTITY = "kind string, name string, file_path string, start_line int, end_line int, source string, signature string, qualifiers array<string>, parent string, shape_hash string"
SYMBOL = "file string, kind string, qualified_name string, name string, exported boolean, signature string, start_line int, start_column int, end_line int, end_column int, ord long"
ERROR = "path string, bracket string, start_line int, start_column int, end_line int, end_column int"
FINGERPRINT = "path string, lexical_hash string, token_hash string, ast_hash string"

TS_MODIFIERS = ("export", "async", "abstract", "static", "override", "readonly", "public", "private", "protected", "declare", "default", "accessor")
#: What is recorded of each kind's modifiers; accessibility only on request.
TS_RECORDED = {"function": ("export", "async"), "class": ("export", "abstract"), "interface": ("export",), "method": ("async", "static", "override", "abstract", "readonly"), "property": ()}
TS_ACCESSIBILITY = ("public", "private", "protected")
CS_MODIFIERS = ("public", "private", "protected", "internal", "static", "abstract", "sealed", "virtual", "override", "async", "readonly", "partial")
#: Modifiers that are passed over.
CS_OTHERS = ("new", "unsafe", "extern", "volatile", "required", "file", "ref", "const", "fixed")
_NOT_NAMES = ("if", "for", "foreach", "while", "switch", "catch", "return", "new", "using", "lock", "await", "throw", "else", "do", "try", "function", "nameof", "typeof", "super", "import", "yield", "delete")
#: A line that starts or ends with one of these goes on.
_CONTINUES = (".", ",", "?", ":", "=", "+", "-", "*", "/", "%", "&", "|", "^", "<", ">", "(", "[", "=>", ")", "]", "}", "in", "instanceof", "as", "satisfies", "extends", "implements", "is")
_OPEN = ("=", "+", "-", "*", "/", "%", "&", "|", "^", "<", "?", ":", ",", ".", "=>", "(", "[", "{", "~", "extends", "implements", "new", "typeof", "keyof", "in", "of", "instanceof", "as", "await", "return", "const", "let", "var", "type", "infer", "is", "void", "delete", "throw", "satisfies")
#: Modifiers that stand outside a declaration's own text.
TS_OUTSIDE = ("export", "default", "declare")
#: What is declared in an exported namespace is an exported symbol, but no exported entity.
AS_SYMBOL = 2
#: Structural clones need so many tokens.
MIN_TOKENS = 15


def is_typescript(path: str) -> bool | None:
    """None: another language."""
    end = path.rpartition(".")[2].lower() if "." in path else ""
    return True if end in ("ts", "tsx") else False if end == "cs" else None


def is_markup(path: str) -> bool:
    return path.lower().endswith(".tsx")


class _Scan:
    def __init__(self, path: str, source: str, typescript: bool, accessibility: bool):
        self.path, self.source, self.ts, self.accessibility = path, source, typescript, accessibility
        self.t = lex(source, typescript, markup=is_markup(path))
        self.errors: list[tuple[int, int]] = []
        self.match = matching(self.t, source, self.errors)
        self.rows: list[dict] = []

    def text(self, i: int, j: int) -> str:
        return self.source[self.t[i].start : self.t[j].start + len(self.t[j].text)] if i <= j < len(self.t) else ""

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind != "string"

    def word(self, i: int, end: int) -> bool:
        return i < end and self.t[i].kind == "word"

    def angles(self, i: int, end: int) -> int:
        """After the type parameters that start at i, or i if there are none."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < end and not self.is_(k, ";"):
            depth += self.is_(k, "<") - self.is_(k, ">")
            k = self.match.get(k, k) + 1
            if not depth:
                return k
        return i + 1

    def find(self, i: int, end: int, *texts: str) -> int:
        """The first of these tokens from i, brackets and type parameters skipped; end if there is none."""
        while i < end:
            if self.is_(i, *texts):
                return i
            i = self.angles(i, end) if self.is_(i, "<") else self.match.get(i, i) + 1
        return end

    def last_of(self, i: int, end: int) -> int:
        """The last token of the statement that starts at i: a semicolon, or the
        end of a line that neither is open nor is continued by the next."""
        k = i
        while k < end:
            if self.is_(k, ";"):
                return k
            close = min(self.match.get(k, k), end - 1)
            after = close + 1
            if after >= end or self.is_(after, ")", "]", "}"):
                return close
            if self.ts and self.t[after].breaks and not self.is_(after, *_CONTINUES, ";") and not (close == k and self.is_(k, *_OPEN) and not self.twice(k)):
                return close
            k = after
        return end - 1

    def twice(self, k: int) -> bool:
        """x++ or x-- at the end of a line."""
        return k > 0 and self.is_(k, "+", "-") and self.t[k - 1].text == self.t[k].text and self.t[k - 1].start + 1 == self.t[k].start

    def add(self, kind: str, name: str, first: int, last: int, signature: str, mods: list[str], parent: str | None, exported: bool | int, symbol_only: bool = False) -> None:
        last = min(last, len(self.t) - 1)
        while self.ts and first < last and self.is_(first, *TS_OUTSIDE) and kind not in ("method", "constructor", "property"):
            first += 1
        source = self.text(first, last)
        end_line = self.t[last].line + self.t[last].text.count("\n")
        column = lambda at: at - self.source.rfind("\n", 0, at)
        start, end = self.t[first].start, self.t[last].start + len(self.t[last].text)
        if self.ts:
            own = TS_RECORDED.get("method" if kind == "constructor" else kind, ())
            mods = ["export", *mods] if exported is True and "export" not in mods else mods
            mods = [m for m in mods if m in own or (self.accessibility and kind in ("method", "constructor", "property") and m in TS_ACCESSIBILITY)]
        else:
            mods = [m for m in mods if m in CS_MODIFIERS]
        self.rows.append({
            "kind": kind, "name": name, "file_path": self.path, "start_line": self.t[first].line, "end_line": end_line, "source": source, "signature": signature, "qualifiers": mods, "parent": parent,
            "exported": bool(exported), "start_column": column(start), "end_column": column(end), "symbol_only": symbol_only,
        })

    def block(self, i: int, end: int, parent: str | None, exported: bool | int = False, owner: str | None = None, members: bool = False, symbol_only: bool = False) -> None:
        """Declarations between tokens i and end; members: it is the body of a type, owner its name."""
        modifiers = TS_MODIFIERS if self.ts else CS_MODIFIERS + CS_OTHERS
        while i < end:
            first, mods = i, []
            while not self.ts and i < end and self.is_(i, "[") and (members or first == 0 or self.is_(first - 1, "{", "}", ";")):
                i = self.match.get(i, i) + 1  # attributes
            while self.word(i, end) and self.t[i].text in modifiers and not (self.ts and members and self.is_(i + 1, "(", ":", "=", ";", "?", "!")):
                mods.append(self.t[i].text)
                i += 1
            i = max(first + 1, self.declaration(first, i, end, mods, parent, exported, owner, members, symbol_only))

    def declaration(self, first: int, i: int, end: int, mods: list[str], parent: str | None, exported: bool, owner: str | None, members: bool, symbol_only: bool) -> int:
        """Takes the declaration whose modifiers run from first to i; returns where to go on."""
        if i >= end:
            return end
        shown = ("export" in mods or exported) if self.ts else "public" in mods
        word = self.t[i].text if self.t[i].kind == "word" else ""
        heads = ("interface", "class", "enum", "namespace", "module") if self.ts else ("interface", "class", "struct", "record", "enum", "namespace")
        if word in heads and self.word(i + 1, end) and not (self.ts and members):
            at = i + 2 if word == "record" and self.is_(i + 1, "class", "struct") and self.word(i + 2, end) else i + 1
            return self.type_(word, first, at, end, mods, parent, shown, symbol_only)
        if self.ts and word == "type" and self.word(i + 1, end) and not members and self.is_(self.angles(i + 2, end), "="):
            last = self.last_of(i + 2, end)
            self.add("type_alias", self.t[i + 1].text, first, last, "", mods, parent, shown)
            return last + 1
        if self.ts and word == "function":
            at = i + 2 if self.is_(i + 1, "*") else i + 1
            if self.word(at, end):
                opening = self.angles(at + 1, end)
                if self.is_(opening, "("):
                    return self.callable_("function", self.t[at].text, first, opening, end, mods, parent, shown, self.t[at].text)
        if members:
            return self.ts_member(first, i, end, mods, parent) if self.ts else self.cs_member(first, i, end, mods, parent, owner, shown, symbol_only)
        if self.ts and word in ("const", "let", "var") and "export" in mods:
            last = self.last_of(i, end)
            self.block(i + 1, last + 1, parent, True)  # what is declared inside counts as exported
            return last + 1
        if self.ts and self.t[i].kind == "word" and word not in _NOT_NAMES and self.is_(i + 1, "(") and self.is_(i - 1 - len(mods), "{", ","):
            closing = self.match.get(i + 1, end)
            if self.is_(closing + 1, "{"):  # a method of an object
                return self.callable_("method", word, first, i + 1, end, mods, parent, False)
        if self.is_(i, "{"):
            self.block(i + 1, min(self.match.get(i, end), end), parent, exported)
            return self.match.get(i, i) + 1
        return i + 1

    def type_(self, word: str, first: int, at: int, end: int, mods: list[str], parent: str | None, shown: bool, symbol_only: bool) -> int:
        """A type or namespace whose name is at ``at``."""
        name, body = self.t[at].text, self.find(at + 1, end, "{", ";")
        last = self.match.get(body, body) if body < end else end - 1
        if word in ("interface", "class", "record"):
            self.add(word, name, first, last, name if word == "class" else "", mods, parent, shown, symbol_only)
        if word in ("namespace", "module"):
            if self.is_(body, "{"):
                self.block(body + 1, last, parent, AS_SYMBOL if shown and self.ts else False)
            return (body if not self.is_(body, "{") else last) + 1  # or of the whole file
        if self.is_(body, "{") and word != "enum" and not (self.ts and word == "interface"):
            inner = name if word == "class" else parent  # only classes are parents
            self.block(body + 1, min(last, end), inner, False, name, True, symbol_only or word == "interface")
        return last + 1

    def body_of(self, closing: int, end: int) -> int:
        """Where the body of a callable starts after its parameters' end, or its semicolon; end if there is neither."""
        k = closing + 1
        if not self.ts:
            return self.find(k, end, "{", ";", "=>")
        if not self.is_(k, ":"):
            return k
        typed = True  # a brace here belongs to the return type
        k += 1
        while k < end:
            if self.is_(k, ";"):
                return k
            if self.is_(k, "{") and not typed:
                return k
            if self.t[k].breaks and not typed and not self.is_(k, *_CONTINUES):
                return end
            typed = self.is_(k, "|", "&", "=>", "is", "keyof", "typeof", "readonly", "extends", "?", ":", ".")
            k = self.angles(k, end) if self.is_(k, "<") else self.match.get(k, k) + 1
        return end

    def callable_(self, kind: str, name: str, first: int, opening: int, end: int, mods: list[str], parent: str | None, shown: bool, before: str = "", returns: str = "", symbol_only: bool = False) -> int:
        """A function or method whose parameters open at ``opening``."""
        closing = self.match.get(opening, end - 1)
        body = self.body_of(closing, end)
        if self.ts and not self.is_(body, "{"):
            return self.last_of(opening, end) + 1  # an overload's signature declares nothing by itself
        if self.is_(body, "=>"):
            last = self.find(body + 1, end, ";")
        else:
            last = self.match.get(body, body) if body < end else end - 1
        params = self.text(opening, closing)
        if kind == "function":
            signature = (before + params + self.text(closing + 1, body - 1)).strip()
        elif kind == "constructor" and not self.ts:
            signature = ""
        else:
            signature = f"{returns} {params}".strip()
        self.add(kind, name, first, last, signature, mods, parent, shown, symbol_only)
        return last + 1

    def ts_member(self, first: int, i: int, end: int, mods: list[str], parent: str | None) -> int:
        if self.is_(i, ";", ",", "}", ")", "]"):
            return i + 1
        if self.t[i].text.startswith("@"):  # a decorator
            return self.match.get(i + 1, i) + 1 if self.is_(i + 1, "(") else i + 1
        if self.is_(i, "*"):
            i += 1
        if self.is_(i, "get", "set", "async") and i + 1 < end and not self.is_(i + 1, "(", "=", ":", ";", "?", "!", "<") and not self.t[i + 1].breaks:
            i += 1
        if self.is_(i, "static") and self.is_(i + 1, "{"):
            return self.match.get(i + 1, i + 1) + 1
        if i >= end or self.is_(i, "{"):
            return self.match.get(i, i) + 1
        past = self.match.get(i, i)  # a computed name has several tokens
        name, at = self.text(i, past), past + 1
        if self.t[i].kind == "punct" and not self.is_(i, "["):
            return i + 1
        if self.is_(at, "?", "!"):
            at += 1
        opening = self.angles(at, end)
        if self.is_(opening, "("):
            return self.callable_("constructor" if name == "constructor" else "method", name, first, opening, end, mods, parent, False)
        if self.is_(i, "[") and self.is_(i + 2, ":"):  # an index signature
            return self.last_of(i, end) + 1
        last = self.last_of(i, end)
        self.add("property", name, first, last, "", mods, parent, False)
        return last + 1

    def cs_member(self, first: int, i: int, end: int, mods: list[str], parent: str | None, owner: str | None, shown: bool, symbol_only: bool) -> int:
        k, name = i, None
        while k < end and not self.is_(k, ";", "{", "=", "=>"):
            if self.is_(k, "(") and name is not None:
                break
            if self.t[k].kind == "word" and not self.is_(k + 1, "."):
                name = k
            k = self.angles(k, end) if self.is_(k, "<") and k > i else self.match.get(k, k) + 1
        words = {t.text for t in self.t[i : min(k, end)] if t.kind == "word"}
        plain = name is not None and self.t[name].text not in _NOT_NAMES and not words & {"operator", "delegate", "event"}
        if self.is_(k, "(") and plain and not self.is_(name - 1, "~"):
            own = self.t[name].text
            constructs = name == i and own == owner
            if name > i or constructs:
                typed = name - 1
                while typed > i + 1 and self.is_(typed, ".") and (self.t[typed - 1].kind == "word" or self.is_(typed - 1, ">")):  # the interface that it is of
                    typed -= 1
                    while self.is_(typed, ">"):
                        depth = 0
                        while typed > i:
                            depth += self.is_(typed, ">") - self.is_(typed, "<")
                            typed -= 1
                            if not depth:
                                break
                    typed -= 1
                return self.callable_("constructor" if constructs else "method", own, first, k, end, mods, parent, shown, "", "" if constructs else self.text(i, typed), symbol_only)
        if self.is_(k, "{", "=>") and plain and name > i and not self.is_(k - 1, "]"):
            last = self.match.get(k, k) if self.is_(k, "{") else self.find(k, end, ";")
            if self.is_(k, "{") and self.is_(last + 1, "="):  # an initial value
                last = self.find(last + 1, end, ";")
            self.add("cs_property", self.t[name].text, first, last, "", mods, parent, shown, symbol_only)
            return last + 1
        if self.is_(k, "("):
            k = self.find(k, end, ";", "{")
        return self.match.get(k, k) + 1 if self.is_(k, "{") else self.find(k, end, ";") + 1


def _declarations(path: str, source: str | None, accessibility: bool = False) -> list[dict]:
    typescript = is_typescript(path)
    if typescript is None:
        return []
    scan = _Scan(path, source or "", typescript, accessibility)
    scan.block(0, len(scan.t), None)
    return scan.rows


#: What a word is, unless a name: looked up once per token.
_WORD_KINDS = {w: w for w in KEYWORDS} | dict.fromkeys(LITERAL_WORDS, "LIT")


def _kind(t: Token) -> str:
    """What a token is, whatever a name, a value or a comment says."""
    if t.kind == "word":
        return _WORD_KINDS.get(t.text, "ID")
    if t.kind == "comment":
        return "comment"
    return "LIT" if t.kind in ("number", "string", "text") else "ID" if t.kind == "name" else t.text


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("\0".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def fingerprints(path: str, source: str | None) -> dict | None:
    """Hashes of a file: lexical_hash of its tokens' texts, token_hash of their
    kinds, ast_hash of the syntax tree, each node's kind and number of children in preorder. White
    space and comments don't count, but a comment is a child of the node that it lies in."""
    typescript = is_typescript(path)
    if typescript is None:
        return None
    every = lex(source or "", typescript, comments=True, markup=is_markup(path))
    tokens = [t for t in every if t.kind != "comment"]
    return {"path": path, "lexical_hash": _hash([t.text for t in tokens]), "token_hash": _hash([_kind(t) for t in tokens]), "ast_hash": _hash([f"{kind}:{n}" for kind, n in tree.preorder(tree.parse(every, _kind))])}


def shape_hash(path: str, source: str, least: int = MIN_TOKENS) -> str | None:
    """Hash of a declaration's syntax tree, names and values as one kind each, comments among them; None with
    under ``least`` leaves and ends of nodes."""
    every = lex(source, bool(is_typescript(path)), comments=True, markup=is_markup(path))
    kinds = tree.bracketed(tree.parse(every, _kind))
    return _hash(kinds) if len(kinds) >= least else None


_ENTITY_KINDS = ("interface", "function", "class", "method", "constructor", "property")


def entities(path: str, source: str | None, accessibility: bool = False) -> list[dict]:
    """Entities of one file. TypeScript: interface, function, class, method,
    constructor, property; C#: interface, class, method, constructor.
    accessibility: record public, private and protected of TypeScript members."""
    left_out = ("exported", "start_column", "end_column", "symbol_only")
    rows = [r for r in _declarations(path, source, accessibility) if r["kind"] in _ENTITY_KINDS and not r["symbol_only"]]
    return [{k: v for k, v in r.items() if k not in left_out} | {"shape_hash": shape_hash(path, r["source"])} for r in rows]


_SYMBOL_KINDS = {"function": "Function", "class": "Class", "interface": "Interface", "type_alias": "TypeAlias"}
_CS_KINDS = {"class": "Class", "interface": "Interface", "record": "Record", "method": "Method", "constructor": "Constructor", "cs_property": "Property"}


def symbols(path: str, source: str | None) -> list[dict]:
    """Symbols of one file in document order; the signature is the whole trimmed
    text, columns count characters from 1. TypeScript has no members and no
    abstract classes among them; C# fields are none, members of interfaces are."""
    kinds = _SYMBOL_KINDS if is_typescript(path) else _CS_KINDS
    rows = [r for r in _declarations(path, source) if r["kind"] in kinds and not (kinds is _SYMBOL_KINDS and "abstract" in r["qualifiers"])]
    return [
        {"file": path, "kind": kinds[r["kind"]], "qualified_name": r["name"], "name": r["name"], "exported": r["exported"], "signature": r["source"].strip(), "start_line": r["start_line"], "start_column": r["start_column"], "end_line": r["end_line"], "end_column": r["end_column"], "ord": i}
        for i, r in enumerate(rows)
    ]


def errors(path: str, source: str | None) -> list[dict]:
    """Brackets of one file that have no partner, each with the text that it was taken to hold; lines and columns from 1."""
    typescript = is_typescript(path)
    if typescript is None:
        return []
    scan = _Scan(path, source or "", typescript, False)
    place = lambda at: (scan.source.count("\n", 0, at) + 1, at - scan.source.rfind("\n", 0, at))
    found = []
    for i, j in sorted(scan.errors):
        start, end = place(scan.t[i].start), place(scan.t[j].start + len(scan.t[j].text))
        found.append({"path": path, "bracket": scan.t[i].text, "start_line": start[0], "start_column": start[1], "end_line": end[0], "end_column": end[1]})
    return found


def _one(path: str, source: str | None) -> list[dict]:
    found = fingerprints(path, source)
    return [found] if found else []


_PARSERS = {"errors": (errors, ERROR), "entities": (entities, ENTITY), "symbols": (symbols, SYMBOL), "fingerprints": (_one, FINGERPRINT)}


def parse_files(files: DataFrame, what: str = "entities") -> DataFrame:
    """Rows of entities(), symbols() or fingerprints() of files (path, source). Path filters belong before this step."""
    f, schema = _PARSERS[what]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for p, s in zip(batch["path"], batch["source"], strict=True) for r in f(p, s)], columns=names)

    store.bound_batches(files.sparkSession)
    return files.select("path", "source").mapInPandas(run, schema)
