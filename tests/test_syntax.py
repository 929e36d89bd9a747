"""The scanner's markup mode, its recovery from errors, and the syntax tree."""

import ast
import random

import pytest

from lodestar.plans import samples
from lodestar.sources import parse, tree
from lodestar.sources.lexer import lex


def names(path, source):
    return [(r["kind"], r["name"]) for r in parse.symbols(path, source)]


MARKUP = [
    "return <p>it's</p>", "return <a>a // b</a>", "return <a>/* no comment</a>", "return <>`{x}</>", "return x ? <b/> : null",
    "const f = <T,>(x: T) => x; return f(1)", "return <A.B c='d' {...e} onClick={() => { g({h: 1}) }}>{i.map(j => <li key={j}>{j}'s</li>)} \"k</A.B>",
    "return a < b && c > d", "return <div>\n  <function class=\"x\" type='y'/>\n  export class No {'{'} and don't\n</div>",
]


@pytest.mark.parametrize("body", MARKUP)
def test_markup(body):
    source = f"export function A() {{\n  {body}\n}}\nexport class Last {{ m() {{ return 1 }} }}\n"
    assert names("a.tsx", source) == [("Function", "A"), ("Class", "Last")]
    assert not parse.errors("a.tsx", source)


TS = ["export function f{0}(a: number) {{\n  if (a) {{\n    g(a);\n  }}\n  return [1, 2];\n}}", "export class f{0} {{\n  m(): void {{\n    x();\n  }}\n}}", "interface f{0} {{\n  a: string;\n}}"]
CS = ["  public class f{0} {{\n    public int M(int x) {{\n      return (x);\n    }}\n  }}", "  public interface f{0} {{\n    void M();\n  }}"]


@pytest.mark.parametrize("ending, templates, around", [("ts", TS, "{}"), ("cs", CS, "namespace N {{\n{}\n}}\n")])
def test_an_error_costs_its_own_declaration(ending, templates, around):
    """A bracket taken out anywhere leaves all other declarations, and is reported."""
    whole = [templates[i % len(templates)].format(i) for i in range(6)]
    want = {r["name"] for r in parse.entities(f"a.{ending}", around.format("\n\n".join(whole))) if r["name"].startswith("f")}
    assert len(want) == 6
    for i, text in enumerate(whole):
        for at, sign in enumerate(text):
            if sign not in "(){}[]":
                continue
            source = around.format("\n\n".join([*whole[:i], text[:at] + text[at + 1 :], *whole[i + 1 :]]))
            found = {r["name"] for r in parse.entities(f"a.{ending}", source)}
            assert want - {f"f{i}"} <= found, (i, at)
            assert parse.errors(f"a.{ending}", source)


def test_errors_in_every_declaration():
    source = "export function a( {\n  return 1;\n}\nexport function b() {\n  if (x {\n    y([1);\n}\nexport class C {\n  m() {\n  n() { return 1 }\n}\nexport function d() { return 1 }\n"
    assert [n for _, n in names("a.ts", source)] == ["b", "C", "d"]
    assert {(r["start_line"], r["bracket"]) for r in parse.errors("a.ts", source)} >= {(1, "("), (5, "("), (6, "[")}


def test_balanced_files_have_no_errors():
    flat = "namespace N {\nexport class A {\nm() {\nif (x)\n{\ny()\n}\n}\n}\n}\n"  # whatever their indentation
    assert not parse.errors("a.ts", flat) and not parse.errors("a.ts", samples.TS) and not parse.errors("a.cs", samples.CS)
    assert not parse.errors("a.txt", "((((") and not parse.errors("a.ts", None)


def show(node):
    return node[0] if node[1] is None else f"{node[0]}({' '.join(map(show, node[1]))})"


def read(source):
    return tree.parse(lex(source, comments=True), parse._kind)


@pytest.mark.parametrize("source, want", [
    ("a = b = c + d * e;", "declaration(assignment(ID = assignment(ID = binary(ID + binary(ID * ID)))) ;)"),
    ("x ? y : z ? v : w", "expression(ternary(ID ? ID : ternary(ID ? ID : ID)))"),
    ("if (a) { return b + 1 } else x()", "if(if head(( ID )) block({ expression(unary(return binary(ID + LIT))) })) else(else expression(call(ID arguments(( )))))"),
    ("f(a /* c */, [1])[0].b", "expression(member(subscript(call(ID arguments(( ID comment , list([ LIT ]) ))) arguments([ LIT ])) . ID))"),
    ("g = (a, b) => { h(); }", "expression(assignment(ID = lambda(group(( ID , ID )) => block({ declaration(call(ID arguments(( ))) ;) }))))"),
    ("a = ; )", "declaration(assignment(ID = missing) ;) declaration())"),
])
def test_tree(source, want):
    assert show(read(source)) == f"file({want})"


def by_python(node):
    if isinstance(node, ast.BinOp):
        return f"binary({by_python(node.left)} {SIGNS[type(node.op)]} {by_python(node.right)})"
    return f"group(( {by_python(node.inner)} ))" if isinstance(node, Group) else "ID"


class Group(ast.expr):
    pass


SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Pow: "**", ast.LShift: "<<", ast.RShift: ">>", ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^"}


def test_precedence_against_another_parser():
    """Operators on which both languages' orders agree."""
    rng = random.Random(5)
    for _ in range(500):
        source = "a" + "".join(f" {rng.choice(list(SIGNS.values()))} b" for _ in range(rng.randrange(1, 12)))
        assert show(read(source)) == f"file(expression({by_python(ast.parse(source, mode='eval').body)}))", source


def test_hashes_by_structure():
    same = ["export function f(a) { return a + b * 2 /* x */ }", "export function g(c) {\n return c + d * 3 /* another */\n}"]
    a, b = (parse.fingerprints("a.ts", s) for s in same)
    assert a["ast_hash"] == b["ast_hash"] and a["token_hash"] == b["token_hash"] and a["lexical_hash"] != b["lexical_hash"]
    swapped = parse.fingerprints("a.ts", same[0].replace("a + b * 2", "a * b + 2"))
    assert swapped["ast_hash"] != a["ast_hash"]
    fewer = parse.fingerprints("a.ts", same[0].replace("/* x */", ""))
    assert fewer["ast_hash"] != a["ast_hash"] and fewer["token_hash"] == a["token_hash"]  # a comment counts as a child
    assert parse.shape_hash("a.ts", same[0]) == parse.shape_hash("a.ts", same[1]) and parse.shape_hash("a.ts", "f") is None


def test_any_text_has_a_tree():
    rng = random.Random(6)
    for _ in range(300):
        source = "".join(rng.choice(["a", "b ", "(", ")", "{", "}", "[", "]", ";", "\n", "+", "=", "=>", "?", ":", ".", "<", ">", "if ", "return ", "//x\n", "'", "`", ",", "new "]) for _ in range(rng.randrange(80)))
        for path in ("a.ts", "a.tsx", "a.cs"):
            assert parse.fingerprints(path, source) and parse.errors(path, source) is not None
            parse.entities(path, source)
    deep = "(" * 3000 + "a" + ")" * 3000 + "{" * 3000
    assert parse.fingerprints("a.ts", deep)["ast_hash"]
    leaves = [k for k, n in tree.preorder(read("f(x); g(y)")) if n == 0]
    assert leaves == ["ID", "(", "ID", ")", ";", "ID", "(", "ID", ")"]


def test_queries_over_whole_texts(spark):
    """Files hold whole documents; errors are there just where a file's brackets don't balance."""
    d = "/root/testdata/sf0.001"
    found = {r["path"] for r in samples.parse_errors(spark, d).collect()}
    hashes = {r["path"]: r for r in samples.syntax_hashes(spark, d).collect()}
    assert hashes.keys() == {r["path"] for r in samples._texts(spark, d).collect()} and len(found) > 20
    for r in samples._cut(spark, d).collect():
        typescript, open_ = not r["path"].endswith(".cs"), []
        balanced = True
        for t in lex(r["source"] or "", typescript, markup=r["path"].endswith("x")):
            if t.kind == "punct" and t.text in "([{":
                open_.append(t.text)
            elif t.kind == "punct" and t.text in ")]}":
                balanced = bool(open_) and {"(": ")", "[": "]", "{": "}"}[open_.pop()] == t.text and balanced
        assert (r["path"] in found) == (not balanced or bool(open_))


def test_words_of_prose_need_no_operator_search(monkeypatch):
    """Most of a large file is plain words: a few steps for each, and the tree is what the general path makes."""
    calls, operator = [], tree._Parser.operator

    def counting(self, end):
        calls.append(end)
        return operator(self, end)

    monkeypatch.setattr(tree._Parser, "operator", counting)
    source = "some plain words " * 400
    found = parse.fingerprints("a.ts", source)
    assert len(calls) < 50
    monkeypatch.setattr(tree, "_SIGNS", tree._SIGNS | {"plain"})  # takes the general path around that word
    assert parse.fingerprints("a.ts", source) == found and len(calls) > 400
