"""A syntax tree of statements and expressions, by precedence climbing over tokens.

One small grammar serves both languages and takes any input: a statement is a run
of expressions and blocks up to its end, a declaration too. Operators bind by
their precedence; calls, members and subscripts follow their operand. A node is
(kind, children), a leaf (kind, None); comments are leaves of the node that
they lie in. Beyond DEEPEST nested nodes tokens are kept flat.
"""

from __future__ import annotations

from collections.abc import Callable

from lodestar.sources.lexer import Token, matching

DEEPEST = 120
#: Binary operators by precedence; assignments and the ternary bind to the right.
_LEVELS = ("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= =>", "?", "??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in is as satisfies", "<< >> >>>", "+ -", "* / %", "**")
PRECEDENCE = {op: level for level, ops in enumerate(_LEVELS, 1) for op in ops.split()}
RIGHT = (1, 2, 14)
PREFIX = frozenset("+ - ! ~ ++ -- ... typeof void delete await new yield throw return keyof".split())
_SIGNS = PREFIX | PRECEDENCE.keys()
#: Of these, what takes a whole expression.
WIDE = ("return", "throw", "yield")
CLOSERS = (")", "]", "}")
_HEADED = frozenset("if for foreach while switch catch using lock fixed with".split())
_BARE = frozenset("else try finally do unsafe".split())
_GROUPS = {"(": "group", "[": "list", "{": "object"}
_LONGEST = 4


def parse(tokens: list[Token], kind: Callable[[Token], str]) -> tuple:
    """The tree of tokens (comments among them); kind: the name of a token's leaf."""
    return _Parser(tokens, kind).file()


class _Parser:
    def __init__(self, tokens: list[Token], kind: Callable[[Token], str]):
        self.t, self.kind, self.match, self.i, self.depth = tokens, kind, matching(tokens), 0, 0

    def file(self) -> tuple:
        return ("file", self.statements(len(self.t)))

    def operator(self, end: int) -> str:
        """The operator at i, of signs that touch; empty if there is none."""
        if self.i < end and (t := self.t[self.i]).kind == "word":
            return t.text if t.text in _SIGNS else ""
        found, text = "", ""
        for k in range(self.i, min(end, self.i + _LONGEST)):
            t = self.t[k]
            if t.kind != "punct" or (k > self.i and t.start != self.t[k - 1].start + len(self.t[k - 1].text)):
                break
            text += t.text
            if text in _SIGNS:
                found = text
        return found

    def take(self, text: str) -> tuple:
        """The operator's tokens as one leaf."""
        start = self.i
        while self.i < len(self.t) and sum(len(t.text) for t in self.t[start : self.i]) < len(text):
            self.i += 1
        return (text, None)

    def leaf(self) -> tuple:
        self.i += 1
        return (self.kind(self.t[self.i - 1]), None)

    def statements(self, end: int) -> list[tuple]:
        found = []
        while self.i < end:
            t = self.t[self.i]
            if t.kind == "comment" or (t.kind == "punct" and t.text == ";"):
                found.append(self.leaf())
            else:
                found.append(self.statement(end))
        return found

    def statement(self, end: int) -> tuple:
        first, parts = self.t[self.i], []
        name = "declaration"
        if first.kind == "word" and (first.text in _HEADED or first.text in _BARE):
            name = first.text
            parts.append(self.leaf())
            if name in _HEADED and self.i < end and self.t[self.i].text == "(":
                parts.append(self.group("head"))
            if self.i < end and self.t[self.i].text not in (";", "{"):
                return (name, [*parts, self.nested(self.statement, end)])
        elif first.kind == "word" and first.text in PREFIX:
            name = first.text
        while self.i < end:
            t = self.t[self.i]
            if t.kind == "punct" and t.text == ";":
                parts.append(self.leaf())
                break
            if t.kind == "punct" and t.text in CLOSERS:  # it has no partner
                parts.append(self.leaf())
                continue
            if t.kind == "punct" and t.text == "{":
                parts.append(self.group("block"))
                break
            if parts and t.breaks and name == "declaration" and len(parts) == 1 and parts[0][1] is not None:
                break  # an expression that ends with its line
            if t.kind == "word" and self.i + 1 < end and self.depth < DEEPEST and t.text not in _SIGNS:
                after = self.t[self.i + 1]
                if after.kind == "word" and after.text not in _SIGNS:  # an expression of one word
                    parts.append(self.leaf())
                    continue
            parts.append(self.leaf() if t.kind == "comment" else self.nested(self.expression, end))
        return (name if len(parts) != 1 or parts[0][1] is None else "expression", parts)

    def nested(self, f: Callable, *args) -> tuple:
        """f, or one flat node up to the end of the deepest bracket's content."""
        if self.depth >= DEEPEST:
            end = args[0]
            return ("flat", [self.leaf() for _ in range(self.i, end)])
        self.depth += 1
        found = f(*args)
        self.depth -= 1
        return found

    def group(self, name: str) -> tuple:
        """A bracket's content: statements in a block, expressions elsewhere."""
        close = self.match.get(self.i, len(self.t) - 1)
        parts = [self.leaf()]
        if name == "block":
            parts += self.nested(lambda end: ("", self.statements(end)), close)[1]
        else:
            while self.i < close:
                t = self.t[self.i]
                parts.append(self.leaf() if t.kind == "comment" or (t.kind == "punct" and t.text in (",", ";", ":", *CLOSERS)) else self.nested(self.expression, close))
        if self.i < len(self.t) and self.i == close and self.t[close].text in ")]}":
            parts.append(self.leaf())
        return (name, parts)

    def expression(self, end: int, least: int = 1) -> tuple:
        left = self.operand(end)
        while self.i < end:
            op = self.operator(end)
            level = PRECEDENCE.get(op, 0)
            if level < least or not level:
                return left
            if op == "=>" and self.i + 1 < end and self.t[self.i + 1].text == "{":
                left = ("lambda", [left, self.take(op), self.group("block")])
                continue
            sign = self.take(op)
            if self.i >= end:
                return ("open", [left, sign])
            right = self.nested(self.expression, end, level if level in RIGHT else level + 1)
            parts = [left, sign, right]
            if op == "?" and self.i < end and self.t[self.i].text == ":":
                parts += [self.leaf(), self.nested(self.expression, end, level)] if self.i + 1 < end else [self.leaf()]
            left = ("ternary" if op == "?" else "assignment" if level == 1 and op != "=>" else "lambda" if op == "=>" else "binary", parts)
        return left

    def operand(self, end: int) -> tuple:
        op = self.operator(end)
        if op in PREFIX:
            sign = self.take(op)
            if self.i >= end or self.t[self.i].text in (";", ",", *CLOSERS) or (op.isalpha() and op not in WIDE and self.t[self.i].text == "{"):
                return sign
            return ("unary", [sign, self.nested(self.expression if op in WIDE else self.operand, end)])
        t = self.t[self.i]
        if t.kind == "punct" and t.text in (";", *CLOSERS):
            return ("missing", None)
        if t.kind == "punct" and t.text in _GROUPS:
            left = self.group(_GROUPS[t.text])
        else:
            left = self.leaf()
        while self.i < end:
            t = self.t[self.i]
            if t.kind == "punct" and t.text in ("(", "[") and not (t.breaks and t.text == "("):
                left = ("call" if t.text == "(" else "subscript", [left, self.group("arguments")])
            elif t.kind == "punct" and t.text == "." and self.i + 1 < end:
                left = ("member", [left, self.leaf(), self.leaf()])
            elif t.kind == "punct" and t.text in "+-" and self.operator(end) in ("++", "--"):
                left = ("postfix", [left, self.take(self.operator(end))])
            else:
                break
        return left


def preorder(tree: tuple) -> list[tuple[str, int]]:
    """(kind, number of children) of each node but comments, which their parents count."""
    found, stack = [], [tree]
    while stack:
        kind, children = stack.pop()
        if kind == "comment":
            continue
        if children:
            found.append((kind, len(children)))
            stack += reversed(children)
        else:
            found.append((kind, 0))
    return found


def bracketed(tree: tuple) -> list[str]:
    """Leaves by kind, and <kind> and </kind> around what inner nodes hold."""
    found: list[str] = []
    stack: list[tuple | str] = [tree]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            found.append(at)
        elif at[1] is None:
            found.append(at[0])
        else:
            found.append(f"<{at[0]}>")
            stack.append(f"</{at[0]}>")
            stack += reversed(at[1])
    return found
