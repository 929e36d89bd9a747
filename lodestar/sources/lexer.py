"""Tokens of TypeScript and C# source, for the declaration scanner and the hashes.

Errors never raise: an open string runs to the end of its line, an open comment
or template to the end of the file. Markup in .tsx is read by a stack of modes (code,
tag, text). Where brackets don't balance, the indentation of lines says which
one was left open, so that an error costs its own declaration and no other.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_COMMENT = r"(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))"
_REST = r"(?P<number>\d[\w.]*)|(?P<word>[$@\#]?[^\W\d][\w$]*|\$)|(?P<punct>=>|[^\s\w])|(?P<space>\s+)"
_TS = re.compile(rf"""{_COMMENT}|(?P<string>"(?:\\(?s:.)|[^"\\\n])*(?:"|(?=\n|\Z))|'(?:\\(?s:.)|[^'\\\n])*(?:'|(?=\n|\Z)))|{_REST}""")
_CS = re.compile(
    rf"""{_COMMENT}|(?P<string>\$*"{{3,}}(?s:.*?)(?:"{{3,}}|\Z)|(?:@\$?|\$@)"(?:[^"]|"")*(?:"|\Z)|\$?"(?:\\.|[^"\\\n])*(?:"|(?=\n|\Z))|'(?:\\.|[^'\\\n])*(?:'|(?=\n|\Z)))|{_REST}"""
)
#: A word that starts with a letter, and the space before it on its line.
_PLAIN = re.compile(r"[^\S\n]*([^\W\d][\w$]*)")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: Words after which a slash starts a regular expression.
_BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof")
_DEEPEST = 50


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    line: int
    #: Whether a line break lies between this token and the one before.
    breaks: bool


def _template_end(source: str, i: int, depth: int = 0) -> int:
    """Where the template that starts at i ends, with what its holes hold."""
    i += 1
    while i < len(source):
        if source[i] == "\\":
            i += 2
        elif source[i] == "`":
            return i + 1
        elif source.startswith("${", i) and depth < _DEEPEST:
            i, braces = i + 2, 1
            while i < len(source) and braces:
                m = _TS.match(source, i)
                if source[i] == "`":
                    i = _template_end(source, i, depth + 1)
                    continue
                braces += (source[i] == "{") - (source[i] == "}")
                i = m.end() if m else i + 1
        else:
            i += 1
    return len(source)


#: Where an element or fragment may start, if an expression can: no type parameters of an arrow function.
_ELEMENT = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=\s*/?>|\s+[\w{/])(?!\s+extends\b))")
_TAG = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<string>"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|(?P<markup>/?>|=)|(?P<name>[\w$.:-]+)""")
_TEXT = re.compile(r"(?P<text>[^<{]+)")


def _starts_expression(last: Token | None) -> bool:
    return last is None or last.text in _BEFORE_REGEX or last.kind == "text" or (last.kind == "punct" and last.text not in ")]}")


def lex(source: str, typescript: bool = True, comments: bool = False, markup: bool = False) -> list[Token]:
    """Tokens; kinds: word, number, string (templates and regular expressions too), punct and, with
    comments, comment. markup: elements in expressions too, with the kinds markup (their signs),
    name (of tags and attributes) and text; what stands in their braces is code."""
    pattern, found, line, i, breaks, last = _TS if typescript else _CS, [], 1, 0, False, None
    modes = ["code"]  # code, or tag (of an opening or a closing tag), or text; each with what it lies in below it
    depth = [0]  # open braces of each code mode
    while i < len(source):
        mode = modes[-1]
        if mode == "code" and (m := _PLAIN.match(source, i)):  # most of a file
            last = Token("word", m[1], m.start(1), line, breaks)
            found.append(last)
            i, breaks = m.end(), False
            continue
        m, c = None, source[i]
        if mode == "text":
            m = _TEXT.match(source, i)
            if m is None and c == "{":
                kind, end = "punct", i + 1
                modes.append("code")
                depth.append(0)
            elif m is None:
                closing = source.startswith("</", i)
                kind, end = "markup", i + 1 + closing
                modes.append("closing" if closing else "tag")
            else:
                kind, end = ("text" if m[0].strip() else "space"), m.end()
        elif mode in ("tag", "closing"):
            m = _TAG.match(source, i)
            kind, end = (m.lastgroup, m.end()) if m else ("punct", i + 1)
            if c == "{":
                modes.append("code")
                depth.append(0)
            elif kind == "markup" and m[0] != "=":
                modes.pop()
                if mode == "closing":
                    if len(modes) > 1:
                        modes.pop()  # the text of the element
                elif m[0] == ">":
                    modes.append("text")
        elif typescript and c == "`":
            kind, end = "string", _template_end(source, i)
        elif typescript and c == "/" and _starts_expression(last) and (m := _REGEX.match(source, i)):
            kind, end = "string", m.end()
        elif markup and c == "<" and _starts_expression(last) and (m := _ELEMENT.match(source, i)) and (m[0] == "<>" or f"</{m[0][1:]}" in source[i:] or "/>" in source[i:]):
            kind, end = "markup", i + 1
            modes.append("tag")
        else:
            m = pattern.match(source, i)
            kind, end = (m.lastgroup, m.end()) if m else ("space", i + 1)
            if kind == "punct" and len(modes) > 1:
                depth[-1] += (c == "{") - (c == "}")
                if depth[-1] < 0:  # the end of a hole
                    modes.pop()
                    depth.pop()
        text = source[i:end]
        if kind not in ("space", "comment"):
            last = Token(kind, text, i, line, breaks)
            found.append(last)
        elif kind == "comment" and comments:
            found.append(Token(kind, text, i, line, breaks))
        lines = text.count("\n")
        breaks = (breaks or bool(lines)) if kind in ("space", "comment") else False
        line += lines
        i = end
    return found


_PAIRS = {"(": ")", "[": "]", "{": "}"}


#: A line that starts with one of these goes on with what is open.
_GOES_ON = ("else", "catch", "finally", "while", "where", "extends", "implements", "&&", "||")


def matching(tokens: list[Token], source: str | None = None, errors: list[tuple[int, int]] | None = None) -> dict[int, int]:
    """The index of each bracket's partner; an open one ends with the file. With source, brackets that don't
    balance are matched by the indentation of lines; errors gets (bracket, last token) of each left open."""
    found, stack, wrong = {}, [], False
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in _PAIRS:
            stack.append(i)
        elif t.text in _PAIRS.values():
            wrong = wrong or not stack or _PAIRS[tokens[stack[-1]].text] != t.text
            for k in range(len(stack) - 1, -1, -1):
                if _PAIRS[tokens[stack[k]].text] == t.text:
                    found[stack[k]] = i
                    del stack[k:]
                    break
    if source is not None and (stack or wrong):
        return _matching_by_lines(tokens, source, [] if errors is None else errors)
    found.update({i: len(tokens) - 1 for i in stack})
    return found


def _matching_by_lines(tokens: list[Token], source: str, errors: list[tuple[int, int]]) -> dict[int, int]:
    """As matching(), for a file with errors: a line that starts no deeper than the line of an open bracket
    ends it, unless it starts with the bracket's partner or goes on with it."""
    found: dict[int, int] = {}
    stack: list[tuple[int, int]] = []  # bracket, indentation of its line

    def leave(k: int, last: int) -> None:
        for i, _ in stack[k:]:
            found[i] = last
            errors.append((i, last))
        del stack[k:]

    indent = 0
    for i, t in enumerate(tokens):
        start = i == 0 or t.breaks
        if start:
            own = source[source.rfind("\n", 0, t.start) + 1 : t.start].expandtabs(4)
            indent = len(own) if not own.strip() else indent
        closer = t.kind == "punct" and t.text in _PAIRS.values()
        if start and not closer and t.kind in ("word", "punct") and t.text not in _GOES_ON and t.text not in ("{", ".", "?", ":", "&", "|", "=>", "+", "-"):
            k = len(stack)
            while k and stack[k - 1][1] >= indent:
                k -= 1
            leave(k, i - 1)
        if t.kind == "punct" and t.text in _PAIRS:
            stack.append((i, indent))
        elif closer:
            fits = [k for k in range(len(stack)) if _PAIRS[tokens[stack[k][0]].text] == t.text]
            if start:
                fits = [k for k in fits if stack[k][1] <= indent] if any(stack[k][1] == indent for k in fits) else fits
            if fits:
                leave(fits[-1] + 1, i - 1)
                found[stack.pop()[0]] = i
            else:
                errors.append((i, i))
    leave(0, len(tokens) - 1)
    return found
