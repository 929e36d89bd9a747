"""The three hashes of source texts, by a scan over whole texts in Arrow batches.

The same as text.token_hashes(text.tokens()), whose lambdas are interpreted for every
token. Letters and numbers are told apart by Python's tables here and by the JVM's
there, which may be of other Unicode versions: a text with a character that has
changed its kind since the oldest table, or lies beyond the first plane but for pictographs,
is left to those expressions, and so is one that isn't UTF-8.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.sources.store import bound_batches

HASHES = ("lexical_hash", "token_hash", "ast_hash")
#: Tokens whose kind a task remembers, and characters of the longest of them.
KNOWN, LONGEST = 1 << 17, 64
#: Beyond the first plane: all but pictographs, among which are no letters or numbers.
_FAR = "\\U00010000-\\U0001f2ff\\U0001fb00-\\U0010ffff"


def _ranges(codes: list[int]) -> str:
    """The body of a character class."""
    found: list[list[int]] = []
    for c in codes:
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in found)


@functools.cache
def patterns() -> tuple[str, str]:
    """text.TOKEN for Python, and the characters of which another table may know better."""
    kinds: dict[str, list[int]] = {"L": [], "N": []}
    unsure = []
    for i in range(1 << 16):
        now, once = (table.category(chr(i))[0] for table in (unicodedata, unicodedata.ucd_3_2_0))
        if now in kinds:
            kinds[now].append(i)
        if now != once and (now in kinds or once in kinds):
            unsure.append(i)
    token = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", text.TOKEN)
    for java, own in ((r"\s", r" \t\n\f\r"), (r"\z", r"\Z"), *((rf"\p{{{k}}}", _ranges(v)) for k, v in kinds.items())):
        token = token.replace(java, own)
    return token, f"[{_ranges(unsure)}{_FAR}]"


class _Kinds(dict):
    """What text.kind() says of tokens other than comments."""

    def __init__(self):
        super().__init__({w: w for w in text.KEYWORDS} | dict.fromkeys(text.LITERAL_WORDS, "LIT"))

    def __missing__(self, token: str) -> str:
        first = token[0]
        if first in "0123456789" or (first in "\"'`" and len(token) > 1):
            kind = "LIT"
        else:
            kind = "ID" if first in "_$" or first.isalpha() else token
        if len(token) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
                self.__init__()
            self[token] = kind
        return kind


def _scanner(token: str, unsure: str):
    """A function of a text in bytes: its hashes; None for one that is left to the JVM."""
    tokens, other, kind = re.compile(token).findall, re.compile(unsure).search, _Kinds().__getitem__
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def scan(data: bytes) -> tuple[str, str, str] | None:
        try:
            source = data.decode()
        except UnicodeDecodeError:
            return None
        if not source.isascii() and other(source):
            return None
        code = every = tokens(source)
        if "//" in source or "/*" in source:
            code = [t for t in every if not t.startswith(("//", "/*"))]
        kinds = text.JOIN.join(map(kind, code))
        return sha(text.JOIN.join(code)), sha(kinds), sha(f"{kinds}#{len(every) - len(code)}")

    return scan


def token_hashes(texts: DataFrame, source: str = "source") -> DataFrame:
    """texts with HASHES in place of the column source; null where that is."""
    bound_batches(texts.sparkSession)
    kept, both = [c for c in texts.columns if c != source], patterns()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*kept).schema] + [f"{h} string" for h in HASHES] + ["_rest string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(*both)
        for batch in batches:
            own = batch.column(source)
            found = [None if b is None else scan(b) for b in own.cast(pa.binary()).to_pylist()]
            hashes = [pa.array([f and f[i] for f in found], pa.string()) for i in range(len(HASHES))]
            rest = pc.if_else(pa.array([f is None for f in found], pa.bool_()), own, pa.scalar(None, own.type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *hashes, rest], [*kept, *HASHES, "_rest"])

    found = texts.select(*kept, source).mapInArrow(work, schema)
    exact = text.token_hashes(text.tokens(F.col("_rest")))
    return found.select(*kept, *(F.coalesce(h, exact[h]).alias(h) for h in HASHES))
