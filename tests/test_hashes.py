"""Hashes of texts by the scan in Arrow batches, against the column expressions."""

import random

from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.plans import adapters
from lodestar.sources import hashes

#: Pieces of odd texts: separators, numbers that aren't digits, letters of late Unicode versions, other planes.
PIECES = [
    "a", "if", "true", "null", "_x1", "$", "é", "ß", "中", "²", "½", "Ⅷ", "٣", "7", "1.5e3", "0x_F", "//", "/*", "*/", "/", "\n", "\r", " ", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x01", "\x00", "\x85", "\xa0", "\u1680",
    "\u180e", "\u200b", "\u2028", "\u3000", "\ufeff", "'", '"', "`", "\\", "\\'", "=>", "=", ">", "#", "e\u0301", "\u0560", "\ua7b8", "\u1c90", "😀", "🪿", "𝒳", "𠀀", "𞤀", "\U0001fbf0", "\U0002ebf0", "\u31bb", "\ufffd",
]


def _expressions(texts):
    every = texts.select("id", text.tokens(F.col("source")).alias("every"))
    return every.select("id", *(c.alias(k) for k, c in text.token_hashes(F.col("every")).items()))


def test_same_as_expressions(spark):
    rng = random.Random(7)
    odd = ["", " ", "\n", None, *PIECES, "a //", "a // b\n// c\nd /* e", "'//' /* \x01 */ '\\\x01'", "LIT ID comment # 0", "x" * 100 + " " + "'" + "y" * 100 + "'"]
    odd += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts = spark.createDataFrame(list(enumerate(odd)), "id long, source string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = rows(hashes.token_hashes(texts))
    assert found == rows(_expressions(texts)) and len(found) == len(odd)
    broken = texts.limit(20).select("id", F.expr("cast(concat(cast('a b ' as binary), x'ff41c3', cast(source as binary)) as string)").alias("source"))  # not UTF-8
    assert rows(hashes.token_hashes(broken)) == rows(_expressions(broken))


def test_kinds_are_forgotten(spark, monkeypatch):
    """A task remembers a bounded number of tokens, and no long ones."""
    monkeypatch.setattr(hashes, "KNOWN", len(text.KEYWORDS) + len(text.LITERAL_WORDS) + 2)
    kinds = hashes._Kinds()
    assert [kinds[t] for t in ("a", "b", "c", "d", "if", "true", "1", "'x'", "'", "x" * 100)] == ["ID"] * 4 + ["if", "LIT", "LIT", "LIT", "'", "ID"]
    assert len(kinds) <= hashes.KNOWN and "x" * 100 not in kinds


def test_no_lambda_for_plain_texts(spark):
    """The views hash texts in Arrow batches, and a text of plain characters isn't sent to the interpreted lambdas."""
    files = spark.createDataFrame([("a", "if (x) { return 'é' } // 😀")], "path string, source string")
    plan = adapters.hashed(files)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    scan = hashes._scanner(*hashes.patterns())
    assert scan("é 😀 word".encode()) and scan("𝒳".encode()) is None and scan(b"\xff") is None
