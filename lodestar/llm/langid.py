"""Language identification by rank-order profiles (operator 9).

A text is lower-cased, every run of characters that are not letters becomes one
space, and its character n-grams of lengths 1 to 3 are counted. A profile is
the PROFILE most frequent n-grams in order of count (ties: by code points). A
document's language is the one whose profile has the smallest out-of-place
distance: the sum over the document's n-grams of the difference in rank, or
PROFILE where the language lacks the n-gram. Ties go to the smaller name.

Training counts are summed per Arrow batch, then per language with map-side
aggregation; every training text counts whole. What is sent to the tasks is the
profiles: PROFILE n-grams of 8 bytes for each language.

Edge cases: null text, or text without a letter: `und`, score 0; no training
rows: `und` throughout; null lang never trains; null doc_id counts as the empty
text in the split; an empty table gives an empty table; repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PROFILE = 300
#: Code points of one text that are counted at once; a longer one is counted in parts and summed.
PART = 1 << 20

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_codes(text: str) -> np.ndarray:
    """n-grams of a text as integers, 21 bits a character; without letters: none."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of other characters
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    two = (codes[:-1] << 21) | codes[1:]
    return np.concatenate([codes[codes != 32], two, (two[:-1] << 21) | codes[2:]])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(gram_codes(text), return_counts=True)


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, in order of rank."""
    grams, counts = counted(text)
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        above = counts >= least  # ties at the end are cut by code points below
        grams, counts = grams[above], counts[above]
    return grams[np.argsort(-counts, kind="stable")][:size]


def count_training(rows: DataFrame) -> DataFrame:
    """lang, gram, n of rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, 1)):
            parts = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    parts[lang].append(gram_codes(text))
            for lang, found in parts.items():
                grams, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    return common.texts(rows, ids=("lang",)).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(rows: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language in rows (lang, text)."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = count_training(rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found: dict = defaultdict(list)
    for row in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):  # size rows a language
        found[row["lang"]].append(row["gram"])
    return {k: np.array(v, np.int64) for k, v in found.items()}


def predict(docs: DataFrame, model: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score (1 less the distance as a share of the largest), distance."""
    names = sorted(model)
    grams = np.unique(np.concatenate([model[k] for k in names])) if names else np.empty(0, np.int64)
    ranks = np.full((len(names), len(grams) + 1), -1, np.int64)
    for i, k in enumerate(names):
        ranks[i, np.searchsorted(grams, model[k])] = np.arange(len(model[k]))
    sent = docs.sparkSession.sparkContext.broadcast((names, grams, ranks))

    def one(text: str | None) -> tuple[str, float, int | None]:
        names, grams, ranks = sent.value
        own = ranked(text, size) if text and names else ()
        if not len(own):
            return "und", 0.0, None
        at = np.searchsorted(grams, own)
        at[(at >= len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != own)] = len(grams)
        theirs = ranks[:, at]
        far = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(far.argmin())
        return names[best], 1 - float(far[best]) / (size * len(own)), int(far[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.int64()), strict=True))], names=["doc_id", "lang_pred", "score", "distance"])

    return common.texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, distance long")


def held_out(doc_id, divisor: int, remainder: int):
    """Whether crc32 of doc_id as text has the remainder; null: the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = profiles(docs.where(~held_out("doc_id", 3, 1) & F.col("lang").isNotNull()))
    found = predict(docs, model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "distance")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, xor(list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE ascii(x) END::BIGINT),
  lambda c, b: CASE WHEN b = 0 THEN c ELSE list_reduce(range(0, 8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)) END, 4294967295::BIGINT), 4294967295) % 3 = 1 AS held_out FROM documents),
n AS (SELECT rid, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'), ' ') || ' ' AS s FROM d),
g AS (SELECT rid, unnest(flatten([list_transform(range(1, length(s) - k + 2), lambda i: substr(s, i, k)) for k in [1, 2, 3]])) AS gram FROM n WHERE length(s) > 2),
c AS (SELECT rid, gram, count(*) AS c FROM g WHERE gram <> ' ' GROUP BY ALL),
own AS (SELECT rid, gram, row_number() OVER (PARTITION BY rid ORDER BY c DESC, length(gram), gram) - 1 AS rank FROM c QUALIFY rank < 300),
p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, length(gram), gram) - 1 AS rank FROM c JOIN d USING (rid) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank < 300),
f AS (SELECT o.rid, l.lang, sum(coalesce(abs(p.rank - o.rank), 300)) AS far, count(*) AS size FROM own o CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = o.gram GROUP BY o.rid, l.lang),
b AS (SELECT rid, lang, far, size FROM f QUALIFY row_number() OVER (PARTITION BY rid ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - far::DOUBLE / (300 * size)::DOUBLE, 0.0::DOUBLE) AS score, far::BIGINT AS distance FROM d LEFT JOIN b USING (rid)
"""
