"""Fill-in-the-middle transformation (operator 11).

Texts are cut into units: a run of white space with the word after it, or
white space that ends a text. A whole Arrow batch is handled at once on the
bytes of its texts: a table gives each byte's class, a unit starts at a text's
first byte and wherever a white-space byte follows another one, running sums that start
anew in each text count units and characters, and a binary search finds all
rows' cuts together. Prefix, middle and suffix lie side by side in the batch's
own buffer, so the three columns are views of it with other offsets.

Edge cases: a null text counts as empty and is plain; a text that holds a marker is
plain; a null doc_id draws its numbers from the empty text and passes through; repeated rows give
repeated rows; very long texts pass whole; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are transformed; of 100 transformed ones, how many have the suffix first.
RATE, SPM_RATE = 50, 80
#: Class 1: white space between words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[ord(c) for c in common.SPACE_CHARS]] = True
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut(texts: pa.StringArray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units of each text, byte cuts, characters between cuts) of texts without nulls. Cuts has a row
    (start, end of the prefix, end of the middle, end) for each text, in bytes of the batch's buffer;
    the prefix has first % (units + 1) units, or second % (units + 1) if that is fewer."""
    offsets = _offsets(texts)
    low, high = offsets[0], offsets[-1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:high]
    bounds = offsets - low
    space = IS_SPACE[data]
    start = np.empty(len(data), bool)
    start[1:] = space[1:] & ~space[:-1]
    start[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    at = np.flatnonzero(start)
    before = np.searchsorted(at, bounds)  # units of all texts before each
    n = np.diff(before)
    a, b = first % (n + 1), second % (n + 1)
    ends = np.append(at, len(data))

    def byte(k: np.ndarray) -> np.ndarray:
        return np.where(k == n, bounds[1:], ends[np.minimum(before[:-1] + k, len(at))])

    cuts = np.stack([bounds[:-1], byte(np.minimum(a, b)), byte(np.maximum(a, b)), bounds[1:]], axis=1)
    chars = np.concatenate([[0], np.cumsum(STARTS_CHAR[data])])
    return n, cuts + low, np.diff(chars[cuts], axis=1)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def parts(texts: pa.StringArray, cuts: np.ndarray) -> list[pa.Array]:
    """Prefixes, middles and suffixes as arrays over the bytes of texts."""
    if not len(texts):
        return [texts, texts, texts]
    offsets = np.append(cuts[:, :3].ravel(), cuts[-1, 3]).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(3 * len(texts), pa.py_buffer(offsets), texts.buffers()[2] or pa.py_buffer(b""))
    rows = np.arange(len(texts)) * 3
    return [pieces.take(pa.array(rows + i)) for i in range(3)]


def transform(texts: pa.Array, h: list[np.ndarray], rate: int = RATE, spm_rate: int = SPM_RATE) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch of texts and their four draws."""
    texts = pc.fill_null(texts, "")
    n, cuts, chars = cut(texts, h[0], h[1])
    marked = np.zeros(len(texts), bool)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
    plain = marked | (n == 0) | (h[2] % 100 >= rate)
    spm = h[3] % 100 < spm_rate
    form = np.where(plain, "plain", np.where(spm, "spm", "psm")).astype(object)
    prefix, middle, suffix = parts(texts, cuts)
    one, two = ((PREFIX, SUFFIX), (SUFFIX, PREFIX))
    large = pa.large_string()
    marks = lambda w: [pa.array(np.where(spm, two[w], one[w]).astype(object), large)]
    front, back = (pc.if_else(pa.array(spm), x, y) for x, y in ((suffix, prefix), (prefix, suffix)))
    middles = pa.scalar(MIDDLE, large)
    moved = pc.binary_join_element_wise(*marks(0), front, *marks(1), back, middles, middle, pa.scalar("", large))
    output = pc.if_else(pa.array(plain), texts.cast(large), moved)
    counts = [pa.array(chars[:, i], pa.int64(), mask=plain) for i in (0, 1)]
    return [pa.array(n, pa.int64()), pa.array(form, pa.string()), *counts, output]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output of each row."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1):
                h = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
                found = transform(batch.column(1), h, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *found[:-1], found[-1].cast(pa.string())], names=[x.split()[0] for x in schema.split(", ")])

    drawn = common.texts(docs.select("doc_id", "text", *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed)))), *(f"h{i}" for i in range(4)))
    return drawn.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. It holds no marker but the three that were put in."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    of = lambda *order: F.concat(*(F.element_at(part, i) for i in order))
    return F.when(form == "plain", output).when(form == "psm", of(2, 4, 3)).otherwise(of(3, 4, 2))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(common.table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, [('0x' || substr(s, 8 * i + 1, 8))::BIGINT for i in range(4)] AS h FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM t),
f AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS e,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {RATE} THEN 'plain' WHEN h[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || e END) AS restored_sha256 FROM f
"""
