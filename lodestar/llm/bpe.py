"""Byte-level BPE encoding and decoding with a local rank file (operator 3).

Ranks come from a tiktoken file named by a parameter; each executor's worker
loads it once. Long texts are cut only where no match of the pre-splitting
pattern can cross: between a character that is not white space and white space
after it, or before the last character of a run of white space. The ids are
thus those of the whole text. Decoding concatenates the raw bytes of the ids.

Edge cases: a null or empty text has no ids, and both digests are those of the
empty string; a null doc_id passes through; repeated rows give repeated rows;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: A text is cut at the first safe place after so many characters.
PIECE_CHARS = 100_000
#: Unicode's White_Space, which is what \s means in the tokenizer's pattern (Python's \s also takes U+001C to U+001F).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")

_loaded: dict = {}


def encoding(rank_file: str, pattern: str):
    """The encoder of a rank file, once per worker."""
    import tiktoken

    if (rank_file, pattern) not in _loaded:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[rank_file, pattern]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text, cut at safe boundaries at least ``size`` characters apart."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, enc) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers."""
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text or "")]
    return np.concatenate(parts).astype("<u4") if len(parts) > 1 else parts[0].astype("<u4")


def decode(ids: np.ndarray, enc) -> bytes:
    """The raw bytes of ids; they need not be valid UTF-8."""
    return enc.decode_bytes(ids.tolist())


def encode_table(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (array, if keep_ids), ids_sha256, decoded_sha256 and the carried columns of each row."""
    rows = common.texts(docs, *carried)
    schema = "doc_id long, n_tokens long, " + "ids array<long>, " * keep_ids + "ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            counts, kept, hashes, decoded = [], [], [], []
            for value in batch.column(1):
                ids = encode(value.as_py(), enc)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(decode(ids, enc)).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int64))
            columns = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64())]
            columns += [pa.array(kept, pa.list_(pa.int64()))] * keep_ids
            columns += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(common.table(spark, sf_dir, "documents"), *default_files(), keep_ids=False)
