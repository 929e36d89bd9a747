"""A training-corpus pipeline of five operators, each over all that its predecessor kept.

quality rules -> exact dedup -> MinHash near-dedup (five words, 0.8) -> mixing
to target weights -> byte-level BPE. The first three drop rows; mixing keeps
every row and gives each its place in the schedule (mix_slot, mix_place, and
whether the mix is on target there); the last stage returns each document's
token count, digests and place in place of its text.

Edge cases: documents without words fail the quality rules, so null, empty and
blank texts go in the first stage; rows that repeat a doc_id with the same text
go in the second but for one, and later stages treat rows of one doc_id alike;
null sources and languages are values like others; very long texts pass whole;
other columns are carried to the last stage, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, common, exact, mixing, near, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_documents(docs)


def minhash_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, keep_place=True)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    place = docs.columns[-len(mixing.PLACE) :]  # mixing's, under longer names if documents had such columns
    found = bpe.encode_table(docs, *bpe.default_files(), keep_ids=False, carried=tuple(place))
    return found.withColumnsRenamed(dict(zip(place, mixing.PLACE, strict=True)))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", minhash_near),
    ("mix sources", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: SQL expresses neither the MinHash components nor BPE; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
