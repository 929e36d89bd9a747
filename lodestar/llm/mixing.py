"""Mixing sources to target weights by Pfair scheduling (operator 5), in DataFrame functions only.

A source's documents are numbered in a fixed order and cut into blocks. With
weight w of a total W, block b (from 0) of a source may start at slot
floor(b * W / w), its release, and must have run by ceil((b + 1) * W / w), its
deadline. In each slot the released block with the earliest deadline runs (of equal
ones, that of the first source by name), so that at any time each source is
less than one block away from its target. Weights are taken as they are, as
whole multiples of a power of two, and all arithmetic is in whole numbers: nothing is
rounded, whatever the weights, the sources or the length. Every row is kept: once a source runs out
(from there on_target is false), its slots stay empty and the others go on in
their proportions.

Blocks have BLOCK_DOCS documents, or as many more as it takes for MOST_SLOTS blocks of equal
size to hold the table, so that the schedule, which is laid out on the driver,
has at most MOST_SLOTS blocks and one for each source, whatever the data's size. It is written as a
table of narrow rows and joined to the blocks. What grows with the data there is
the number of sources, with a row each.

Numbering does not gather a source in one task: a row's chunk is drawn from its
doc_id's hash, rows are numbered within (source, chunk), and a running sum of
chunk sizes gives the offset. There are as many chunks as the root of the rows,
so that neither step grows faster than that.

Edge cases: a null source is a source of its own; a source of weight 0, or left
out of the weights, has no slots (its places are null and it comes last, off
target); a negative weight, or one that is no number, is an error; null doc_ids count as the empty text in
the hash; repeated rows each get a place of their own; an empty table gives an empty table;
other columns are carried along by mix(), and a new column whose name is taken
gets a longer one.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_DOCS = 16
MOST_SLOTS = 1 << 20
#: Where releases and deadlines of very small weights are held, so that they fit a long.
LAST = 1 << 62
PLACE = ("mix_slot", "mix_place", "mix_on_target")
COLUMNS = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place", "mix_on_target")


def whole_weights(weights: list[float]) -> list[int]:
    """The same proportions in whole numbers, exactly."""
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(f.denominator for f in exact)) if exact else 1
    found = [int(f * unit) for f in exact]
    shared = math.gcd(*found) or 1
    return [w // shared for w in found]


def schedule(weights: list[int], blocks: list[int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(source, block, release, deadline, slot) of each source's blocks, by earliest deadline
    first, and the slot from which on a source may be missed. Weights are positive."""
    total = sum(weights)
    waiting = [(0, i, 0) for i, n in enumerate(blocks) if n]  # (release, source, block)
    ready: list[tuple[int, int, int, int]] = []  # (deadline, source, block, release)
    found, t = [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, i, b = heapq.heappop(waiting)
            heapq.heappush(ready, (min(-(-(b + 1) * total // weights[i]), LAST), i, b, release))
        deadline, i, b, release = heapq.heappop(ready)
        found.append((i, b, release, deadline, t))
        if b + 1 < blocks[i]:
            heapq.heappush(waiting, (min((b + 1) * total // weights[i], LAST), i, b + 1))
        t += 1
    return found, min((min(n * total // w, LAST) for n, w in zip(blocks, weights, strict=True)), default=0)


def with_weights(counts: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """counts (mix_key, n) with the column weight; None: the square root of a source's documents."""
    if weights is None:
        return counts.withColumn("weight", F.sqrt("n"))
    if any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError("negative weights, or no numbers")
    named = json.dumps([["" if k is None else f"={k}", repr(float(w))] for k, w in weights.items()])
    table = F.inline(F.transform(F.from_json(F.lit(named), "array<array<string>>"), lambda x: F.struct(x[0].alias("mix_key"), x[1].cast("double").alias("weight"))))
    return counts.join(counts.sparkSession.range(1).select(table), "mix_key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def planned(sources: DataFrame, block_docs: int) -> tuple[DataFrame, int]:
    """mix_key, mix_block, release, deadline, slot of the blocks of sources (mix_key, n, weight), and the horizon."""
    plan = sources.where("weight > 0").toArrow().sort_by("mix_key")  # a row for each source
    keys = plan["mix_key"].to_pylist()
    rows, horizon = schedule(whole_weights(plan["weight"].to_pylist()), [-(-n // block_docs) for n in plan["n"].to_pylist()])
    columns = list(zip(*rows, strict=True)) or [()] * 5
    table = pa.table({"mix_key": pa.array([keys[i] for i in columns[0]], pa.string()), **{c: pa.array(v, pa.int64()) for c, v in zip(("mix_block", "release", "deadline", "slot"), columns[1:], strict=True)}})
    return common.written(sources.sparkSession.createDataFrame(table), len(table)), horizon


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """docs with COLUMNS. weights: by source, of any size; None: the root of a source's documents."""
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    total = docs.select("doc_id").count()
    chunks, block_docs = max(1, math.ceil(math.sqrt(total))), max(BLOCK_DOCS, -(-total // MOST_SLOTS))
    doc_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    chunk = F.conv(F.substring(F.md5(doc_text.cast("binary")), 1, 8), 16, 10).cast("long") % chunks
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("mix_id"), key.alias("mix_key"), chunk.alias("mix_chunk"))
    sizes = common.written(rows.groupBy("mix_key", "mix_chunk").agg(F.count("*").alias("n")), total)
    plan, horizon = planned(with_weights(sizes.groupBy("mix_key").agg(F.sum("n").alias("n")), weights), block_docs)
    before = Window.partitionBy("mix_key").orderBy("mix_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("mix_key", "mix_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_offset"))
    within = Window.partitionBy("mix_key", "mix_chunk").orderBy("mix_id")
    placed = rows.withColumn("mix_row", F.row_number().over(within)).join(offsets, ["mix_key", "mix_chunk"])
    placed = placed.withColumn("rank", F.col("mix_offset") + F.col("mix_row") - 1).withColumn("mix_block", F.call_function("div", F.col("rank"), F.lit(block_docs)))
    placed = placed.join(plan, ["mix_key", "mix_block"], "left")
    slotted = F.col("slot").isNotNull()
    found = {
        "mix_block": F.col("mix_block"), "mix_release": F.col("release"), "mix_deadline": F.col("deadline"), "mix_slot": F.col("slot"),
        "mix_place": F.when(slotted, F.col("rank") % block_docs), "mix_on_target": slotted & (F.col("slot") < horizon),
    }
    return placed.select("doc.*", *(v.cast("boolean" if k == "mix_on_target" else "long").alias(common.fresh(docs, k)) for k, v in found.items()))


def mixed_documents(docs: DataFrame, keep_place: bool = False) -> DataFrame:
    """docs, whole, in the order of the mix: files and rows within follow the slots.
    keep_place: with the columns PLACE last, as the order of files doesn't outlast a read.

    Places are worked out on narrow rows; texts then move twice, streamed past a
    hash table of their partition's places and to their part of the order. Of rows that
    repeat a doc_id each takes one of that id's places.
    """
    spark = docs.sparkSession
    own, names, count, turn = common.fresh(docs, "mix_id"), [common.fresh(docs, c) for c in PLACE], common.fresh(docs, "mix_count"), common.fresh(docs, "mix_turn")
    same = Window.partitionBy("doc_id")
    narrow = mix(docs.select("doc_id", "source")).select(F.col("doc_id"), *(F.col(c).alias(k) for c, k in zip(PLACE, names, strict=True)), F.count("*").over(same).alias(count))
    narrow = narrow.withColumn(turn, F.row_number().over(same.orderBy(F.col(names[0]).asc_nulls_last(), names[1])))
    placed = common.written(narrow.withColumnRenamed("doc_id", own), docs.count())
    last, n = placed.agg(F.max(names[0])).first()[0] or 0, common.shuffle_partitions(spark)
    matches = F.col("doc_id").eqNullSafe(F.col(own))
    found = docs.join(placed.where(F.col(count) == 1).drop(turn).hint("shuffle_hash"), matches)
    repeated = placed.where(F.col(count) > 1)
    if not repeated.isEmpty():
        ids = repeated.select(F.col(own).alias("doc_id")).distinct()
        again = common.having_ids(docs, ids).withColumn(turn, F.row_number().over(same.orderBy("source")))
        takes = repeated.withColumnRenamed(turn, common.fresh(again, turn))
        found = found.unionByName(again.join(takes, matches & (F.col(turn) == F.col(common.fresh(again, turn)))).select(found.columns))
    part = F.coalesce(F.floor(F.col(names[0]) * n / (last + 1)), F.lit(n - 1)).cast("int")
    order = [F.col(k).asc_nulls_last() for k in names[:2]]
    return found.repartitionById(n, part).sortWithinPartitions(*order).select(*docs.columns, *(names if keep_place else ()))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(common.table(spark, sf_dir, "documents").select("doc_id", "source"))
    return found.select("doc_id", "source", *(F.col(f"mix_{k}").alias(k) for k in ("block", "release", "deadline", "slot", "place", "on_target")))


OP5_SQL = """
WITH RECURSIVE k AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(1, ceil(sqrt((SELECT count(*) FROM documents)))::BIGINT) AS chunk FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY chunk, doc_id NULLS FIRST) - 1 AS rank FROM k),
b AS (SELECT greatest(16, (count(*) + 1048575) // 1048576) AS docs FROM k),
s AS (SELECT key, (count(*) + docs - 1) // docs AS n, (sqrt(count(*)) * 4503599627370496)::HUGEINT AS w, row_number() OVER (ORDER BY key) AS i FROM k, b GROUP BY key, docs),
z AS (SELECT list(w ORDER BY i) AS ws, list(n ORDER BY i) AS ns, sum(w)::HUGEINT AS q, sum(n) AS many, range(1, count(*) + 1) AS idx, min(n * (SELECT sum(w) FROM s)::HUGEINT // w) AS horizon FROM s),
sim AS (SELECT -1::HUGEINT AS slot, 0::BIGINT AS pick, 0::BIGINT AS j, list_transform(ws, lambda x: 0::BIGINT) AS c, 0::BIGINT AS done FROM z
  UNION ALL
  SELECT t, best, c[best], list_transform(c, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), done + 1 FROM (
    SELECT *, (list_min(list_transform(idx, lambda i: CASE WHEN c[i] < ns[i] AND c[i] * q // ws[i] <= t THEN (((c[i] + 1) * q + ws[i] - 1) // ws[i]) * 100000 + i END)) % 100000)::BIGINT AS best FROM (
      SELECT *, greatest(slot + 1, list_min(list_transform(idx, lambda i: CASE WHEN c[i] < ns[i] THEN c[i] * q // ws[i] END))) AS t FROM sim, z WHERE done < many)))
SELECT doc_id, source, (rank // docs)::BIGINT AS block, (j * q // w)::BIGINT AS release, (((j + 1) * q + w - 1) // w)::BIGINT AS deadline, slot::BIGINT AS slot, (rank % docs)::BIGINT AS place, slot < horizon AS on_target
FROM r JOIN s USING (key) JOIN sim ON sim.done > 0 AND sim.pick = s.i AND sim.j = rank // (SELECT docs FROM b), z, b
"""
