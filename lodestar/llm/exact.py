"""Exact dedup by a minimal perfect hash over historical distinct digests (operator 6).

1. Each text is normalised (white space deleted) and digested (SHA-256).
2. Rows are of the history or new. Distinct digests of either part, each with
   winner and count, are aggregated map-side first. With no history of its own,
   the operator takes the rows whose doc_id's hash is even as history, as if
   they had been loaded before; the others are new.
3. The history's digests are dealt into shards by their first bytes. Each shard
   gets a minimal perfect hash (hash and displace): slot i holds the full digest,
   the winner's locator (doc_id, code points) and the group's size.
4. The distinct new digests are looked up in their shard's table. The slot's 32
   digest bytes are compared: equal, and it is a member, whose slot takes the
   better locator and the sum of the sizes; else it isn't one, and its new rows
   are a group by themselves.
5. Slots and the groups of nonmembers name each row's winner, by its digest.

A digest comes once from each part, so no shard can be hot: it has about
SHARD_KEYS digests of 60 bytes. Rows meet their winner in a join whose hot
digests AQE splits, the winners being one row a digest.

Edge cases: null text counts as empty; of texts equal but for white space, the
one with the most code points, then the smallest doc_id (null last) stays;
rows that repeat the winner's doc_id count as the winner in dedup(), while
keep_documents() returns one of them, the one with the most code points; an empty
table gives an empty table; other columns are ignored by dedup() and kept by
keep_documents(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARD_KEYS = 20_000
#: Marks a displacement that is a slot itself.
DIRECT = np.uint32(1 << 31)
_DELETE = common.SPACE_CHARS.encode()


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _DELETE)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, points (code points of the text), digest (binary) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, 1)):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(t or "") for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(normalised(t)).digest() for t in texts], pa.binary()),
                ],
                names=["doc_id", "points", "digest"],
            )

    return common.texts(docs).mapInArrow(run, "doc_id long, points long, digest binary")


def winners(rows: DataFrame) -> DataFrame:
    """digest, keep_id, keep_points, group_size: one row per distinct digest."""
    # the smallest struct wins: most code points, then the smallest doc_id, null last
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    best = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return best.select("digest", F.col("best.d").alias("keep_id"), (-F.col("best.p")).alias("keep_points"), "group_size")


def _words(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three 64-bit words of each 32-byte digest, of which the hashes are made."""
    w = digest.view("<u8").reshape(len(digest), 4)
    return w[:, 1], w[:, 2], w[:, 3]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def build(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace: (displacement of each bucket, slot of each key).

    digest: distinct keys, an (n, 32) array of bytes. Slots are 0 to n - 1. The
    largest buckets are placed first, all of one size at once; the only key of
    a bucket goes to any free slot, which its displacement names with DIRECT.
    """
    n = len(digest)
    a, b, c = _words(digest)
    buckets = max(1, n // 4)
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    displace, slot, taken = np.zeros(buckets, np.uint32), np.empty(n, np.int64), np.zeros(n, bool)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    claim = np.empty(n, np.int64)
    for size in range(sizes.max(initial=0), 1, -1):
        left = np.flatnonzero(sizes == size)
        keys = order[starts[left][:, None] + np.arange(size)]
        d = 0
        while len(left):
            at = (_mix(b[keys] + c[keys] * np.uint64(d)) % np.uint64(n)).astype(np.int64)
            free = np.flatnonzero(~taken[at].any(axis=1))
            claim[at[free][::-1]] = np.arange(len(free))[::-1, None]  # of several that want a slot, the first gets it
            spread = np.sort(at[free], axis=1)
            won = free[(claim[at[free]] == np.arange(len(free))[:, None]).all(axis=1) & (spread[:, 1:] != spread[:, :-1]).all(axis=1)]
            displace[left[won]], slot[keys[won]] = d, at[won]
            taken[at[won]] = True
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, keys, d = left[rest], keys[rest], d + 1
    single = np.flatnonzero(sizes == 1)
    slot[order[starts[single]]] = free = np.flatnonzero(~taken)
    displace[single] = free.astype(np.uint32) | DIRECT
    return displace, slot


def slots(digest: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    """The slot that the hash gives each key, whether or not it is a member."""
    a, b, c = _words(digest)
    d = displace[(a % np.uint64(len(displace))).astype(np.int64)]
    at = (_mix(b + c * d.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    return np.where(d >= DIRECT, (d & ~DIRECT).astype(np.int64), at)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def shard_of(digest, shards: int):
    """A shard by the first 7 hexadecimal digits of a digest."""
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 7), 16, 10).cast("long"), F.lit(shards)).cast("int")


def perfect_hash(history: DataFrame, shards: int) -> DataFrame:
    """shard, n, displace, slots (digests in order of slot), keep_id, keep_points,
    group_size: one row per shard, of the rows of winners()."""

    def run(part: pa.Table) -> pa.Table:
        digest = _matrix(part["digest"])
        displace, slot = build(digest)
        back = np.empty_like(slot)
        back[slot] = np.arange(len(slot))
        at = pa.array(back)
        return pa.table(
            {
                "shard": pa.array([part["shard"][0].as_py()], pa.int32()),
                "n": pa.array([len(slot)], pa.int64()),
                "displace": pa.array([displace.tobytes()], pa.binary()),
                "slots": pa.array([digest[back].tobytes()], pa.binary()),
                **{k: pa.array([part[k].take(at).to_pylist()], pa.list_(pa.int64())) for k in ("keep_id", "keep_points", "group_size")},
            }
        )

    return (
        history.withColumn("shard", shard_of("digest", shards))
        .groupBy("shard")
        .applyInArrow(run, "shard int, n long, displace binary, slots binary, keep_id array<long>, keep_points array<long>, group_size array<long>")
    )


def look_up(fresh: DataFrame, tables: DataFrame, shards: int, replace: bool) -> DataFrame:
    """digest, member, keep_id, keep_points, group_size of all slots and of the nonmembers among fresh (rows of winners()).
    replace: whether a member may take the place of its slot's winner."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = ("keep_id", "keep_points", "group_size")
        own = {k: np.array(left[k].to_pylist(), object) for k in columns}
        digest, held, member = _matrix(left["digest"]), np.empty((0, 32), np.uint8), np.zeros(len(left), bool)
        slot = {k: [] for k in columns}
        if len(right):
            row = right.slice(0, 1).to_pylist()[0]
            held, slot = np.frombuffer(row["slots"], np.uint8).reshape(-1, 32), {k: row[k] for k in columns}
        if len(left) and len(held):
            at = slots(digest, np.frombuffer(row["displace"], np.uint32), row["n"])
            member = (held[at] == digest).all(axis=1)
            for i, x in zip(np.flatnonzero(member).tolist(), at[member].tolist(), strict=True):
                slot["group_size"][x] += own["group_size"][i]
                rank = lambda d, p: (-p, d is None, d or 0)
                if replace and rank(own["keep_id"][i], own["keep_points"][i]) < rank(slot["keep_id"][x], slot["keep_points"][x]):
                    slot["keep_id"][x], slot["keep_points"][x] = own["keep_id"][i], own["keep_points"][i]
        out = {k: [*slot[k], *own[k][~member].tolist()] for k in columns}
        every = [x.tobytes() for m in (held, digest[~member]) for x in m]
        return pa.table({"digest": pa.array(every, pa.binary()), "member": pa.array([True] * len(held) + [False] * int((~member).sum())), **{k: pa.array(v, pa.int64()) for k, v in out.items()}})

    dealt = fresh.withColumn("shard", shard_of("digest", shards))
    schema = "digest binary, member boolean, keep_id long, keep_points long, group_size long"
    return dealt.groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(run, schema)


def resolved(docs: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, points, digest of each row, and what look_up() says of each digest."""
    rows = common.written(digests(docs))
    old = F.xxhash64("doc_id") % 2 == 0 if history is None else F.lit(False)
    n = rows.count()
    known = common.written(winners(rows.where(old)), n) if history is None else history
    fresh = common.written(winners(rows.where(~old)), n)
    shards = max(1, -(-max(known.count(), fresh.count()) // SHARD_KEYS))
    return rows, look_up(fresh, perfect_hash(known, shards), shards, history is None)


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, member: one row per row of docs.

    history: rows of winners() from earlier tables, which stay the winners of
    their groups, so that no row of docs with such a text is kept; None: part of
    docs, where the best row of all stays. member: whether the history has the text.
    """
    rows, found = resolved(docs, history)
    found = rows.join(found, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.lit(history is None) | ~F.col("member"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "member")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    A doc_id with one row needs no more than its id. Rows of a doc_id that comes
    several times are told apart by digest and code points, and one of equal
    rows stays.
    """
    rows, found = resolved(docs)
    best = found.select("digest", F.col("keep_id").alias("doc_id"), F.col("keep_points").alias("points"))
    times = rows.groupBy("doc_id").agg(F.count("*").alias("times")).select(F.col("doc_id").alias("own"), "times")
    best = common.written(best.join(times, F.col("doc_id").eqNullSafe(F.col("own"))).drop("own"), rows.count())
    out = common.having_ids(docs, best.where("times = 1").select("doc_id"))
    several = best.where("times > 1")
    if several.isEmpty():
        return out
    name = {c: common.fresh(docs, c) for c in ("kept_doc", "kept_digest", "kept_points")}
    text = F.coalesce("text", F.lit(""))
    own = docs.withColumns({name["kept_digest"]: F.unhex(F.sha2(F.translate(text, common.SPACE_CHARS, "").cast("binary"), 256)), name["kept_points"]: F.length(text)})
    wanted = several.select(F.col("doc_id").alias(name["kept_doc"]), F.col("digest").alias(name["kept_digest"]), F.col("points").cast("int").alias(name["kept_points"]))
    on = [F.col(f"l.{name[c]}") == F.col(f"r.{name[c]}") for c in ("kept_digest", "kept_points")]
    again = own.alias("l").join(wanted.hint("shuffle_hash").alias("r"), [F.col("l.doc_id").eqNullSafe(F.col(f"r.{name['kept_doc']}")), *on], "left_semi")
    return out.unionByName(again.dropDuplicates(["doc_id", name["kept_digest"]]).select(*docs.columns))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("member")


OP6_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM r
"""
