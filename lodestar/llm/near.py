"""Near-dedup by b-bit MinHash (operator 7).

1. sketch(): a document's set of word shingles is hashed to 64 bits each and
   min-hashed PERMS times. The bands' keys serve candidate search; of each
   minimum only the low 4 bits are retained, packed into 64-bit words.
2. Documents with the same set (by a digest of the set) are one class, named
   by its smallest doc_id; only classes go on.
3. Classes that share a band key meet in a bucket. With BANDS bands of ROWS
   rows, a pair of similarity 0.8 is missed with a chance of
   (1 - 0.8 ** 5) ** 40 = 1e-7; a more similar one less often.
4. Round one tests each bucket's members against its smallest one. Round two
   tests the members whose bucket holds one that round one left in another
   component. So no link is lost, and a large group of near copies costs about
   one test per member, not one per pair. Signatures are joined to documents, one
   row each, and dealt to the buckets after that. Buckets that are large even
   then are tiled, so a task gets at most about 2 * TILE members.
5. A test first estimates the similarity from the packed bits: of 4-bit values
   1 in 16 agrees by chance, so J = (agreeing - 1/16) / (1 - 1/16). Pairs within
   SLACK of the threshold (over 4.5 standard errors) are confirmed on the full
   sets of 64-bit shingle hashes. Round two, where groups of documents that
   only just miss the threshold are to be told apart, first asks which members
   have any such partner (a semi-join, so no pairs come out). Those that buckets
   connect are one cloud; its members meet in blocks, and a task counts what
   the sets of two blocks have in common at once. Only links come out, and no
   pair is looked at twice, however many buckets it shares.
6. Components come from alternating large-star and small-star steps, each
   written to the shared folder; links never come to the driver.

Edge cases: A-Z are lower-cased; a text of fewer words than a shingle is one
shingle, its whole sequence; null, empty and blank texts have no shingle, link
with nothing and stay; rows that repeat a doc_id share its fate; a null doc_id
is linked only through others of its class and is never the one kept unless
its component is null as well; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS = 5
PERCENT = 80
BANDS, ROWS = 40, 5
PERMS = BANDS * ROWS
#: Most minima of a signature.
LONG_PERMS = 1024
BITS = 4
#: How far below the threshold an estimate may lie, over 4.5 standard errors.
SLACK = 0.15
TILE = 5000
#: A block of round two has at most about TILE / 5 members, and so many bytes of sets.
BLOCK_BYTES = 8 << 20
#: Columns of a part of a block's matrix.
COLUMNS = 2048
#: Bits of the bitmap of wanted documents, 16 MB.
SLOTS = 1 << 27

_ODD = np.uint64(0x9E3779B97F4A7C15)
_seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, size=(2, LONG_PERMS), dtype=np.uint64)
_A, _B = (_seeds[0] << np.uint64(1)) | np.uint64(1), _seeds[1]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, k)
    found = h[: n - width + 1] + np.uint64(width)
    for j in range(1, width):
        found = (found ^ (found >> np.uint64(29))) * _ODD + h[j : n - width + 1 + j]
    found = (found ^ (found >> np.uint64(32))) * _ODD
    return np.unique(found ^ (found >> np.uint64(29)))


def signature(shingles: np.ndarray, perms: int = PERMS) -> np.ndarray:
    """The minima of a set, 32 bits each."""
    least = np.full(perms, 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 512):
        x = (shingles[None, i : i + 512] * _A[:perms, None] + _B[:perms, None]) >> np.uint64(32)
        np.minimum(least, x.min(axis=1).astype(np.uint32), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of one signature."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * _ODD
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def packed(sig: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum: of every 64 minima, one word for each bit."""
    low = np.zeros(-(-len(sig) // 64) * 64, np.uint32)
    low[: len(sig)] = sig
    planes = (low.reshape(-1, 1, 64) >> np.arange(BITS, dtype=np.uint32)[:, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2).reshape(-1, 8).view(np.int64).reshape(-1)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest, bands, bits; the last three null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for value in batch.column(1):
                s = shingle_set(value.as_py(), k, hashes)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                sig = signature(s)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(sig), packed(sig)))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), longs, longs), strict=True))],
                names=["doc_id", "n_shingles", "digest", "bands", "bits"],
            )

    return common.texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>")


def estimate(a, b, perms: int):
    """Similarity from two packed signatures, corrected for chance agreement."""
    groups = -(-perms // 64)
    agree = F.lit(perms)
    for g in range(groups):
        differ = None
        for i in range(BITS * g, BITS * g + BITS):
            x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
            differ = x if differ is None else differ.bitwiseOR(x)
        agree = agree - F.bit_count(differ)
    chance = 1 / 2**BITS
    return (agree / perms - chance) / (1 - chance)


def may_link(n_a, n_b, bits_a, bits_b, percent: int):
    """Whether sizes and packed signatures allow a link."""
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & (estimate(bits_a, bits_b, PERMS) >= percent / 100 - SLACK)


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, shingles of the documents wanted (rep)."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    words = wanted.groupBy(F.shiftright(slot("rep"), 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(rep), 64) AS int))")).alias("bits")).toArrow()
    held = np.zeros(SLOTS // 64, np.int64)
    held[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1).cast(pa.bool_()))

    # a bitmap of fixed size keeps most texts that aren't wanted out of the shuffle; the join is exact
    texts = docs.select(F.col("doc_id").alias("rep"), "text", slot("doc_id").alias("slot")).mapInArrow(likely, "rep long, text string").join(wanted, "rep", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (part for whole in batches for part in common.slices(whole, 1)):
            sets = [shingle_set(t.as_py(), k, hashes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "shingles"])

    return common.written(texts.mapInArrow(make, "rep long, shingles binary"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough. Pairs are dealt by a, at most about TILE of them
    together, and each such group has the set of a once, in front of the sets of its b."""
    many = common.written(pairs.groupBy("a").count().where(F.col("count") > TILE).select("a", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), 0)
    tile = F.coalesce(F.pmod(F.xxhash64("b"), "tiles"), F.lit(0)).alias("tile")
    dealt = pairs.join(many, "a", "left").select("a", tile, "b")
    heads = sets.join(dealt.select(F.col("a").alias("rep"), "tile").distinct(), "rep").select(F.col("rep").alias("a"), "tile", F.lit(None).cast("long").alias("b"), "shingles")
    both = heads.unionByName(dealt.join(sets.select(F.col("rep").alias("b"), "shingles"), "b"))
    both = both.repartition("a", "tile").sortWithinPartitions("a", "tile", F.col("b").asc_nulls_first()).select("a", "b", "shingles")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.empty(0, np.uint64)  # the set of a, which may come in an earlier batch
        for batch in batches:
            linked = []
            for head, value in zip(batch.column(1).is_null().to_pylist(), batch.column(2), strict=True):
                y = np.frombuffer(value.as_buffer(), np.uint64)
                if head:
                    x = y.copy()
                    linked.append(False)
                    continue
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                shared = int((long[at] == short).sum())
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return common.written(both.mapInArrow(test, "a long, b long"), rows)


def star_step(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, after a large-star and a small-star step; the same components."""
    # large star: a node's larger neighbours hang on its smallest neighbour or itself
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small star: a node and its smaller neighbours hang on the smallest of them
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of all nodes of edges (a, b), a != b."""
    rows = edges.count()
    edges = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    state = None
    while True:
        edges = common.written(star_step(edges), rows)  # so that plans stay short
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state, rows = now, now[0]
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def tiled(member: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join of buckets' members, large buckets in tiles."""
    side = lambda own, other, x: member.select(
        "key", F.col("tile").alias(own), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias(other), *(F.col(c).alias(f"{c}_{x}") for c in columns)
    )
    return side("t", "u", "a"), side("u", "t", "b")


def dealt(members: DataFrame, buckets: DataFrame, rows: int) -> DataFrame:
    """members (rep, keys, ...) as one row per key that buckets (key, m) has, with the
    number of tiles that m members need and the member's tile; written, as both sides of a join read it."""
    spread = members.select("*", F.explode("keys").alias("key")).drop("keys")
    spread = spread.join(buckets.select("key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), "key")
    return common.written(spread.withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles").cast("int")), 4 * rows)


def open_members(shared: DataFrame, classes: DataFrame, comps: DataFrame, percent: int, rows: int) -> DataFrame:
    """rep, component, keys: the members that may link to another component's member,
    with the buckets in which. Pairs with the hub were tested before."""
    named = comps.select(F.col("node").alias("rep"), "component")
    own = shared.where("rep != hub").groupBy("rep").agg(F.collect_list("key").alias("keys"))  # at most BANDS
    own = common.written(own.join(named, "rep", "left").join(classes, "rep").withColumn("component", F.coalesce("component", "rep")), rows)
    buckets = own.select(F.explode("keys").alias("key"), "component").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
    a, b = tiled(dealt(own, buckets.where("lo != hi"), rows), ["rep", "component", "n", "bits"])
    cond = (F.col("l.component_a") != F.col("r.component_b")) & may_link(F.col("l.n_a"), F.col("r.n_b"), F.col("l.bits_a"), F.col("r.bits_b"), percent)
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("key", "t", "u")]
    found = a.alias("l").join(b.alias("r"), [*same, cond], "left_semi").select("key", F.col("rep_a").alias("rep"), F.col("component_a").alias("component"))
    return common.written(found.groupBy("rep", "component").agg(F.collect_set("key").alias("keys")), rows)


def in_common(sets: list[np.ndarray], left: slice, right: slice) -> np.ndarray:
    """The size of the intersection of each set of left with each of right, two parts of sets: either the
    same or one after the other; of the same part, only pairs (a, b) with a < b count."""
    lengths = [len(x) for x in sets]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, a, b = np.repeat(np.arange(len(sets)), lengths), range(len(sets))[left], range(len(sets))[right]
    found = np.zeros((len(a), len(b)), np.float32)  # exact for counts below 2 ** 24
    # what many sets have goes by a product of matrices, what few have pair by pair
    many = times > max(1, int(np.sqrt(len(a) * len(b)) / 10))
    number, total = np.cumsum(many) - 1, int(many.sum())
    own = many[column]
    dense_row, dense_column = row[own], number[column[own]]
    order = np.argsort(dense_column, kind="stable")
    dense_row, dense_column = dense_row[order], dense_column[order]
    for start in range(0, total, COLUMNS):
        i, j = np.searchsorted(dense_column, [start, start + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, total - start)), np.float32)
        part[dense_row[i:j], dense_column[i:j] - start] = 1
        found += part[left] @ part[right].T
    own = ~own & (times[column] > 1)
    row, column = row[own], column[own]
    order = np.argsort(column, kind="stable")  # rows stay in order within a column
    row, column = row[order], column[order]
    at, step = np.arange(len(row)), 1
    while len(at := at[at < len(row) - step]) and len(at := at[column[at] == column[at + step]]):
        x, y = row[at], row[at + step]
        mine = (x < a.stop) & (y >= b.start)
        np.add.at(found, (x[mine] - a.start, y[mine] - b.start), 1)
        step += 1
    return found


def block_links(block: pa.Table, percent: int) -> pa.Table:
    """The links (a, b) between different components of a block's members (t, u, rep, component, tile,
    shingles): those within the tile, if t = u, else those from tile t to tile u."""
    tile = block["tile"].to_numpy()
    order = np.argsort(tile, kind="stable")
    rep, component = block["rep"].to_numpy()[order], block["component"].to_numpy()[order]
    none = np.empty(0, np.int64)
    a, b = none, none
    if len(rep) and component.min() != component.max():
        same = block["t"][0].as_py() == block["u"][0].as_py()
        first = len(rep) if same else int((tile == block["t"][0].as_py()).sum())
        left, right = (slice(0, first), slice(0, first)) if same else (slice(0, first), slice(first, len(rep)))
        values = block["shingles"].combine_chunks().take(pa.array(order))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in values]
        if first and right.start < right.stop:
            sizes = np.array([len(x) for x in sets], np.float64)
            shared = in_common(sets, left, right).astype(np.float64)
            linked = (100 + percent) * shared >= percent * (sizes[left, None] + sizes[None, right])
            linked &= component[left, None] != component[None, right]
            i, j = np.nonzero(np.triu(linked, 1) if same else linked)
            a, b = rep[left][i], rep[right][j]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def cloud_links(members: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Links (a, b) between open members (rep, component, keys) of different components, found on their full
    sets. A cloud is what buckets connect; its members are dealt to tiles, and each two tiles are a block."""
    keys = members.select("rep", F.explode("keys").alias("key"))
    hubs = keys.join(keys.groupBy("key").agg(F.min("rep").alias("hub")), "key").where("rep != hub")
    cloud = components(hubs.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cloud"))
    own = common.written(members.select("rep", "component").join(cloud, "rep").join(sets, "rep"))
    tiles = F.greatest(F.ceil(F.count("*") / max(1, TILE // 5)), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).cast("int")
    spread = own.join(own.groupBy("cloud").agg(tiles.alias("tiles")), "cloud").withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles").cast("int"))
    blocks = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    blocks = blocks.select("cloud", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "rep", "component", "tile", "shingles")
    found = blocks.groupBy("cloud", "t", "u").applyInArrow(lambda block: block_links(block, percent), "a long, b long")
    return common.written(found, rows)


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept: one row per row of docs."""
    rows = common.written(sketch(docs, k))
    n = rows.count()
    narrow = rows.select("doc_id", "n_shingles", "digest")
    reps = narrow.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    own = rows.join(reps.withColumnRenamed("digest", "rep_digest"), (F.col("digest") == F.col("rep_digest")) & (F.col("doc_id") == F.col("rep")))
    classes = common.written(own.dropDuplicates(["rep"]).select("rep", F.col("n_shingles").alias("n"), "bits", "bands"), n)
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub != last")
    shared = common.written(keys.join(buckets.select("key", "hub"), "key"), 4 * n)

    side = lambda x: classes.select(*(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "bits")))
    star = shared.where("rep != hub").select(F.col("hub").alias("rep_a"), F.col("rep").alias("rep_b")).distinct()
    star = star.join(side("a"), "rep_a").join(side("b"), "rep_b")
    star = star.where(may_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), percent))
    star = common.written(star.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), n)
    links = confirmed(star, full_sets(docs, star.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), k), percent, n)
    comps = components(links)
    members = open_members(shared, classes.drop("bands"), comps, percent, n)
    if not members.isEmpty():
        sets = full_sets(docs, members.select("rep").distinct(), k)
        more = cloud_links(members, sets, percent, n)
        if not more.isEmpty():
            comps = components(links.unionByName(more))
    named = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("found"))
    out = narrow.join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_documents(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns."""
    ids = near_duplicates(docs, k, percent).where("kept").select("doc_id").distinct()
    return common.having_ids(docs, common.written(ids, docs.count()))


def op7_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


#: Candidates by prefixes: of two sets similar enough, each has one of its rarest
#: n - ceil(0.8 n) + 1 shingles in common with the other's.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
q AS (SELECT g, count(*) AS df FROM e GROUP BY g),
x AS (SELECT doc_id, g FROM e JOIN q USING (g) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, g) <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id),
v AS (SELECT a, b, len(list_intersect(s.sh, t.sh)) AS common, len(s.sh) + len(t.sh) AS n FROM c JOIN s ON s.doc_id = a JOIN s t ON t.doc_id = b),
l AS (SELECT a, b FROM v WHERE 100 * common >= 80 * (n - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS node FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.node = u.a),
k AS (SELECT doc_id, min(node) AS least FROM r GROUP BY doc_id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept FROM s LEFT JOIN k USING (doc_id)
"""
