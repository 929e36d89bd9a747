"""LM scoring by prediction by partial matching (operator 1).

The model is a byte-context trie of contexts of up to ORDER bytes, pretrained
on all training documents. A text is its bytes with A-Z lower-cased, then an
end mark (byte 255, which UTF-8 never uses); the context before the first byte
is end marks. In a context of q symbols seen T times in all, a symbol seen n times
has the chance (2 n - 1) / (2 T), and an escape q / (2 T) (method D). After an escape the symbols of the longer context
are excluded from the shorter one's counts, down to a uniform choice among the
symbols left. The score is the log10 probability of the text and its end.

Every n-gram is kept, so the trie grows with the corpus, and it is split over
tasks. One pass counts each task's n-grams and words; sums over the tasks are
one row per distinct n-gram or word. The n-grams are dealt by the last SHARD
bytes of their context: the longer contexts that end so, with all their symbols,
then lie in one task, and the shorter ones (at most 256 ** SHARD nodes a level)
are sent to all. A shard of more than SHARD_ROWS n-grams, or of WIDE_SHARD of them all, is dealt by one byte more, its
parts again, and so on down to whole contexts; the contexts that are split so (at most 256 nodes each, and
at most as many contexts of a length as those bounds allow) are sent as well. So each n-gram's chance is worked out
once, and no task's shards grow with the corpus.

Texts never move. n-grams with at least HOT_GRAM of all bytes, and words with at
least HOT_SHARE of all tokens (at most 1 / HOT_GRAM and 1 / HOT_SHARE of them),
are sent to the tasks that read the documents, and looked up there. Every other
n-gram and word of a document goes, with its number there, to the chances and the
word counts by a shuffle in which no key can be hot any more; sums by document
follow, added up map-side first.

Edge cases: null text counts as empty, so it has one token, the end, and its
score is that of an immediate end; a null doc_id counts as the empty text in
the split; without training documents counts are 0 and the model is uniform;
repeated rows each get a row; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 5
SHARD = 2
HOT_SHARE = 2.0**-20
#: So at most 8 million n-grams of 16 bytes are broadcast.
HOT_GRAM = 2.0**-23
#: A shard with more distinct n-grams than this, or at least this share of them all, is dealt by one more byte of context.
SHARD_ROWS = 1 << 20
WIDE_SHARD = 2.0**-10
END = 255
SYMBOLS = 256
#: Bytes of text that are turned into codes at once, and words or n-grams held before they are handed on.
CHUNK = 1 << 20
HELD = 250_000
#: Stands in the place of a word where a row is about an n-gram; no word holds white space.
GRAM = "\n"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def runs(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For about CHUNK bytes at a time: the (order + 1)-gram that ends at each byte of
    each text or its end, as an integer whose last byte is the symbol, after the text's index."""
    pad = bytes([END]) * order
    joined = np.frombuffer(pad + b"".join(t + bytes([END]) + pad for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 + order for t in texts])
    for lo in range(0, len(joined) - order, CHUNK):
        at = np.arange(lo, min(lo + CHUNK, len(joined) - order))
        found = np.zeros(len(at), np.int64)
        for j in range(order + 1):
            found = (found << 8) | joined[lo + j : lo + j + len(at)]
        own = np.searchsorted(ends, at, side="right")
        keep = at < ends[own] - order  # the padding between texts isn't predicted
        yield own[keep], found[keep]


def codes(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    return np.concatenate([found for _, found in runs(texts, order)])


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK bytes with the index of the first."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def sums(keys: np.ndarray, *counted: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, sorted, and the sums of what is counted over each."""
    found, back = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(back, weights=n, minlength=len(found)).astype(np.int64) for n in counted)


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """word, code, n, m: for each word of training texts (empty: the end; code 0) n, its
    count there; for each n-gram (word GRAM) n, its count in training, and m, that in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        parts: list[tuple[np.ndarray, ...]] = []
        names = ["word", "code", "n", "m"]

        def words():
            columns = [pa.array([w.decode() for w in seen], pa.string()), pa.array(np.zeros(len(seen), np.int64)), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, columns[1]], names=names)

        def grams():
            for i in range(0, len(parts[0][0]), HELD):
                some = [x[i : i + HELD] for x in parts[0]]
                yield pa.RecordBatch.from_arrays([pa.repeat(GRAM, len(some[0])), *map(pa.array, some)], names=names)

        for batch in (part for whole in batches for part in common.slices(whole, 1)):
            held: list = [[], []]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[training(i)].append((t or "").encode().lower())
            for trained, texts in enumerate(held):
                for _, some in chunks(texts):
                    if trained:
                        for t in some:
                            seen.update(t.split())
                        seen[b""] += len(some)
                    for _, grams_here in runs(some, order):
                        found, n = np.unique(grams_here, return_counts=True)
                        parts.append((found, n * trained, n))
                    if sum(len(p[0]) for p in parts) > 2 * len(parts[0][0]) + 2 * HELD:
                        parts = [sums(*map(np.concatenate, zip(*parts, strict=True)))]
                    if len(seen) > HELD:
                        yield words()
                        seen = Counter()
            if parts and len(parts[0][0]) > 16 * HELD:
                parts = [sums(*map(np.concatenate, zip(*parts, strict=True)))]
                yield from grams()
                parts = []
        yield words()
        if parts:
            parts = [sums(*map(np.concatenate, zip(*parts, strict=True)))]
            yield from grams()

    rows = common.texts(docs).mapInArrow(run, "word string, code long, n long, m long")
    return rows.groupBy("word", "code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Table:
    """Integers to indexes, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys, self.index = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for a slot, the last stays
            won = free & (self.keys[at] == keys[left])
            self.index[at[won]] = left[won]
            at, left = (at[~won] + 1) & ((1 << self.bits) - 1), left[~won]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1."""
        at = self._slot(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.index[at], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[left]
            found[left[hit]] = self.index[at[hit]]
            on = ~hit & (held >= 0)
            left, at = left[on], at[on]
        return found


class Model:
    """The trie as tables: levels[j] has the codes (sorted) and counts of the kept (j + 1)-grams."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.entry = [Table(c) for c, _ in levels]
        self.log_n = [np.log10(2 * n - 1) for _, n in levels]
        self.context, self.weight = [], []
        ctx, total, kinds, inner = [], [], [], []  # by level: contexts, T, q, and the shorter context's count of their symbols
        mask = lambda x, k: x & ((1 << (8 * k)) - 1)
        for j, (c, n) in enumerate(levels):
            own, first, q = np.unique(c >> 8, return_index=True, return_counts=True)
            add = lambda x: np.add.reduceat(x, first) if len(c) else x  # noqa: B023, E731
            ctx.append(own)
            total.append(add(n))
            kinds.append(q)
            inner.append(add(levels[j - 1][1][np.searchsorted(levels[j - 1][0], mask(c, j))]) if j else None)
            # weight[:, d]: log10 of the escapes through the d longest contexts over the next one's denominator
            weight = np.zeros((len(own), j + 2))
            escape = np.log10(q) - np.log10(2 * total[j])
            weight[:, 0] = -np.log10(2 * total[j])
            for k in range(j - 1, -1, -1):
                at, up = np.searchsorted(ctx[k], mask(own, k)), np.searchsorted(ctx[k + 1], mask(own, k + 1))
                rest_t, rest_q = total[k][at] - inner[k + 1][up], kinds[k][at] - kinds[k + 1][up]
                den = np.log10(np.maximum(1, 2 * rest_t))
                weight[:, j - k] = escape - den
                escape = escape + np.where(rest_q > 0, np.log10(np.maximum(1, rest_q)) - den, 0)  # nothing left: it's certain
            if len(own):
                weight[:, j + 1] = escape - math.log10(max(1, SYMBOLS - int(kinds[0][0])))
            self.context.append(Table(own))
            self.weight.append(weight)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the chance of each n-gram's last byte after the others."""
        top = self.order
        at = self.entry[top].find(grams)
        ctx = self.context[top].find(grams >> 8)
        found = np.empty(len(grams))
        hit = at >= 0
        found[hit] = self.log_n[top][at[hit]] + self.weight[top][ctx[hit], 0]
        left = np.flatnonzero(~hit)
        left_ctx, longest = ctx[left], np.full(len(left), top)
        for j in range(top - 1, -1, -1):  # the longest context of those not found
            no = left_ctx < 0
            left_ctx[no] = self.context[j].find((grams[left[no]] >> 8) & ((1 << (8 * j)) - 1))
            longest[no] = j
        symbol_at = np.full(len(left), -1)
        depth_log = np.zeros(len(left))
        for j in range(top - 1, -1, -1):  # the longest context in which the symbol was seen
            no = np.flatnonzero((symbol_at < 0) & (longest >= j))
            at = self.entry[j].find(grams[left[no]] & ((1 << (8 * (j + 1))) - 1))
            ok = at >= 0
            symbol_at[no[ok]] = j
            depth_log[no[ok]] = self.log_n[j][at[ok]]
        for j in range(top + 1):
            mine = np.flatnonzero((longest == j) & (left_ctx >= 0))
            deep = np.where(symbol_at[mine] >= 0, j - symbol_at[mine], j + 1)
            found[left[mine]] = depth_log[mine] + self.weight[j][left_ctx[mine], deep]
        found[left[left_ctx < 0]] = -math.log10(SYMBOLS)  # an empty model
        return found


_hot: dict = {}


def levels_of(c: np.ndarray, n: np.ndarray, levels: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """The nodes of some levels from all n-grams' codes and counts in training."""
    return [sums(c & ((1 << (8 * (j + 1))) - 1), n) for j in levels]


def chances(grams: DataFrame, order: int) -> DataFrame:
    """code, m, chance (log10) of each row (code, n, m) of grams, all the (order + 1)-grams."""
    spark, near = grams.sparkSession, min(SHARD, order + 1)
    some = lambda keep: F.col("code").bitwiseAND(F.lit((1 << (8 * keep)) - 1)).alias("code")
    ending = lambda size: F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * size)) - 1))  # noqa: E731 - the context's last bytes
    arrays = lambda t: [t[c].to_numpy().astype(np.int64) for c in t.column_names]
    short = levels_of(*arrays(grams.where("n > 0").groupBy(some(near)).agg(F.sum("n").alias("n")).toArrow()), range(near))  # at most 256 ** SHARD rows
    splits: list[tuple[np.ndarray, ...]] = []  # for contexts of SHARD bytes and more: those that are too wide for one task, and their nodes
    inside, most = grams, min(SHARD_ROWS, WIDE_SHARD * grams.count()) if order > SHARD else 0
    for size in range(SHARD, order):
        (wide,) = arrays(inside.groupBy(ending(size).alias("shard")).agg(F.count("*").alias("rows")).where(F.col("rows") >= most).select("shard").toArrow())  # at most rows / most
        if not len(wide):
            break
        inside = inside.where(ending(size).isin(wide.tolist()))
        splits.append((wide, *sums(*arrays(inside.where("n > 0").groupBy(some(size + 1)).agg(F.sum("n").alias("n")).toArrow()))))  # at most 256 rows for each
    shared = spark.sparkContext.broadcast((short, splits))

    def trie(c: np.ndarray, n: np.ndarray) -> Model:
        short, splits = shared.value
        own = levels_of(c, n, range(near, order + 1))
        for j, (wide, *split) in enumerate(splits):
            whole = ~np.isin(own[j][0] >> 8, wide)
            own[j] = sums(*(np.concatenate([x[whole], y]) for x, y in zip(own[j], split, strict=True)))
        return Model(short + own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        size, most = 0, 2 * HELD

        def valued(rows):
            c, n, m = rows[1:]
            lm = trie(c[n > 0], n[n > 0])
            for i in range(0, len(c), HELD):
                some = c[i : i + HELD]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(m[i : i + HELD]), pa.array(lm.log10(some))], names=["code", "m", "chance"])

        for batch in batches:
            parts.append([x.to_numpy() for x in batch.columns])
            size += len(batch)
            if size > most:  # whole shards only; the last may go on in the next batch
                rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield from valued([x[:cut] for x in rows])
                parts = [[x[cut:] for x in rows]]
                size = len(parts[0][0])
                most = 2 * (size + HELD)
        if size:
            yield from valued([np.concatenate(x) for x in zip(*parts, strict=True)])

    shard = ending(SHARD)
    for size, (wide, *_) in enumerate(splits, SHARD):
        shard = F.when(ending(size).isin(wide.tolist()), ending(size + 1) + (1 << (8 * size + 8))).otherwise(shard)
    dealt = grams.select(shard.alias("shard"), "code", "n", "m")
    dealt = dealt.repartition(common.shuffle_partitions(spark), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "code long, m long, chance double")


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes: one row per row of docs."""
    spark = docs.sparkSession
    counted = common.written(counts(docs, order))
    is_gram = F.col("word") == GRAM
    n, v, total = counted.agg(
        F.coalesce(F.sum(F.when(~is_gram, F.col("n"))), F.lit(0)), F.count(F.when(~is_gram & (F.col("n") > 0), 1)), F.coalesce(F.sum("m"), F.lit(0))
    ).first()
    vocabulary = counted.where(~is_gram & (F.col("n") > 0))
    valued = common.written(chances(counted.where(is_gram).select("code", "n", "m"), order))
    hot_words = vocabulary.where(F.col("n") >= HOT_SHARE * n).select("word", "n").toArrow()  # at most 1 / HOT_SHARE words
    hot_grams = valued.where(F.col("m") >= HOT_GRAM * total).select("code", "chance").toArrow()  # at most 1 / HOT_GRAM n-grams
    hot = spark.sparkContext.broadcast((hot_words["word"].to_pylist(), hot_words["n"].to_pylist(), hot_grams["code"].to_numpy(), hot_grams["chance"].to_numpy()))
    name = uuid.uuid4().hex
    kinds = {"rid": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_bytes": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "word": pa.string(), "code": pa.int64(), "k": pa.int64()}
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, word string, code long, k long"

    def rows(height: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(height, t) for c, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _hot.get("name") != name:
            _hot.clear()
            words, c, grams, chance = hot.value
            _hot.update(name=name, words={w.encode(): math.log10(k + 1) for w, k in zip(words, c, strict=True)}, table=Table(np.array(grams)), chance=np.append(chance, 0.0))
        known, table, chance = _hot["words"], _hot["table"], _hot["chance"]
        for batch in (part for whole in batches for part in common.slices(whole, 2)):
            rids, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            texts = [(t or "").encode().lower() for t in batch.column(2).to_pylist()]
            for start, some in chunks(texts):
                own_rids, own_ids = rids[start : start + len(some)], ids[start : start + len(some)]
                logs = np.zeros(len(some))
                for own, grams in runs(some, order):
                    at = table.find(grams)
                    logs += np.bincount(own, weights=chance[at], minlength=len(some))  # at -1 lies a 0
                    off = np.flatnonzero(at < 0)
                    if len(off):
                        by = np.lexsort((grams[off], own[off]))
                        o, g = own[off][by], grams[off][by]
                        first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (g[1:] != g[:-1])]))
                        k = np.diff(np.append(first, len(g)))
                        for i in range(0, len(first), HELD):
                            few = first[i : i + HELD]
                            yield rows(len(few), rid=pa.array(own_rids[o[few]]), word=pa.repeat(GRAM, len(few)), code=pa.array(g[few]), k=pa.array(k[i : i + HELD]))
                tokens, n_known, base, cold = [], [], [], ([], [], [])
                for rid, t in zip(own_rids.tolist(), some, strict=True):
                    found = Counter(t.split())
                    found[b""] = 1
                    here, logsum = 0, 0.0
                    for w, k in found.items():
                        if w in known:
                            here += k
                            logsum += k * known[w]
                        else:
                            cold[0].append(rid)
                            cold[1].append(w)
                            cold[2].append(k)
                    tokens.append(sum(found.values()))
                    n_known.append(here)
                    base.append(logsum)
                # a name that neither a word nor an n-gram has, different for each row, so that these rows spread
                yield rows(
                    len(some), rid=pa.array(own_rids), doc_id=pa.array(own_ids, pa.int64()), held_out=pa.array([not training(i) for i in own_ids]), n_tokens=pa.array(tokens, pa.int64()), n_bytes=pa.array([len(t) for t in some], pa.int64()),
                    known=pa.array(n_known, pa.int64()), base=pa.array(base, pa.float64()), score=pa.array(logs), word=pa.array([f"{GRAM}{rid}" for rid in own_rids.tolist()]), code=pa.array(np.zeros(len(some), np.int64)),
                )
                if cold[0]:
                    zeros = np.zeros(len(cold[0]), np.int64)
                    yield rows(len(zeros), rid=pa.array(cold[0], pa.int64()), word=pa.array(cold[1], pa.binary()).cast(pa.string()), code=pa.array(zeros), k=pa.array(cold[2], pa.int64()))

    found = common.texts(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, schema)
    values = vocabulary.select("word", "code", F.log10(F.col("n") + 1).alias("value"))
    values = values.unionByName(valued.where(F.col("m") < HOT_GRAM * total).select(F.lit(GRAM).alias("word"), "code", F.col("chance").alias("value")))
    joined = found.join(values, ["word", "code"], "left")
    value, word = F.col("value"), ~is_gram & F.col("value").isNotNull()
    missing = F.raise_error(F.lit("an n-gram without a chance")).cast("double")
    summed = joined.groupBy("rid").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_bytes")),
        F.sum(F.coalesce("known", F.when(word, F.col("k")))).alias("n_known"),
        F.sum(F.coalesce("base", F.when(word, F.col("k") * value))).alias("logs"),
        F.sum(F.coalesce("score", F.when(is_gram, F.col("k") * F.coalesce(value, missing)))).alias("score"),
    )
    base = F.col("logs") - F.col("n_tokens") * math.log10(n + v + 1)
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes")


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
