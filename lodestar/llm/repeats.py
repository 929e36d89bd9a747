"""Removal of long repeats by a common-prefix interval tree (operator 2).

A byte goes if a string of MIN_BYTES bytes that covers it also starts in a
document with a smaller doc_id. Over whole texts, and exact but for 64-bit
digests: two of n different snippets are taken for one with a chance of about
n * n / 2**65:

1. Texts are packed into blocks by doc_id and written once, dealt by block.
   Every later step reads a block in place, so texts are shuffled once.
2. Anchors: in each window of MIN_BYTES bytes, the K-byte string of smallest
   hash (a minimizer). Equal windows have equal anchors. Blocks send distinct
   anchor hashes, 5 bytes each, and learn which ones two documents share.
3. For shared anchors blocks send a digest of the anchor's surroundings (a
   snippet: all windows that the anchor can serve) and the smallest doc_id.
   Snippets with equal digests are a class. In order of digest they are
   neighbours whose common prefix is the whole snippet, so the stack scan of
   step 4 over these prefixes yields the classes as nodes of the interval tree,
   without their bytes; all of a node's documents but the smallest lose the snippet.
4. Of anchors with several classes, each class's smallest document sends the
   snippet's bytes. An enhanced suffix array is built over suffixes of at least
   MIN_BYTES bytes whose first MIN_BYTES bytes repeat after different bytes; a
   stack scan over its common-prefix lengths yields the interval tree. Nodes
   with diverse left extensions are maximal repeats, each with all its
   occurrences; an occurrence goes if the group has a smaller doc_id.
5. Blocks unite what goes from each text.

repeat_groups() returns the nodes themselves, with all occurrences: classes are
expanded to their members, and classes that follow one another with the same
occurrences are chained to one group of full length. Groups of several classes
lie within a snippet; where they go on beyond it, they come as several that overlap.

Hot anchors: a block sends an anchor or a class once however many copies it
holds. Anchors with over HOT_CLASSES classes are dealt by the 15 bytes before
and, again, after them: of any shared window one of the two sides is shared.

Edge cases: null text counts as empty; texts under MIN_BYTES bytes lose
nothing; a null doc_id is not smaller than any, nor is any smaller than it, so
its text stays whole; of rows that repeat a doc_id neither is smaller; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.sources import store

from . import common

MIN_BYTES = 50
K = 20
#: Bytes that a window can have beside the anchor, on one side.
EXTRA = MIN_BYTES - K
WINDOW = EXTRA + 1
SNIPPET = K + 2 * EXTRA
HALF = EXTRA // 2
HOT_CLASSES = 1000
PACK_BYTES = 4 << 20
#: Bytes of documents' files that a block has; a task holds one block's texts.
BLOCK_BYTES = 32 << 20
#: Windows of a long text that are hashed at once.
PART = 1 << 20

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


# ---- anchors and snippets


def _longs(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each offset as an integer."""
    n = len(buf) - 7
    found = np.empty(n, np.uint64)
    for o in range(8):
        found[o::8] = np.frombuffer(buf.data, "<u8", (n - o + 7) // 8, o)
    return found


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    d = 1
    while 2 * d <= width:
        x = f(x[:-d], x[d:])
        d *= 2
    return f(x[: len(x) - (width - d)], x[width - d :]) if d < width else x


def anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and offsets of the anchors of all windows of a text."""
    found, places = [], []
    for start in range(0, len(buf) - MIN_BYTES + 1, PART):
        part = buf[start : start + PART + MIN_BYTES - 1]
        v, n = _longs(part), len(part) - K + 1
        h = v[:n] * _C1
        h ^= h >> _U(32)
        h += v[8 : n + 8]
        h *= _C2
        h ^= h >> _U(29)
        h += v[12 : n + 12]
        h *= _C3
        h ^= h >> _U(32)
        least, pad = _slide(h, WINDOW, np.minimum), np.zeros(WINDOW - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == h)
        found.append(h[at])
        places.append(at + start)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, at = np.concatenate(found), np.concatenate(places)
    if len(found) > 1:
        at, first = np.unique(at, return_index=True)
        h = h[first]
    return h, at


class Block:
    """The texts of a block, in order of doc_id, and their anchors."""

    def __init__(self, packed: pa.Table):
        import zstandard

        ids, texts, nulls = [], [], []
        unpack = zstandard.ZstdDecompressor()
        for row in packed.to_pylist():
            data, sizes = unpack.decompress(row["data"], max_output_size=max(1, row["size"])), np.frombuffer(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            texts += [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            ids += np.frombuffer(row["ids"], np.int64).tolist()
            nulls += np.frombuffer(row["nulls"], bool).tolist()
        order = sorted(range(len(ids)), key=lambda i: (nulls[i], ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.nulls = [nulls[i] for i in order]
        self.texts = [texts[i] for i in order]

    def find(self, buckets: int) -> None:
        """doc, at, key of all anchors; a key is the bucket and 40 bits of the hash."""
        doc, at, key = [], [], []
        for i, t in enumerate(self.texts):
            if len(t) >= MIN_BYTES and not self.nulls[i]:
                h, a = anchors(np.frombuffer(t, np.uint8))
                doc.append(np.full(len(a), i, np.int32))
                at.append(a)
                key.append((((h >> _U(40)) % _U(buckets)) << _U(40)) | (h & _U((1 << 40) - 1)))
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.doc, self.at, self.key = join(doc, np.int32), join(at, np.int64), join(key, np.uint64)

    def find_shared(self, buckets: int, replies: pa.Table) -> None:
        """As find(), of the anchors in the replies' bucket and keys alone."""
        self.find(buckets)
        rows = zip(replies["bucket"].to_pylist(), replies["keys"].to_pylist(), strict=True)
        shared = [_from_five(k) | (_U(b) << _U(40)) for b, k in rows if k]
        chosen = np.isin(self.key, np.concatenate(shared)) if shared else np.zeros(len(self.key), bool)
        self.doc, self.at, self.key = self.doc[chosen], self.at[chosen], self.key[chosen]

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the snippets have before and after their anchors."""
        sizes = np.array([len(t) for t in self.texts], np.int64)
        return np.minimum(self.at, EXTRA), np.minimum(sizes[self.doc] - self.at - K, EXTRA)

    def snippets(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of the anchors at the indexes chosen (in order of doc): the indexes and an array of the snippets, zeros beyond the text."""
        pad, around = bytes(EXTRA), np.arange(SNIPPET)
        start, doc = 0, self.doc[chosen]
        while start < len(chosen):
            base, parts, size, stop = {}, [], 0, start
            while size < PART and stop < len(chosen):
                d = int(doc[stop])
                base[d] = size  # a text's byte x is at base + EXTRA + x
                parts += [pad, self.texts[d]]
                size += EXTRA + len(self.texts[d])
                stop += int(np.searchsorted(doc[stop:], d, "right"))
            buf = np.frombuffer(b"".join([*parts, pad]), np.uint8)
            known, at = np.fromiter(base, np.int64), np.fromiter(base.values(), np.int64)
            for i in range(start, stop, 1 << 16):
                some = chosen[i : min(stop, i + (1 << 16))]
                yield some, buf[(at[np.searchsorted(known, self.doc[some])] + self.at[some])[:, None] + around]
            start = stop

    def digests(self) -> np.ndarray:
        """A 64-bit digest of each anchor's snippet and its sides."""
        before, after = self.sides()
        found = np.empty(len(self.doc), np.uint64)
        for some, m in self.snippets(np.arange(len(self.doc))):
            h = (before[some] * 64 + after[some]).astype(np.uint64) * _C1
            for column in np.ascontiguousarray(m).view("<u8").T:
                h = (h ^ column) * _C2
                h ^= h >> _U(31)
                h *= _C3
            found[some] = h ^ (h >> _U(29))
        return found


# ---- the enhanced suffix array


def suffix_array(rows: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order of the suffixes rows[row][at:], by prefix doubling over 8-byte words; rows are padded with zeros."""
    wide = np.zeros((len(rows), SNIPPET + 64), np.uint8)
    wide[:, :SNIPPET] = rows
    flat, width = wide.reshape(-1), wide.shape[1]
    keys = []
    for o in range(0, SNIPPET, 8):  # big-endian, so that integers sort as bytes do
        idx = (row * width + at + o)[:, None] + np.arange(8)
        keys.append(flat[idx].view(">u8").reshape(-1).astype(np.uint64))
    while len(keys) > 1:  # ranks of 8 bytes, then of 16, 32, 64 and all
        ranks = []
        for i in range(0, len(keys), 2):
            if i + 1 == len(keys):
                ranks.append(keys[i])
                continue
            order = np.lexsort((keys[i + 1], keys[i]))
            a, b = keys[i][order], keys[i + 1][order]
            rank = np.empty(len(order), np.uint64)
            rank[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))]) if len(order) else 0
            ranks.append(rank)
        keys = ranks
    return np.argsort(keys[0], kind="stable")


def common_prefixes(rows: np.ndarray, at: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each suffix in order, the bytes that it shares with the one before; size: the suffixes' lengths."""
    wide = np.zeros((len(rows), 2 * SNIPPET), np.uint8)
    wide[:, :SNIPPET] = rows
    found = np.zeros(len(at), np.int64)
    for i in range(1, len(at), 1 << 15):
        j = np.arange(i, min(len(at), i + (1 << 15)))
        a = wide[row[j][:, None], at[j][:, None] + np.arange(SNIPPET)]
        b = wide[row[j - 1][:, None], at[j - 1][:, None] + np.arange(SNIPPET)]
        differ = a != b
        found[j] = np.where(differ.any(axis=1), differ.argmax(axis=1), SNIPPET)
        found[j] = np.minimum(found[j], np.minimum(size[j], size[j - 1]))
    return found


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Nodes (length, first, last) of the common-prefix interval tree with at least that length, by a stack scan, inner ones first."""
    stack: list[tuple[int, int]] = []  # (length, first)
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = MIN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups (length, rows, offsets) of all occurrences of each string of at
    least that length that occurs after different bytes (or at a row's start).

    rows: padded texts, of which columns lo to hi - 1 count. Inner nodes first.
    """
    spots = np.maximum(0, hi - lo - least + 1)
    row = np.repeat(np.arange(len(rows)), spots)
    at = np.arange(len(row)) - np.repeat(np.cumsum(spots) - spots, spots) + lo[row]
    if not len(row):
        return
    # suffixes whose first bytes occur nowhere else, or always after the same byte, head no maximal repeat
    width = rows.shape[1]
    h, flat = np.zeros(len(row), np.uint64), np.concatenate([rows.reshape(-1), np.zeros(8, np.uint8)])
    v, base = _longs(flat), row * width + at
    for o in [*range(0, least - 7, 8), least - 8]:
        h = (h ^ v[base + o]) * _C2
        h ^= h >> _U(31)
    left = np.where(at > lo[row], flat[base - 1].astype(np.int64), -1 - row)  # a row's start is like no other
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    diverse = np.minimum.reduceat(left[order], first) != np.maximum.reduceat(left[order], first)
    keep = order[np.repeat(diverse, np.diff(np.append(first, len(order))))]
    if not len(keep):
        return
    row, at, left = row[keep], at[keep], left[keep]
    sa = suffix_array(rows, at, row)
    row, at, left = row[sa], at[sa], left[sa]
    lcp = common_prefixes(rows, at, row, hi[row] - at)
    for length, a, b in intervals(lcp.tolist(), least):
        some = left[a : b + 1]
        if some[0] != some[-1] or (some != some[0]).any():
            yield length, row[a : b + 1], at[a : b + 1]


def later_members(same: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of snippets in order of class and then of doc_id: whether a node of the interval tree
    has the snippet and a smaller document. same: whether a snippet is of the class
    of the one before; what they have in common is then the whole snippet."""
    later = np.zeros(len(ids), bool)
    nodes = np.array(list(intervals(np.where(same, SNIPPET, 0).tolist(), MIN_BYTES)), np.int64).reshape(-1, 3)
    if len(nodes):
        first, size = nodes[:, 1], nodes[:, 2] - nodes[:, 1] + 1
        member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        later[member] = ids[member] > np.repeat(ids[first], size)
    return later


# ---- steps


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    first = _first(key)
    return zip(first.tolist(), [*first[1:].tolist(), len(key)][: len(first)], strict=True)


def _five(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").reshape(-1).astype(np.uint64)


def _table(schema: str, columns: dict) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<struct<start:long,stop:long>>": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in fields})


def _by_bucket(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted key that have one bucket."""
    bucket = (key >> _U(40)).astype(np.int64)
    for a, b in _runs(bucket):
        yield int(bucket[a]), slice(a, b)


def _first(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


PACKED = "block int, size long, ids binary, nulls binary, sizes binary, data binary"


def pack(docs: DataFrame, blocks: int) -> DataFrame:
    """Texts, compressed, in rows of about PACK_BYTES, dealt by block and written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held: dict[int, list] = {}
        total = 0

        def rows():
            for block, items in held.items():
                ids, nulls, texts = zip(*items, strict=True)
                data = b"".join(texts)
                yield _table(PACKED, {
                    "block": [block], "size": [len(data)], "ids": [np.array(ids, np.int64).tobytes()], "nulls": [np.array(nulls, bool).tobytes()],
                    "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()], "data": [zstandard.ZstdCompressor(level=1).compress(data)],
                }).to_batches()[0]

        for batch in (part for whole in batches for part in common.slices(whole, 2)):
            for block, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = (t or "").encode()
                held.setdefault(block, []).append((i or 0, i is None, text))
                total += len(text)
                if total > 4 * PACK_BYTES:
                    yield from rows()
                    held, total = {}, 0
        yield from rows()

    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    packed = common.texts(docs).select(block.alias("block"), "doc_id", "text").mapInArrow(run, PACKED)
    spark = docs.sparkSession
    store.folder(spark)  # sets the context's, if there is none
    # a checkpoint of a plan that isn't adaptive keeps its partitioning, so later steps read a block without a shuffle
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return packed.repartition(blocks, "block").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def send_anchors(packed: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, keys, twice (whether two documents of the block have it)."""
    schema = "bucket int, block int, keys binary, twice binary"

    def run(part: pa.Table) -> pa.Table:
        block = Block(part)
        block.find(buckets)
        order = np.lexsort((block.ids[block.doc], block.key))
        key, ids = block.key[order], block.ids[block.doc[order]]
        first = _first(key)
        twice = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(key) else np.empty(0, bool)
        key, out = key[first], {"bucket": [], "block": [], "keys": [], "twice": []}
        for bucket, s in _by_bucket(key):
            for k, v in zip(out, (bucket, part["block"][0].as_py(), _five(key[s]), twice[s].tobytes()), strict=True):
                out[k].append(v)
        return _table(schema, out)

    return packed.groupBy("block").applyInArrow(run, schema)


def shared_anchors(sent: DataFrame) -> DataFrame:
    """block, bucket, keys: of each block's anchors those that two documents have."""
    schema = "block int, bucket int, keys binary"

    def run(part: pa.Table) -> pa.Table:
        keys = [_from_five(x) for x in part["keys"].to_pylist()]
        key, twice = np.concatenate(keys), np.frombuffer(b"".join(part["twice"].to_pylist()), bool)
        order = np.argsort(key, kind="stable")
        first = _first(key[order])
        n = np.diff(np.append(first, len(key)))
        both = (n > 1) | np.maximum.reduceat(twice[order], first)
        shared = np.empty(len(key), bool)
        shared[order] = np.repeat(both, n)
        ends = np.cumsum([len(k) for k in keys])
        out = {"block": part["block"].to_pylist(), "bucket": part["bucket"].to_pylist(), "keys": [_five(k[shared[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]}
        return _table(schema, out)

    return sent.groupBy("bucket").applyInArrow(run, schema)


def send_classes(packed: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, keys, digests, ids: the classes of shared anchors, each with the block's smallest doc_id."""
    schema = "bucket int, block int, keys binary, digests binary, ids binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"bucket": [], "block": [], "keys": [], "digests": [], "ids": []}
        if len(left) and len(right):
            block = Block(left)
            block.find_shared(buckets, right)
            digest = block.digests()
            order = np.lexsort((block.ids[block.doc], digest, block.key))
            key, digest, ids = block.key[order], digest[order], block.ids[block.doc[order]]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])])) if len(key) else []
            key, digest, ids = key[first], digest[first], ids[first]
            for bucket, s in _by_bucket(key):
                for k, v in zip(out, (bucket, left["block"][0].as_py(), _five(key[s]), digest[s].tobytes(), ids[s].tobytes()), strict=True):
                    out[k].append(v)
        return _table(schema, out)

    return packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, schema)


def judge_classes(sent: DataFrame) -> DataFrame:
    """block, later, wanted, hot: digests of classes with a smaller document in
    another block; of classes whose bytes the block must send; of those to deal by sides."""
    schema = "block int, later binary, wanted binary, hot binary"

    def run(part: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in part["digests"].to_pylist()]
        key, digest = np.concatenate([_from_five(x) for x in part["keys"].to_pylist()]), np.concatenate(parts)
        ids, source = np.frombuffer(b"".join(part["ids"].to_pylist()), np.int64), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.lexsort((ids, digest, key))
        key, digest, ids, source = key[order], digest[order], ids[order], source[order]
        head = np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])]) if len(key) else np.empty(0, bool)
        first = np.flatnonzero(head)
        later = later_members(~head, ids)
        # of the classes (first rows): anchors whose classes differ in their smallest document
        groups = _first(key[first])
        least, n = ids[first], np.diff(np.append(groups, len(first)))
        differ = np.minimum.reduceat(least, groups) != np.maximum.reduceat(least, groups) if len(groups) else np.empty(0, bool)
        wanted, hot = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        wanted[first] = np.repeat(differ & (n <= HOT_CLASSES), n)
        hot[first] = np.repeat(differ & (n > HOT_CLASSES), n)
        cut = lambda m: _split(digest[m], source[m], len(parts))
        return _table(schema, {"block": part["block"].to_pylist(), "later": cut(later), "wanted": cut(wanted), "hot": cut(hot)})

    return sent.groupBy("bucket").applyInArrow(run, schema)


def _split(values: np.ndarray, source: np.ndarray, n: int) -> list[bytes]:
    order = np.argsort(source, kind="stable")
    ends = np.cumsum(np.bincount(source, minlength=n))
    return [x.tobytes() for x in np.split(values[order], ends[:-1])]


def _all(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), np.uint64)


def _side_key(key: np.ndarray, m: np.ndarray, columns: slice, salt: int) -> np.ndarray:
    h = key * _C1 + _U(salt)
    for c in np.ascontiguousarray(m[:, columns]).T.astype(np.uint64):
        h = (h ^ c) * _C2
        h ^= h >> _U(31)
    return h


def send_snippets(packed: DataFrame, shared: DataFrame, judged: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, n, digests, keys, ids, sides, rows: the bytes of the classes asked for."""
    schema = "bucket int, block int, digests binary, keys binary, ids binary, sides binary, rows binary"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {k: [] for k in names}
        wanted, hot = _all(right["wanted"]), _all(right["hot"])
        if len(left) and len(wanted) + len(hot):
            block = Block(left)
            block.find_shared(buckets, right)
            digest = block.digests()
            asked = np.flatnonzero(np.isin(digest, np.concatenate([wanted, hot])))
            by_id = asked[np.lexsort((block.ids[block.doc[asked]], digest[asked]))]
            chosen = np.sort(by_id[_first(digest[by_id])])
            before, after = block.sides()
            for some, m in block.snippets(chosen):
                is_hot = np.isin(digest[some], hot)
                deals = [(some[~is_hot], m[~is_hot], block.key[some[~is_hot]])]
                deals += [(some[is_hot], m[is_hot], _side_key(block.key[some[is_hot]], m[is_hot], s, i)) for i, s in enumerate((slice(EXTRA - HALF, EXTRA), slice(EXTRA + K, EXTRA + K + HALF)))]
                for who, rows, group in deals:
                    to = ((group ^ (group >> _U(40))) % _U(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    for a, b in _runs(to[order]):
                        o = order[a:b]
                        sides = np.stack([before[who[o]], after[who[o]]], axis=1).astype(np.uint8)
                        for k, v in zip(names, (int(to[o[0]]), left["block"][0].as_py(), digest[who[o]].tobytes(), group[o].tobytes(), block.ids[block.doc[who[o]]].tobytes(), sides.tobytes(), np.ascontiguousarray(rows[o]).tobytes()), strict=True):
                            out[k].append(v)
        return _table(schema, out)

    replies = judged.select("block", "wanted", "hot").unionByName(shared, allowMissingColumns=True)
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def repeat_parts(rows: np.ndarray, sides: np.ndarray, ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after each snippet's anchor that a smaller document repeats (with the anchor itself); -1: none."""
    before, after = np.full(len(rows), -1, np.int64), np.full(len(rows), -1, np.int64)
    # a shared window has half of what is beside the anchor on one side
    alike = np.zeros(len(rows), bool)
    for i, s in enumerate((slice(EXTRA - HALF, EXTRA), slice(EXTRA + K, EXTRA + K + HALF))):
        h = _side_key(group, rows, s, i)
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        alike |= n[back] > 1
    chosen = np.flatnonzero(alike)
    chosen = chosen[np.argsort(group[chosen], kind="stable")]
    start = 0
    while start < len(chosen):  # whole groups, about 20,000 snippets at once
        stop = min(len(chosen), start + 20_000)
        stop = int(np.searchsorted(group[chosen], group[chosen[stop - 1]], "right"))
        some = chosen[start:stop]
        start = stop
        lo, hi = EXTRA - sides[some, 0].astype(np.int64), EXTRA + K + sides[some, 1].astype(np.int64)
        own = ids[some]
        for length, row, at in maximal_repeats(rows[some], lo, hi):
            who = own[row]
            later = who > who.min()
            r, a = some[row[later]], at[later]
            np.maximum.at(before, r, EXTRA - a)
            np.maximum.at(after, r, a + length - EXTRA - K)
    return before, after


def find_repeats(sent: DataFrame) -> DataFrame:
    """block, digests, parts: of classes whose smallest document repeats a smaller one."""
    schema = "block int, digests binary, parts binary"

    def run(part: pa.Table) -> pa.Table:
        blobs = part["digests"].to_pylist()
        sizes = [len(b) // 8 for b in blobs]
        digest, source = np.frombuffer(b"".join(blobs), np.uint64), np.repeat(np.arange(len(sizes)), sizes)
        read = lambda k, t: np.frombuffer(b"".join(part[k].to_pylist()), t)
        rows, sides = read("rows", np.uint8).reshape(-1, SNIPPET), read("sides", np.uint8).reshape(-1, 2)
        before, after = repeat_parts(rows, sides, read("ids", np.int64), read("keys", np.uint64))
        hit = before >= 0
        parts = np.stack([before, after], axis=1).astype(np.uint8)
        out: dict = {"block": [], "digests": [], "parts": []}
        order = np.flatnonzero(hit)[np.argsort(source[hit], kind="stable")]
        for a, b in _runs(source[order]):
            out["block"].append(part["block"][int(source[order[a]])].as_py())
            out["digests"].append(digest[order[a:b]].tobytes())
            out["parts"].append(np.ascontiguousarray(parts[order[a:b]]).tobytes())
        return _table(schema, out)

    return sent.groupBy("bucket").applyInArrow(run, schema)


def cut(packed: DataFrame, shared: DataFrame, judged: DataFrame, found: DataFrame, buckets: int, with_text: bool) -> DataFrame:
    """The result: what stays of each text."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,stop:long>>, kept binary" * with_text
    replies = judged.select("block", "later").unionByName(found, allowMissingColumns=True).unionByName(shared, allowMissingColumns=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left)
        block.find_shared(buckets, right)
        digest, ids = block.digests(), block.ids[block.doc]
        order = np.lexsort((ids, digest))
        head = np.zeros(len(order), bool)
        head[_first(digest[order])] = True
        whole = np.zeros(len(digest), bool)  # a smaller document of the block has it
        whole[order] = later_members(~head, ids[order])
        whole |= np.isin(digest, _all(right["later"]))
        before, after = (np.where(whole, x, -1) for x in block.sides())
        named = _all(right["digests"])
        if len(named):
            parts = np.frombuffer(b"".join(x for x in right["parts"].to_pylist() if x), np.uint8).reshape(-1, 2).astype(np.int64)
            names, back = np.unique(named, return_inverse=True)
            most = np.full((len(names), 2), -1, np.int64)
            np.maximum.at(most, back, parts)
            at = np.minimum(np.searchsorted(names, digest), len(names) - 1)
            hit = (names[at] == digest) & ~whole
            before[hit], after[hit] = most[at[hit], 0], most[at[hit], 1]
        gone = np.flatnonzero(before >= 0)
        doc, start, stop = block.doc[gone], block.at[gone] - before[gone], block.at[gone] + K + after[gone]
        edges = np.searchsorted(doc, np.arange(len(block.texts) + 1))
        out: dict = {x.split(" ")[0]: [] for x in schema.split(", ")}
        for i, t in enumerate(block.texts):
            spans, a, b = [], edges[i], edges[i + 1]
            if b > a:
                by = a + np.argsort(start[a:b], kind="stable")
                s, e = start[by], np.maximum.accumulate(stop[by])
                head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                spans = list(zip(s[head].tolist(), e[np.append(head[1:], len(e)) - 1].tolist(), strict=True))
            kept, last = [], 0
            for x, y in spans:
                kept.append(t[last:x])
                last = y
            rest = b"".join([*kept, t[last:]])
            row = [None if block.nulls[i] else int(block.ids[i]), len(t), len(t) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()]
            row += [[{"start": x, "stop": y} for x, y in spans], rest] if with_text else []
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return _table(schema, out)

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, spans and kept: one row per row of docs."""
    blocks = buckets = common.partitions_for(docs, BLOCK_BYTES)
    packed = pack(docs, blocks)
    shared = common.written(shared_anchors(send_anchors(packed, buckets)))
    judged = common.written(judge_classes(send_classes(packed, shared, buckets)))
    found = common.written(find_repeats(send_snippets(packed, shared, judged, buckets)))
    return cut(packed, shared, judged, found, buckets, with_text)


def instances(packed: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """digest, doc_id, at, start, stop: the snippets around shared anchors, an anchor being at ``at``."""
    schema = "digest long, doc_id long, at long, start long, stop long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left)
        block.find_shared(buckets, right)
        before, after = block.sides()
        return _table(schema, {"digest": block.digests().view(np.int64), "doc_id": block.ids[block.doc], "at": block.at, "start": block.at - before, "stop": block.at + K + after})

    return packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, schema)


def inner_nodes(sent: DataFrame) -> DataFrame:
    """group_id, length, digest, offset: maximal repeats of several classes, a row for each class, with the place from its anchor."""
    schema = "group_id long, length long, digest long, offset long"

    def run(part: pa.Table) -> pa.Table:
        read = lambda k, t: np.frombuffer(b"".join(part[k].to_pylist()), t)
        rows, sides, key, digest = read("rows", np.uint8).reshape(-1, SNIPPET), read("sides", np.uint8).reshape(-1, 2).astype(np.int64), read("keys", np.uint64), read("digests", np.int64)
        out: dict = {x.split(" ")[0]: [] for x in schema.split(", ")}
        for group in np.unique(key):
            some = np.flatnonzero(key == group)
            for length, row, at in maximal_repeats(rows[some], EXTRA - sides[some, 0], EXTRA + K + sides[some, 1]):
                name = int.from_bytes(hashlib.blake2b(rows[some[row[0]], at[0] : at[0] + length].tobytes(), digest_size=8).digest(), "little", signed=True)
                for k, v in zip(out, ([name] * len(row), [length] * len(row), digest[some[row]].tolist(), (at - EXTRA).tolist()), strict=True):
                    out[k] += v
        return _table(schema, out)

    return sent.groupBy("bucket").applyInArrow(run, schema)


def repeat_groups(docs: DataFrame) -> DataFrame:
    """group_id, length, doc_id, start: the occurrences of strings of MIN_BYTES bytes or
    more that two documents share, one row each; start counts bytes."""
    blocks = buckets = common.partitions_for(docs, BLOCK_BYTES)
    packed = pack(docs, blocks)
    shared = common.written(shared_anchors(send_anchors(packed, buckets)))
    judged = common.written(judge_classes(send_classes(packed, shared, buckets)))
    places = common.written(instances(packed, shared, buckets))
    # classes of two documents or more, and how the others lie to the first occurrence
    least = F.min(F.struct("doc_id", "start", "stop")).alias("least")
    nodes = places.groupBy("digest").agg(least, F.max("doc_id").alias("last"), F.count("*").alias("n")).where("least.doc_id < last")
    members = common.written(places.join(nodes.select("digest", "least", "n"), "digest").withColumn("delta", F.col("start") - F.col("least.start")))
    alike = members.groupBy("digest", "n", "least").agg(F.bit_xor(F.xxhash64("doc_id", "delta")).alias("others"))
    line = Window.partitionBy("least.doc_id", "n", "others").orderBy("least.start", "least.stop")
    ends = F.max("least.stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    chained = alike.withColumn("opens", F.coalesce(F.col("least.start") > ends, F.lit(True)).cast("int")).withColumn("chain", F.sum("opens").over(line))
    chained = chained.groupBy("least.doc_id", "n", "others", "chain").agg(F.min(F.struct("least.start", "digest")).alias("head"), F.max("least.stop").alias("stop"))
    heads = chained.select("head.digest", F.col("head.start").alias("from"), (F.col("stop") - F.col("head.start")).alias("length"))
    whole = members.join(heads, "digest").select(F.xxhash64("digest", "length").alias("group_id"), "length", "doc_id", (F.col("from") + F.col("delta")).alias("start"))
    inner = inner_nodes(send_snippets(packed, shared, judged, buckets)).join(places, "digest")
    inner = inner.select("group_id", "length", "doc_id", (F.col("at") + F.col("offset")).alias("start")).distinct()
    apart = inner.groupBy("group_id").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("group_id")
    return whole.unionByName(inner.join(apart, "group_id"))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), with_text=False)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS p, unnest(list_transform(range(0, length(h) // 2 - 49), lambda i: substr(h, 2 * i + 1, 100))) AS g FROM d),
x AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM w),
s AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS head FROM x WHERE doc_id > least),
r AS (SELECT doc_id, p, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
m AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
t AS (SELECT doc_id, list(struct_pack(a := a, b := b) ORDER BY a) AS spans, sum(b - a) AS n_removed, count(*) AS n_spans FROM m GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN spans IS NULL THEN h
  ELSE array_to_string(list_transform(range(0, len(spans) + 1), lambda i: substr(h, CASE WHEN i = 0 THEN 0 ELSE 2 * spans[i].b END + 1, CASE WHEN i = len(spans) THEN length(h) ELSE 2 * spans[i + 1].a END - CASE WHEN i = 0 THEN 0 ELSE 2 * spans[i].b END)), '') END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
