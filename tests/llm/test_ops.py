import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, common, exact, langid, licenses, mixing, near, ppm, quality, queries, repeats, urls

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, word string, component string"


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a long text, near and exact copies, clashing names."""
    rng = random.Random(3)
    words = ["the", "of", "ande", "ring", "tion", "ßö", "a", "1,2", "it's"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(60))]) for _ in range(n))
    texts = [None, "", " \n\t", "one", "one", "One  two", text(60), text(200), text(4000)]
    texts += [texts[6], texts[6].upper(), texts[7] + " tail", "x" + texts[7], text(30) + " " + texts[7][100:400] + text(20), "a a a a a a", texts[8][:9000]]
    texts += ["All rights reserved. " + text(5), "Licensed under the Apache License, Version 2.0. All rights reserved."]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s0", "s1"][i % 3], 0, "d", "w", "c") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, "null id text " + texts[6], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DATA, "documents")


def duck(df=None):
    c = duckdb.connect()
    if df is not None:
        c.register("frame", df.toArrow())
        c.sql("CREATE TABLE documents AS SELECT * FROM frame")
    else:
        for t in ("documents", "pages"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(got, want):
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.select(*(f'"{n}"' for n in names)).fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), duck().sql(queries.ORACLE_SQL[name]))


def test_sql_on_odd_rows(odd, empty):
    for df in (odd, empty):
        c = duck(df)
        same(quality.documents_rules(df).drop("host"), c.sql(quality.OP4_SQL))
        same(exact.dedup(df).drop("member"), c.sql(exact.OP6_SQL))
        same(licenses.scan(df), c.sql(licenses.OP8_SQL))
    kept = quality.keep_documents(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()


def base_counts(rows):
    seen = Counter()
    for r in rows:
        if ppm.training(r["doc_id"]):
            seen.update([*(r["text"] or "").encode().lower().split(), b""])
    return seen


def slow_ppm(rows, order):
    """log10 chances by the definition, over dictionaries and single bytes."""
    trie = defaultdict(Counter)
    for r in rows:
        if ppm.training(r["doc_id"]):
            t = bytes([255]) * order + (r["text"] or "").encode().lower() + b"\xff"
            for i in range(order, len(t)):
                for k in range(order + 1):
                    trie[t[i - k : i]][t[i]] += 1

    def chance(context, s):
        out, p, started = set(), 1.0, False
        for k in range(order, -1, -1):
            c = context[len(context) - k :]
            if c not in trie:
                continue
            left = {x: n for x, n in trie[c].items() if x not in out}
            if not left:
                out |= set(trie[c])
                continue
            total = sum(left.values()) if not started else sum(left.values())
            started = True
            if s in left:
                return p * (2 * left[s] - 1) / (2 * total)
            p *= len(left) / (2 * total)
            out |= set(trie[c])
        return p / (256 - len(out))

    def log(text):
        t = bytes([255]) * order + text.encode().lower() + b"\xff"
        return sum(math.log10(chance(t[i - order : i], t[i])) for i in range(order, len(t)))

    return log


@pytest.mark.parametrize("order", [2, ppm.ORDER])
@pytest.mark.parametrize("hot", [ppm.HOT_GRAM, 2.0**-8, 1.0])
def test_ppm(odd, empty, order, hot, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_GRAM", hot)
    monkeypatch.setattr(ppm, "CHUNK", 5000)
    rows = [r for r in odd.collect()]
    seen, log = base_counts(rows), slow_ppm(rows, order)
    n, v = sum(seen.values()), len(seen)
    got = {(r["doc_id"], r["n_bytes"]): r for r in ppm.score(odd, order).collect()}
    for r in rows:
        text = r["text"] or ""
        words = [*text.encode().lower().split(), b""]
        found = got[r["doc_id"], len(text.encode())]
        assert (found["n_tokens"], found["n_known"], found["train_tokens"]) == (len(words), sum(seen[w] > 0 for w in words), n)
        assert found["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words))
        assert found["score"] == pytest.approx(log(text), rel=1e-9)
    assert ppm.score(empty).count() == 0


@pytest.mark.parametrize("rows", [1, 40, 400])
def test_ppm_splits_shards(odd, rows, monkeypatch):
    """Shards in parts of any depth, down to whole contexts, give the chances of undivided ones."""
    grams = common.written(ppm.counts(odd).where(F.col("word") == ppm.GRAM).select("code", "n", "m"))
    found = []
    for most, share in ((1 << 60, 2.0), (rows, 2.0)):
        monkeypatch.setattr(ppm, "SHARD_ROWS", most)
        monkeypatch.setattr(ppm, "WIDE_SHARD", share)
        found.append({r["code"]: (r["m"], r["chance"]) for r in ppm.chances(grams, ppm.ORDER).collect()})
    whole, parted = found
    assert whole.keys() == parted.keys() and len(whole) == grams.count() > 1000
    assert all(m == parted[c][0] and x == pytest.approx(parted[c][1], rel=1e-12) for c, (m, x) in whole.items())


def test_ppm_keeps_rare_ngrams(spark):
    """Over 2^24 training bytes, n-grams that were seen once still count, by way of the shuffle."""
    rare = "zq xk jv! Qué raro"
    texts = ["abcdefgh" * (1 << 17)] * 24 + [rare + " uno", rare[:9], "the " + rare, "ab xk"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    data = [t.encode().lower() for i, t in enumerate(texts) if ppm.training(i)]
    assert sum(map(len, data)) > 1 << 24
    grams, n = np.unique(np.concatenate([ppm.codes([t]) for t in data]), return_counts=True)
    levels = []
    for j in range(ppm.ORDER + 1):
        own, back = np.unique(grams & ((1 << (8 * (j + 1))) - 1), return_inverse=True)
        levels.append((own, np.bincount(back, weights=n).astype(np.int64)))
    whole = ppm.Model(levels)
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(whole.log10(ppm.codes([t.encode().lower()])).sum(), rel=1e-9)


def slow_repeats(rows):
    first, want = {}, []
    ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None})
    for i in ids:
        new = set()
        for r in rows:
            if r["doc_id"] != i:
                continue
            b = (r["text"] or "").encode()
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                if w in first:
                    gone[p : p + 50] = True
                new.add(w)
            rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
            spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(b) else 0))
            want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
        first.update(dict.fromkeys(new))
    return sorted(want)


@pytest.mark.parametrize("hot", [1000, 0])
def test_repeats(odd, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CLASSES", hot)
    for df in (odd, docs.limit(60)):
        rows = df.collect()
        got = [tuple(r)[:5] for r in repeats.remove_repeats(df).collect() if r["doc_id"] is not None]
        assert sorted(got) == slow_repeats(rows)
    assert repeats.remove_repeats(empty).count() == 0


def test_nothing_goes_without_the_tree(monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 120, (6, repeats.SNIPPET)).astype(np.uint8)
    rows[4, 5:75], rows[5, 8:70] = rows[1, 5:75], rows[2, 8:70]
    rows[:, repeats.EXTRA : repeats.EXTRA + repeats.K] = 97
    sides, ids, group = np.full((6, 2), repeats.EXTRA, np.uint8), np.arange(6), np.zeros(6, np.uint64)
    found = lambda: (repeats.repeat_parts(rows, sides, ids, group)[0] >= 0).tolist() + repeats.later_members(np.array([False, True, True, False]), np.array([3, 3, 5, 1])).tolist()
    assert found() == [False] * 4 + [True] * 2 + [False, False, True, False]
    monkeypatch.setattr(repeats, "intervals", lambda lcp, least: iter(()))
    assert not any(found())


@pytest.mark.parametrize("hot", [1000, 0])
def test_repeat_groups(odd, docs, empty, hot, monkeypatch):
    """Occurrences of a group are equal strings of several documents, and they cover what goes; copies are one group."""
    monkeypatch.setattr(repeats, "HOT_CLASSES", hot)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    copies = {i: t for i, t in texts.items() if len(t) > 200}
    pair = docs.sparkSession.createDataFrame([(90_000 + i, t.decode()) for i, t in sorted(copies.items())[:5]], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(pair)
    texts |= {r["doc_id"]: r["text"].encode() for r in pair.collect()}
    groups = defaultdict(set)
    for r in repeats.repeat_groups(df).collect():
        groups[r["group_id"], r["length"]].add((r["doc_id"], r["start"]))
    covered = defaultdict(lambda: np.zeros(0, bool))
    for (_, n), members in groups.items():
        assert n >= repeats.MIN_BYTES and len({texts[i][a : a + n] for i, a in members}) == 1 and len({i for i, _ in members}) > 1
        least = min(i for i, _ in members)
        for i, a in members:
            if i > least:
                if not len(covered[i]):
                    covered[i] = np.zeros(len(texts[i]), bool)
                covered[i][a : a + n] = True
    gone = {r["doc_id"]: r["spans"] for r in repeats.remove_repeats(df).collect()}
    for i, spans in gone.items():
        want = np.zeros(len(texts[i]), bool)
        for x in spans:
            want[x["start"] : x["stop"]] = True
        assert (want == (covered[i] if len(covered[i]) else np.zeros(len(texts[i]), bool))).all()
    for i in sorted(copies)[:5]:
        assert any(n >= 100 and {j for j, _ in m} >= {i, 90_000 + i} for (_, n), m in groups.items())
    assert repeats.repeat_groups(empty).count() == 0


def test_maximal_repeats():
    rng = np.random.default_rng(5)
    rows = rng.integers(97, 99, (40, repeats.SNIPPET)).astype(np.uint8)
    rows[7:20, 10:70] = rows[3, 10:70]
    lo, hi = np.zeros(40, np.int64), np.full(40, repeats.SNIPPET)
    found = {(n, frozenset(zip(r.tolist(), a.tolist(), strict=True))) for n, r, a in repeats.maximal_repeats(rows, lo, hi)}
    assert any(n >= 60 and len(m) >= 14 for n, m in found)
    for n, members in found:
        assert len({rows[r, a : a + n].tobytes() for r, a in members}) == 1
        assert members == {(r, a) for r in range(40) for a in range(repeats.SNIPPET - n + 1) if rows[r, a : a + n].tobytes() == rows[min(members)[0], min(members)[1] : min(members)[1] + n].tobytes()}


def test_bpe(odd, docs, empty):
    enc = bpe.encoding(*bpe.default_files())
    for df in (odd, docs):
        for r, want in zip(bpe.encode_table(df, *bpe.default_files()).collect(), df.collect(), strict=True):
            ids = enc.encode_ordinary(want["text"] or "")
            assert r["doc_id"] == want["doc_id"] and r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((want["text"] or "").encode()).hexdigest()
    rng = random.Random(2)
    chars = ["a", "é", "1", " ", "  ", "\n", "'s", "!", "　", "中", "\r", "\t", "\x0b", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u180e", "\u200b", "\u2028", "\ufeff"]
    for _ in range(3000):  # safe boundaries change no id
        t = "".join(rng.choice(chars) for _ in range(60))
        assert [x for p in bpe.pieces(t, 5) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    tail = "".join(rng.choice(chars) for _ in range(400)) + " b" * 30
    for n in (99_980, 99_990, 99_998):  # pieces of the size in use
        assert bpe.encode("a" * n + tail, enc).tolist() == enc.encode_ordinary("a" * n + tail)
    assert bpe.encode_table(empty, *bpe.default_files()).count() == 0


def slow_near(rows, k, percent=80):
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near(odd, docs, empty, k):
    for df in (odd.where("doc_id IS NOT NULL"), docs):
        want = slow_near(df.collect(), k)
        for r in near.near_duplicates(df, k).collect():
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near.near_duplicates(odd, k).count() == odd.count() and near.near_duplicates(empty, k).count() == 0


@pytest.mark.parametrize("percent", [80, 65])
def test_near_tiles(odd, docs, monkeypatch, percent):
    """Buckets in tiles, and many pairs on either side of the threshold for round two."""
    monkeypatch.setattr(near, "TILE", 2)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = [" ".join(w if rng.random() > 0.02 * (i % 12) else f"x{rng.randrange(99)}" for w in base) for i in range(70)]
    df = odd.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_near(df.collect(), 2, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df, 2, percent).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 70


@pytest.mark.parametrize("k", [2, 5])
def test_near_recall(spark, k):
    """Every row whose id is divisible by 20 against all rows of sf0.01: no partner is lost."""
    df = common.table(spark, "/root/testdata/sf0.01", "documents")
    sets = {}
    for r in df.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    pairs = [(i, j) for i in sets if i % 20 == 0 for j in sets if i != j and sets[i] and 100 * (n := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    found = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df, k).collect()}
    assert len(pairs) > 5 and all(found[i] == found[j] for i, j in pairs)


def test_near_misses_make_no_pairs(spark, monkeypatch):
    """A large group of texts that only just miss the threshold: pairs to confirm grow with its
    members, not with their square, and the components are right, a link across two of them too."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = [list(base) for _ in range(400)]
    for i, words in enumerate(texts):
        for at in rng.sample(range(120), 5):
            words[at] = f"x{i}_{at}"
    texts += [[*texts[399][:119], "last"], [*texts[7][:118], "two", "more"]]
    df = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(texts)], "doc_id long, text string")
    tested, confirmed = [], near.confirmed

    def counting(pairs, *args):
        tested.append(pairs.count())
        return confirmed(pairs, *args)

    monkeypatch.setattr(near, "confirmed", counting)
    monkeypatch.setattr(near, "TILE", 500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df, 2).collect()}
    assert got == slow_near(df.collect(), 2) and len({c for _, c in got.values()}) > 200
    assert sum(tested) < 20 * len(texts)


def test_in_common():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 70)).astype(np.uint64)) for _ in range(40)]
    for columns in (near.COLUMNS, 3):
        for left, right in ((slice(0, 40), slice(0, 40)), (slice(0, 9), slice(9, 40))):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(near, "COLUMNS", columns)
                got = near.in_common(sets, left, right)
            for i in range(left.stop):
                for j in range(max(i + 1, right.start), 40):
                    assert got[i, j - right.start] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    pairs = [(a, b) for a, b in pairs if a != b]
    comp = {x: x for p in pairs for x in p}
    for _ in comp:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["component"] for r in near.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == comp


def test_estimate(spark):
    every = np.random.default_rng(9).integers(0, 2**64, 1100, dtype=np.uint64)
    a, b = (near.signature(x, near.LONG_PERMS) for x in (every[:1000], every[100:]))
    row = spark.createDataFrame([(near.packed(a).tolist(), near.packed(b).tolist())], "a array<long>, b array<long>")
    same_bits = ((a & 15) == (b & 15)).mean()
    got = row.select(near.estimate(F.col("a"), F.col("b"), near.LONG_PERMS)).first()[0]
    assert got == pytest.approx((same_bits - 1 / 16) / (15 / 16)) and abs(got - 900 / 1100) < 0.07


def test_perfect_hash_and_history(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 5000, 40_000):
        digest = rng.integers(0, 256, (n, 32)).astype(np.uint8)
        displace, slot = exact.build(digest)
        assert sorted(slot) == list(range(n)) and (exact.slots(digest, displace, n) == slot).all()
        other = rng.integers(0, 256, (100, 32)).astype(np.uint8)
        at = exact.slots(other, displace, n)
        assert ((at >= 0) & (at < n)).all()
    old = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(11, "ab"), (12, "d"), (13, "d "), (14, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["member"]) for r in exact.dedup(new, exact.winners(exact.digests(old))).collect()}
    assert got == {11: (1, False, True), 12: (13, False, False), 13: (13, True, False), 14: (14, True, False)}


@pytest.mark.parametrize("shard_keys", [exact.SHARD_KEYS, 7])
def test_exact_paths(odd, docs, monkeypatch, shard_keys):
    """Members and nonmembers occur, and members both yield to their slot's winner and replace it."""
    monkeypatch.setattr(exact, "SHARD_KEYS", shard_keys)
    same(exact.dedup(docs).drop("member"), duck().sql(exact.OP6_SQL))
    rows = {r["doc_id"]: r for r in exact.dedup(docs.union(docs.selectExpr("doc_id + 100000", "text || ' '", "lang", "source", "n_chars"))).collect()}
    old = {r["doc_id"]: r["old"] for r in docs.sparkSession.createDataFrame([(i,) for i in rows], "doc_id long").select("doc_id", (F.xxhash64("doc_id") % 2 == 0).alias("old")).collect()}
    assert {r["member"] for r in rows.values()} == {True, False}
    moves = {(old[i], old[r["keep_id"]]) for i, r in rows.items() if i != r["keep_id"]}
    assert moves == {(True, True), (True, False), (False, True), (False, False)}


def test_keep_documents_repeated_rows(spark, docs):
    rows = [(1, "x y"), (1, "x y"), (2, "p q"), (2, "r"), (3, "r "), (4, "pq"), (None, "n"), (None, "n"), (None, "x  y  z"), (5, None), (5, "")]
    df = spark.createDataFrame([(i, t, 7, "k", "s") for i, t in rows], "doc_id long, text string, kept_id int, kept_digest string, kept_points string")
    got = exact.keep_documents(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, "x y"), (2, "p q"), (3, "r "), (None, "n"), (None, "x  y  z"), (5, None)], key=str) or sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, "x y"), (2, "p q"), (3, "r "), (None, "n"), (None, "x  y  z"), (5, "")], key=str)
    near_kept = near.keep_documents(df.withColumn("KEPT_ID_", F.lit(1)))
    assert near_kept.columns == [*df.columns, "KEPT_ID_"] and near_kept.count() > 0


def farthest(rows, weights, horizon):
    """The farthest that a source is from its target, in blocks, at any slot before the horizon. Between
    its own slots a source only falls behind, so each slot is looked at just before and after."""
    total, worst, own = sum(map(Fraction, weights)), Fraction(0), defaultdict(list)
    for i, *_, t in rows:
        if t < horizon:
            own[i].append(t)
    for i, w in enumerate(weights):
        share = Fraction(w) / total
        ends = [abs(n - t * share) for n, t in enumerate(own[i])] + [abs(n + 1 - (t + 1) * share) for n, t in enumerate(own[i])]
        worst = max([worst, abs(len(own[i]) - horizon * share), *ends])
    return worst


@pytest.mark.parametrize("weights, blocks", [
    ([1, 2, 3], [40, 80, 120]), ([997, 1, 2], [2000, 3, 5]), ([math.sqrt(160_000), math.sqrt(161_600)], [10_000, 10_100]),
    ([1e6, 1.5, 3.0], [3000, 2, 2]), ([0.1, 0.2, 0.7, 1e-3], [300, 600, 2100, 3]), ([1.0] * 7, [9] * 7), ([1e-300, 1.0], [2, 5]),
])
def test_schedule(weights, blocks):
    rows, horizon = mixing.schedule(mixing.whole_weights(weights), blocks)
    total = sum(map(Fraction, weights))
    assert sorted((i, b) for i, b, *_ in rows) == [(i, b) for i, n in enumerate(blocks) for b in range(n)]
    assert len({t for *_, t in rows}) == len(rows) and horizon > 0
    assert {t for *_, t in rows if t < horizon} == set(range(min(horizon, len(rows))))  # no slot is empty before a source runs out
    for i, b, release, deadline, t in rows:
        assert release == min(mixing.LAST, math.floor(b * total / Fraction(weights[i]))) and deadline == min(mixing.LAST, math.ceil((b + 1) * total / Fraction(weights[i])))
        assert release <= t and (t < deadline or t >= horizon)
    assert farthest(rows, weights, min(horizon, len(rows))) < 1


def test_many_sources_stay_on_target():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 50) for _ in range(20_000)]
    weights = [math.sqrt(n) for n in sizes]
    rows, horizon = mixing.schedule(mixing.whole_weights(weights), sizes)
    assert len(rows) == sum(sizes) and farthest(rows, weights, horizon) < 1


def test_mix(odd, empty, spark):
    got = mixing.mix(odd, {"s0": 3, "s1": 1, None: 1}).collect()
    assert len(got) == odd.count() and len({(r["mix_slot"], r["mix_place"]) for r in got}) == len(got)
    assert sorted(map(str, mixing.mixed_documents(odd).collect())) == sorted(map(str, odd.collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    for df in (odd, empty):
        found = mixing.mix(df.select("doc_id", "source"))
        same(found.select("doc_id", "source", *(F.col(f"mix_{k}").alias(k) for k in ("block", "release", "deadline", "slot", "place", "on_target"))), duck(df).sql(mixing.OP5_SQL))
    none = mixing.mix(odd, {"s0": 3, "s1": 0}).collect()
    assert all((r["mix_slot"] is None) == (r["source"] != "s0") and (r["source"] == "s0" or not r["mix_on_target"]) for r in none)
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(odd, {"s0": -1})
    taken = odd.selectExpr("*", "1 AS mix_slot", "2 AS share", "3 AS slots", "4 AS mix_key", "5 AS mix_id", "6 AS mix_chunk", "7 AS mix_place", "8 AS mix_row")
    assert mixing.mix(taken).columns == [*taken.columns, *(common.fresh(taken, c) for c in mixing.COLUMNS)]
    assert sorted(map(str, mixing.mixed_documents(taken).collect())) == sorted(map(str, taken.collect()))


def test_whole_weights():
    assert mixing.whole_weights([3.0, 6.0, 9.0]) == [1, 2, 3] and mixing.whole_weights([]) == []
    assert mixing.whole_weights([0.5, 0.75]) == [2, 3] and mixing.whole_weights([1e6, 1.5, 3.0]) == [2_000_000, 3, 6]
    roots = [math.sqrt(2), math.sqrt(3)]
    a, b = mixing.whole_weights(roots)
    assert Fraction(a, b) == Fraction(roots[0]) / Fraction(roots[1])


def test_more_blocks_than_slots(spark, monkeypatch):
    """Blocks grow where their number would not fit the schedule; a place is still one row's own."""
    monkeypatch.setattr(mixing, "MOST_SLOTS", 20)
    docs = spark.createDataFrame([(j * 100 + i, f"h{i}") for i in range(40) for j in range(40 + i)], "doc_id long, source string")
    got = mixing.mix(docs, {f"h{i}": 10.5 + i for i in range(40)}).collect()
    assert len(got) == docs.count() and len({(r["mix_slot"], r["mix_place"]) for r in got}) == len(got)
    assert max(r["mix_place"] for r in got) > mixing.BLOCK_DOCS and len({r["mix_slot"] for r in got}) == 40


def test_repeated_ids_have_own_places(spark):
    docs = spark.createDataFrame([(i % 30, f"text {i}", "a" if i % 3 else None) for i in range(90)] + [(None, "x", "b"), (None, "y", "b")], "doc_id long, text string, source string")
    got = mixing.mixed_documents(docs, keep_place=True).collect()
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(str(tuple(r)) for r in docs.collect())
    assert len({(r["mix_slot"], r["mix_place"]) for r in got}) == len(got)


def slow_language(rows, train):
    """Profiles, ranks and distances by the definition, over strings."""

    def grams(text):
        text = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in text:
            text = text.replace("  ", " ")
        found = Counter(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)) if text.strip() else Counter()
        found.pop(" ", None)
        return found

    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[: langid.PROFILE]]
    counts = defaultdict(Counter)
    for r in train:
        counts[r["lang"]].update(grams(r["text"] or ""))
    model = {k: {g: i for i, g in enumerate(top(c))} for k, c in counts.items() if c}
    for r in rows:
        own = top(grams(r["text"] or ""))
        far = {k: sum(abs(i - m[g]) if g in m else langid.PROFILE for i, g in enumerate(own)) for k, m in model.items()}
        best = min(sorted(far), key=far.get) if own and far else "und"
        yield (best, 1 - far[best] / (langid.PROFILE * len(own)), far[best]) if best != "und" else ("und", 0.0, None)


def test_language_by_definition(odd, docs):
    for df in (odd, docs):
        rows = df.collect()
        train = [r for r in rows if r["lang"] is not None]
        got = [(r["lang_pred"], r["score"], r["distance"]) for r in langid.predict(df, langid.profiles(df.where("lang IS NOT NULL"))).collect()]
        want = list(slow_language(rows, train))
        assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]
        assert [b for _, b, _ in got] == pytest.approx([b for _, b, _ in want])


def test_whole_license_texts(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(f"q{rng.randrange(999)}" for _ in range(n))
    names = sorted(licenses.TEMPLATES)
    rows = [(i, f"{filler(i % 40)} {licenses.TEMPLATES[n].upper() if i % 2 else licenses.TEMPLATES[n]} {filler(30)}") for i, n in enumerate(names)] + [(100, filler(300)), (101, licenses.TEMPLATES["mit-text"][:400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(docs)
    same(found, duck(docs).sql(licenses.OP8_SQL))
    whole = {(r["doc_id"], r["license"]): (r["n_parts"], r["of_parts"]) for r in licenses.whole_licenses(found).collect()}
    for i, n in enumerate(names):
        parts = sum(name == n for name, *_ in licenses.segments(licenses.TEMPLATES))
        assert whole[i, n] == (parts, parts)
    assert not any(i == 100 for i, _ in whole) and 0 < whole[101, "mit-text"][0] < whole[101, "mit-text"][1]
    own = spark.createDataFrame([("mine", "you may do with this what you like"), (None, "x")], "license string, text string")
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame([(1, "So you may do with this what you like!")], "doc_id long, text string"), own).collect()] == [(1, "mine")]
    assert licenses.scan(docs, {}).count() == 0 and licenses.whole_licenses(licenses.scan(docs, {}), {}).count() == 0


def test_any_text_matches_itself(spark):
    """Templates in any letters, and many of them: each is found in a document that is this very text."""
    rng = random.Random(8)
    odd = {"pt": "LICENÇA PÚBLICA GERAL DO SOFTWARE LIVRE", "tr": "İZİN VERİLİR HER KULLANIM İÇİN", "ru": "ПУБЛИЧНАЯ ЛИЦЕНЗИЯ НА СВОБОДНОЕ ПО 2", "de": "Straße GROẞ und weiter so"}
    many = {f"t{i}": " ".join(f"w{rng.randrange(3000)}" for _ in range(500)) for i in range(100)}
    templates = odd | many
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(templates.values())], "doc_id long, text string")
    found = {(r["doc_id"], r["license"]): r for r in licenses.whole_licenses(licenses.scan(docs, templates), templates).collect()}
    for i, n in enumerate(templates):
        assert found[i, n]["n_parts"] == found[i, n]["of_parts"]
    with pytest.raises(ValueError, match="under 3 words"):
        licenses.scan(docs, {"short": "two words"})


def test_template_bound(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_SHINGLES", 3)
    with pytest.raises(ValueError, match="shingles of templates"):
        licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    monkeypatch.setattr(licenses, "MOST_SHINGLES", 1 << 20)
    monkeypatch.setattr(licenses, "BROADCAST_BANDS", 0)  # the shuffled join finds the same
    docs = spark.createDataFrame([(1, licenses.TEMPLATES["isc-text"]), (2, None)], "doc_id long, text string")
    same(licenses.scan(docs), duck(docs).sql(licenses.OP8_SQL))


def test_hosts(spark):
    """A host that fails as a whole, a small one whose rate is shrunk, a null one, and one with a few failures."""
    good, bad = " ".join(f"w{i}" for i in range(60)), "a b"
    rows = [("bad", 38, 2), (None, 40, 3), ("small", 1, 1), *((f"h{i}", 1, 30 + i) for i in range(12))]
    docs, n = [], 0
    for host, fail, ok in rows:
        for t in [bad] * fail + [good] * ok:
            n += 1
            docs.append((n, f"{t} {n}" if t is good else t, None, host, 0, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, bad_host int")
    got = quality.documents_rules(df)
    same(got.drop("host"), duck(df).sql(quality.OP4_SQL))
    lost = {r["host"] for r in got.where("NOT base_failed AND NOT kept").collect()}
    assert lost == {"bad", None}
    kept = quality.keep_documents(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got.where("kept").collect())


def test_language(odd, empty, spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in langid.op9_language_id(spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    model = langid.profiles(odd.where("lang IS NOT NULL"))
    found = [(r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()]
    assert found[0][0] == found[1][0] == found[2][0] == "und" and all(0 <= s <= 1 for _, s in found)
    assert langid.predict(odd, {}).where("lang_pred <> 'und'").count() == 0 and langid.predict(empty, model).count() == 0


def test_urls(spark):
    rows = [(1, "https://WWW.example.com/en/x?q"), (2, "http://example.com/en/"), (3, "http://a.net/es/1#t"), (4, "http://b.net/de/"), (5, None), (6, "no scheme"), (7, "http://x.com"), (None, "http://example.com/de/1"), (2, "http://example.com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.filter_urls(pages).collect()), key=str)
    assert (1, "www.example.com", "/en/x", "www.example.com/en/") in got and got.count((2, "example.com", "/en/", "example.com/en/")) == 2
    assert (3, "a.net", "/es/1", "net/es/") in got and (4, "b.net", "/de/", None) in got and (5, "", "", None) in got and (6, "", "", None) in got
    assert (7, "x.com", "", None) in got and (None, "example.com", "/de/1", "com/") in got and len(got) == len(rows)
    assert urls.filter_urls(pages.limit(0)).count() == 0
    more = [(i, f"https://s{i % 7}.com/{'buy-cheap' if i % 2 else 'news/story'}-{i}") for i in range(60)] + [(100 + i, f"http://m{i}.net/{'es' if i % 2 else 'de'}/buy-cheap-{i}") for i in range(60)]
    for some in (rows + more, more[:60], [r for r in more[60:]], rows[4:6]):  # both classes, accepted urls alone, rejected ones alone, neither
        df = spark.createDataFrame(some, "page_id long, url string")
        c = duckdb.connect()
        c.register("frame", df.toArrow())
        c.sql("CREATE TABLE pages AS SELECT * FROM frame")
        found = urls.filter_urls(df)
        same(found.drop("score"), c.sql(urls.OP10_SQL))
        assert found.where("verdict IS NULL").count() == 0
    verdicts = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows + more, "page_id long, url string")).collect()}
    assert verdicts[5] in ("allow", "block") and sum(verdicts[100 + i] == "block" for i in range(0, 60, 2)) > 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = common.table(spark, DATA, "documents").collect()
    m = {r["doc_id"]: r for r in quality.op4_quality_rules(spark, DATA).collect()}
    rows = [r for r in rows if m[r["doc_id"]]["kept"]]
    best = {}
    for r in rows:
        best.setdefault(exact.normalised(r["text"]), []).append((-len(r["text"]), r["doc_id"]))
    ids = {min(v)[1] for v in best.values()}
    rows = [r for r in rows if r["doc_id"] in ids]
    ids = {i for i, (_, c) in slow_near(rows, 5).items() if i == c}
    enc = bpe.encoding(*bpe.default_files())
    want = sorted((r["doc_id"], len(enc.encode_ordinary(r["text"]))) for r in rows if r["doc_id"] in ids)
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want


def test_pipeline_on_odd_tables(spark, odd, empty, tmp_path):
    """Nulls, repeated rows, clashing names and an empty table, through all stages."""
    import corpus_pipeline

    words = " ".join(f"v{i}" for i in range(70))
    more = spark.createDataFrame([(100, words), (100, words), (101, words + " "), (102, words.replace("v6", "u6")), (None, words + " null")], "doc_id long, text string")
    names = ["kept_id", "mix_slot", "mix_key", "share", "mix_id", "bad_host", "rejected", "own", "times", "digest"]
    for name, df in (("odd", odd.unionByName(more, allowMissingColumns=True)), ("empty", empty)):
        df.withColumns({n: F.lit(k) for k, n in enumerate(names)}).write.parquet(str(tmp_path / f"{name}/documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        if name == "empty":
            assert not got
            continue
        ids = Counter(r["doc_id"] for r in got)
        assert ids[101] == 1 and not ids[100] and ids[102] == 1 and ids[None] == 2 and set(ids.values()) == {1, 2}
        assert all(r["mix_slot"] is not None for r in got)


def test_pipeline_carries_the_mix(spark, docs):
    """Each row of run() has the slot, place and on_target that SQL gives the documents that came to mixing."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA).select("doc_id", *mixing.PLACE).collect()
    kept = docs.where(F.col("doc_id").isin([r["doc_id"] for r in got]))
    want = duck(kept).sql(mixing.OP5_SQL).select("doc_id, slot, place, on_target").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20 and len({r["mix_slot"] for r in got}) > 1
