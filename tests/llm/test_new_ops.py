import html
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import articles, infill, lots, queries

from .test_ops import DATA, SCHEMA, duck, odd_rows, same


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shop_duck(d):
    import duckdb

    c = duckdb.connect()
    for t in ("sales", "sale_lines", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_return_lots"])
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), shop_duck(DATA).sql(queries.ORACLE_SQL[name]))


UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def test_cuts_of_a_batch():
    rng = random.Random(11)
    texts = ["", " ", "a", " a", "a ", "\t\n a  b\r", "é ü\u00a0x", "x" * 70_000 + " y" * 40_000] + ["".join(rng.choice("ab é\n\t漢") for _ in range(rng.randrange(40))) for _ in range(400)]
    first, second = (np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2))
    whole = pa.array(texts, pa.string())
    for at, size in ((0, len(texts)), (3, 100), (7, 0)):  # slices of a batch have offsets that do not start at 0
        n, cuts, chars = infill.cut(whole.slice(at, size), first[at : at + size], second[at : at + size])
        found = [p.to_pylist() for p in infill.parts(whole.slice(at, size), cuts)]
        for i, t in enumerate(texts[at : at + size]):
            units = UNIT.findall(t)
            a, b = sorted((int(first[at + i]) % (len(units) + 1), int(second[at + i]) % (len(units) + 1)))
            assert n[i] == len(units) and [p[i] for p in found] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
            assert chars[i].tolist() == [len(p[i]) for p in found]


def test_fill_in_middle_on_odd_rows(spark, odd, empty):
    marked = spark.createDataFrame([(i, f"ab <P> {i} cd" if i % 2 else "w" * 300_000 + " x " * 500_000) for i in range(30, 40)], "doc_id long, text string")
    for docs in (odd, empty, marked):
        found = infill.fill_in_middle(docs)
        if docs is not marked:
            same(found.selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(output, 256) AS o"), duck(docs).sql(f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256 AS o FROM ({infill.OP11_SQL})"))
        back = found.select("doc_id", infill.restored(found.output, found.form).alias("text"))
        assert sorted(map(str, back.collect())) == sorted(map(str, docs.selectExpr("doc_id", "coalesce(text, '') AS text").collect()))
    assert {r["form"] for r in infill.fill_in_middle(marked).where("n < 10").collect()} == {"plain"}
    every = infill.fill_in_middle(odd, rate=100, spm_rate=0)
    assert {r["form"] for r in every.where("n > 0").collect()} == {"psm"}


def page(body, article=True):
    return f"<html><head><title>t</title><script>if (a < b) x('</p>');</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("body, want", [
    ("<nav>menu</nav><article><h1>T &amp; t</h1><p>one<br>two <b>th</b>ree</p></article><footer>f</footer>", "T & t\none two three"),
    ("<header><h1>site</h1></header><main><p>a<p>b</main><aside>s</aside>", "a\nb"),
    ("<article><header><h1>T</h1>by me</header><p>a</p><section id=comments><article>first!</article></section><footer>f</footer></article>", "T\na"),
    ('<article><p>x</p><div class="ad">buy</div><form>q<input></form><p class="cookie-notice">c</p><p>y &lt;b&gt; 1 < 2</p></article>', "x\ny <b> 1 < 2"),
    ("<article><p>kept <!-- not --> all<script>no</script></p><style>p{}</style>", "kept all"),
    ('<div class="sidebar">s</div><div class="post-content"><p>long text</p></div>', "long text"),
    ("<p>plain <a href='x'>link</a> text here<p><a href=y>all a link</a>", "plain link text here"),
    ("<article><p hidden>h</p><p style='display:none'>n</p><p>v</p><!-- never closed", "v"),
    ('<p title="a > b">q</p><p title="open>r', "q\nr"),
    ("", ""), ("  \n ", ""), ("<script>never closed <p>x", ""),
])
def test_blocks(spark, body, want):
    rows = spark.createDataFrame([(1, "http://a/x", page(body))], "page_id long, url string, html string")
    got = articles.extract_articles(rows).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [(want, len(want))]


def plain_repeats(rows, least):
    """Per page, the number of blocks outside articles of which repeated strings cover half, by definition."""
    words = []
    for host, source in rows:
        spans, stream = [], []
        for text, level, _ in articles.blocks(source or ""):
            own = text.split(" ") if level not in (articles.ARTICLE, articles.MAIN) else []
            spans.append((len(stream), len(stream) + len(own)))
            stream += own
        words.append((host, source, spans, stream))
    where = defaultdict(set)
    for host, source, _, stream in words:
        for i in range(len(stream) - least + 1):
            where[host, tuple(stream[i : i + least])].add(source)
    counts = []
    for host, _, spans, stream in words:
        covered = set()
        for i in range(len(stream) - least + 1):
            if len(where[host, tuple(stream[i : i + least])]) > 1:
                covered |= set(range(i, i + least))
        counts.append(sum(a < b and 2 * sum(k in covered for k in range(a, b)) >= b - a for a, b in spans))
    return counts


@pytest.mark.parametrize("size", [1, 3000, 1 << 22])
def test_repeated_runs(spark, size):
    """However a host's pages are dealt over arrays, the repeated runs are those of the whole host."""
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n))
    notices = [text(rng.randrange(6, 30)) for _ in range(8)]
    rows = []
    for i in range(90):
        story = [text(rng.randrange(9, 40)) for _ in range(rng.randrange(4))]
        around = [rng.choice(notices) for _ in range(rng.randrange(4))]
        parts = around[:2] + story + around[2:]
        body = "".join(f"<p>{p}</p>" for p in parts) if i % 3 else f"<div>{notices[0]}</div><article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"
        rows.append((i, f"http://h{i * i % 4}.org/{i}", page(body)))
    rows += [(90, None, None), (None, "http://h0.org/", ""), rows[4], (91, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = articles.extract_articles(pages, size).collect()
    hosts = [re.sub("^.*://([^/]*).*", r"\1", u) if u else "" for _, u, _ in rows]
    want = plain_repeats([(h, s) for h, (_, _, s) in zip(hosts, rows, strict=True)], articles.LEAST)
    assert sorted((str(r["page_id"]), r["n_repeated"]) for r in got) == sorted((str(i), n) for (i, _, _), n in zip(rows, want, strict=True))
    assert sum(want) > 30
    texts = {r["page_id"]: r["text"] for r in got}
    for i, _, source in rows[:90]:
        if i % 3 == 0:  # an article is kept, what it shares with others too
            assert texts[i] == "\n".join(re.findall("<p>(.*?)</p>", source))
    assert articles.extract_articles(pages.limit(0)).count() == 0


def test_articles_of_the_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in articles.extract_articles(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", re.sub("</?b>", "", inner)))
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_a_long_page(spark):
    """A page of several MB, and one of deep and broken markup."""
    long = "<article>" + "<p>" + "word " * 300_000 + "</p>" * 3 + "</article>"
    deep = "<div>" * 20_000 + "text of the page" + "</div><a \"" * 2000
    got = {r["page_id"]: r for r in articles.extract_articles(spark.createDataFrame([(1, "u", long), (2, "u", deep)], "page_id long, url string, html string")).collect()}
    assert got[1]["n_chars"] == 5 * 300_000 - 1 and got[2]["text"].startswith("text of the page")


def plain_match(lines, sales):
    """One return after the other, one unit's lot at a time."""
    client = dict(sales)
    found, goods = [], []
    for sale, no, item, q, amount, discount, flag, day in lines:
        if sale is None or client.get(sale) is None or None in (item, q, amount, day):
            continue
        h = zlib.crc32(f"{sale}:{no}".encode())
        goods.append((client[sale], item, day, sale, no, q, int(np.floor(100 * amount + 0.5)), int(np.floor(100 * discount + 0.5)), flag, h))
    groups = defaultdict(list)
    for g in goods:
        groups[g[:2]].append(g)
    for key, own in groups.items():
        left = [[*g, g[5]] for g in sorted(own, key=lambda g: (-g[2], *g[3:8]))]
        back = sorted((g[2] + 1 + g[9] % 13, *g[3:8], 1 + g[9] % (g[5] + 10)) for g in own if g[8] == "returned")
        for number, (day, sale, no, q, c, d, wanted) in enumerate(back, 1):
            done, piece = 0, 0
            refund = lambda n: Fraction(n * c * (100 - d), 100 * q).__floor__()  # noqa: B023, E731
            for lot in left:
                units = min(lot[-1], wanted - done) if lot[2] < day else 0
                if units:
                    piece, taken = piece + 1, lot[5] - lot[-1]
                    lot[-1] -= units
                    money = refund(done + units) - refund(done)
                    cost = (taken + units) * lot[6] // lot[5] - taken * lot[6] // lot[5]
                    found.append((*key, number, piece, day, sale, lot[3], lot[4], units, lot[-1], money, money - cost))
                    done += units
            if done < wanted:
                found.append((*key, number, piece + 1, day, sale, None, None, wanted - done, None, refund(wanted) - refund(done), None))
    return found


LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, discount double, flag string, shipped int"


@pytest.mark.parametrize("keys", [1, 6])
def test_return_lots(spark, keys):
    """Against one return at a time: hot keys, ties, repeated rows and rows with nulls."""
    rng = random.Random(keys)
    lines = [(rng.randrange(40), rng.randrange(1, 4), rng.randrange(keys), rng.choice([1, 2, 7, 300]), rng.choice([0.1, 2.45, 19.99]), rng.choice([0.0, 0.07]), rng.choice(["returned", "kept"]), 19700 + rng.randrange(25)) for _ in range(700)]
    lines += [lines[0]] * 30 + [(1, 1, None, 1, 1.0, 0.0, "returned", 19700), (None, 1, 0, 1, 1.0, 0.0, "returned", 19700), (1, 1, 0, None, 1.0, 0.0, "returned", 19700), (1, 1, 0, 1, None, 0.0, "returned", 19700), (1, 1, 0, 1, 1.0, 0.0, "returned", None)]
    sales = [(i, i % keys if i != 3 else None) for i in range(38)] + [(None, 1)]
    table = spark.createDataFrame(lines, LINES).selectExpr("*", "timestamp_seconds(shipped * 86400L) AS shipped_at", "1 AS client_id", "2 AS units")
    own = spark.createDataFrame([(*s, "x") for s in sales], "sale_id long, client_id long, flag string")
    found = lots.returned_lots(table, own).select("client_id", "item_id", "return_no", "piece_no", "return_day", "return_sale_id", "lot_sale_id", "lot_line_no", "units", "lot_left", "refund_cents", "margin_cents")
    want = plain_match(lines, sales)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and len(want) > 300
    assert lots.returned_lots(table.limit(0), own).count() == 0 and lots.returned_lots(table.where("flag = 'kept'"), own).count() == 0


def test_allot_by_rule():
    supply, demand = [(1, 5), (4, 3), (9, 2)], [(3, 4), (6, 3), (9, 1)]
    assert lots.allot(supply, demand) == [(4, 6, 0, 0, 3), (1, 3, 0, 0, 4), (1, 9, 4, 0, 1)]
    assert lots.allot(supply, demand, "fifo") == [(1, 3, 0, 0, 4), (1, 6, 4, 0, 1), (4, 6, 0, 1, 2), (4, 9, 2, 0, 1)]
    assert lots.allot([], demand) == [(None, 3, 0, 0, 4), (None, 6, 0, 0, 3), (None, 9, 0, 0, 1)] and lots.allot(supply, []) == []


def test_running_sums_across_tasks(spark):
    """A segment that fills many tasks, of rows that are all alike."""
    from lodestar.sources import store

    rows = spark.range(5000).selectExpr("CAST(id % 50 = 0 AS int) AS k", "7 AS day", "3L AS units", "1 AS o")
    got = lots.running(store.stored(rows), ["k", "day"], ["o"]).collect()
    for k, n in ((0, 4900), (1, 100)):
        assert sorted((r["rank"], r["place"]) for r in got if r["k"] == k) == [(i, 3 * i) for i in range(n)]
