"""Main text of web pages by a suffix array per host (operator 12).

A page is read into blocks of text with what its markup says of them. The words
outside article elements are concatenated, page after page of a host, with
a separator of its own after each, and sorted into a suffix array by
doubling, up to LEAST words deep. An interval of suffixes that share LEAST words
and lie in distinct pages is a repeated string; runs are what such strings
cover. A block covered by half or more is boilerplate and goes, and the unique
runs stay, subject to what the markup says: text in menus, headers, footers, sidebars,
notices, adverts, forms and comments is never kept; where a page has an
article element, or else a main element, or else one named as content, only
text in it is kept; and text in an article or main element is kept though it
repeats, for copies of an article are no boilerplate. A page whose
undecided text repeats as a whole is a copy too and keeps it.

Hosts are dealt over arrays of about BLOCK_BYTES of html: small hosts share one (their strings
never match across hosts), large ones are split by page. The arrays of a split host send the
digests of their strings outside articles to each other, by a shuffle of
counts per digest, so that a string that repeats only across arrays is found as
well. Pages of the same html count as one.

Edge cases: a null or empty html has an empty text; pages without a host form
one host; page_id and url may be null and pass through; repeated rows give repeated rows; broken
markup never fails: unclosed elements end with what holds them, an unclosed comment or script
with the page; very long pages pass whole; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import html as html_references
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, urls

#: Words that a repeated string has at least.
LEAST = 8
BLOCK_BYTES = 4 << 20
#: Large hosts up to so many are broadcast (a name and a number each); more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
SALTS = 64

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that are closed by their end tags, and bound the text in them.
BOXES = frozenset("div section article main nav header footer aside form ul ol dl menu table tbody thead tfoot tr figure blockquote pre details dialog button select template noscript fieldset head body object svg canvas audio video center address map search".split())
#: Elements that start a block of text and may end without an end tag.
LEAVES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 hr figcaption caption summary legend option optgroup title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Boxes that an end tag of a plain box doesn't reach across.
FIRM = frozenset("article main nav header footer aside form".split())
NEVER = frozenset("nav footer aside form menu dialog button select template noscript head object svg canvas audio video search".split())
#: Words in class, id or role that name what is no article.
NEVER_NAMES = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead header cookie cookies consent gdpr notice notices newsletter subscribe signup popup modal overlay comment comments disqus reply replies respond share sharing social related recommended recommendations widget toolbar login search pagination pager copyright complementary contentinfo".split())
CONTENT_NAMES = frozenset("article content post entry story main body".split())
ARTICLE, MAIN, NAMED, OTHER, OUT = 1, 2, 3, 4, 9


def _names(attributes: str) -> set[str]:
    found = " ".join("".join(m) for m in ATTRIBUTE.findall(attributes))
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()))


def _place(name: str, attributes: str, above: int, level: int) -> tuple[int, int]:
    """(why a box is no article: 0, 1, or 2 for all but headings; level) of a box in one with these."""
    if above == 1:
        return 1, level
    names = _names(attributes) if "=" in attributes else set()
    hidden = bool(attributes) and HIDDEN.search(attributes) is not None
    inside = level in (ARTICLE, MAIN)
    never = names & (NEVER_NAMES - {"header"} if inside else NEVER_NAMES)
    if hidden or name in NEVER or (never and name not in ("body", "main")):
        return 1, level
    if name == "header":
        return (2 if inside else 1), level
    own = ARTICLE if name == "article" else MAIN if name == "main" or "main" in names and "role" in attributes else NAMED if names & CONTENT_NAMES and name in ("div", "section", "td", "table") else OTHER
    return above, min(level, own)


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, level, mostly links) of each block of text; level OUT: never an article's. An empty text marks an article or main element."""
    found: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, int]] = [("", 0, OTHER)]
    parts: list[str] = []
    linked, in_link, leaf, leaf_out, at = 0, False, "", False, 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            _, out, level = stack[-1]
            out = out == 1 or leaf_out or (out == 2 and leaf not in HEADINGS)
            found.append((text, OUT if out else level, 10 * linked > 6 * len(text)))
        parts.clear()
        linked = 0

    while True:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            text = html_references.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not closing:
            if name == "title" and "svg" not in (s[0] for s in stack):
                end_block()
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else len(page)
        elif name in BOXES:
            end_block()
            leaf, leaf_out, in_link = "", False, False
            if not closing:
                if not attributes.endswith("/"):
                    stack.append((name, *_place(name, attributes, stack[-1][1], stack[-1][2])))
                    if stack[-1][1] == 0 and stack[-1][2] in (ARTICLE, MAIN):
                        found.append(("", stack[-1][2], False))  # an article of no text is one, too
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in FIRM and name not in FIRM and name != "body":
                        break
        elif name in LEAVES:
            end_block()
            leaf, in_link = ("" if closing else name), False
            leaf_out = not closing and bool(attributes.strip()) and _place("p", attributes, 0, stack[-1][2])[0] == 1
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = not closing
    end_block()
    return found


def repeated_strings(tokens: np.ndarray, group: np.ndarray, page: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``least`` tokens, starts of their intervals, whether an interval's
    suffixes lie in distinct pages). tokens: non-negative, group: what suffixes must share (a host),
    page: of each token. Every page ends with a token of its own, so no string crosses one."""
    n = len(tokens)
    _, rank = np.unique(group.astype(np.int64) * (int(tokens.max(initial=0)) + 1) + tokens, return_inverse=True)
    width = 1
    while width < least:
        step = min(width, least - width)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        width += step
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) > 0])) if n else np.empty(0, np.int64)
    pages = page[order]
    distinct = np.minimum.reduceat(pages, starts) != np.maximum.reduceat(pages, starts) if n else np.empty(0, bool)
    return order, starts, distinct


class Pages:
    """The pages of one array: their blocks, and the words of those outside articles."""

    def __init__(self, hosts: list[str], htmls: list[str | None]):
        self.read = [blocks(h) if h else [] for h in htmls]
        tokens, ends, self.spans, at = [], [], [], 0
        seen: dict[tuple, int] = {}
        self.identity = [seen.setdefault((a, b), len(seen)) for a, b in zip(hosts, htmls, strict=True)]  # pages of one html are one
        numbers: dict[str, int] = {}
        for host, found, own in zip(hosts, self.read, self.identity, strict=True):
            start, spans = at, []
            for text, level, _ in found:
                words = text.split(" ") if level not in (ARTICLE, MAIN) else ()  # those are kept, repeated or not
                tokens += [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words]
                spans.append((at, at + len(words)))
                at += len(words)
            tokens.append((1 << 32) + len(ends))
            at += 1
            ends.append((start, at, numbers.setdefault(host, len(numbers)), own))
            self.spans.append(spans)
        self.tokens = np.array(tokens, np.int64)
        sizes = [b - a for a, b, _, _ in ends]
        self.group, self.page = (np.repeat(np.array([e[i] for e in ends], np.int64), sizes) for i in (2, 3))
        self.order, self.starts, self.distinct = repeated_strings(self.tokens, self.group, self.page)

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, digest, in distinct pages) of each string of LEAST words."""
        first = self.order[self.starts]
        keep = first + LEAST <= len(self.tokens)
        first = first[keep]
        windows = self.tokens[first[:, None] + np.arange(LEAST)] if len(first) else np.empty((0, LEAST), np.int64)
        whole = (windows < 1 << 32).all(axis=1)
        digest = np.zeros(len(first), np.uint64)
        for i in range(LEAST):
            digest = (digest ^ windows[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            digest ^= digest >> np.uint64(29)
        return first[whole], digest[whole].view(np.int64), self.distinct[keep][whole]

    def covered(self, foreign: np.ndarray) -> np.ndarray:
        """Running count of the tokens that repeated strings cover, those of other arrays (digests) too."""
        repeated = self.distinct.copy()
        if len(foreign):
            first, digest, _ = self.strings()
            at = np.searchsorted(self.order[self.starts], first, sorter=(by := np.argsort(self.order[self.starts])))
            repeated[by[at[np.isin(digest, foreign)]]] = True
        marks = np.zeros(len(self.tokens) + LEAST + 1, np.int64)
        places = self.order[np.repeat(repeated, np.diff(np.append(self.starts, len(self.order))))]
        np.add.at(marks, places, 1)
        np.add.at(marks, places + LEAST, -1)
        return np.concatenate([[0], np.cumsum(np.cumsum(marks)[: len(self.tokens)] > 0)])

    def texts(self, foreign: np.ndarray) -> Iterator[tuple[str, int]]:
        """(main text, blocks that go because they repeat) of each page."""
        count = self.covered(foreign)
        for found, spans in zip(self.read, self.spans, strict=True):
            boilerplate = [a < b and 2 * int(count[b] - count[a]) >= b - a for a, b in spans]
            open_levels = [lv for (_, lv, links), x in zip(found, boilerplate, strict=True) if lv < OTHER or (lv == OTHER and not links)]
            level = min(open_levels, default=OUT)
            own = [(t, x) for (t, lv, links), x in zip(found, boilerplate, strict=True) if lv == level and lv < OUT and not (lv == OTHER and links)]
            kept = [t for t, x in own if not x] or [t for t, _ in own]
            yield "\n".join(filter(None, kept)), sum(boilerplate)


def dealt(pages: DataFrame, size: int) -> DataFrame:
    """page_id, url, html, host, lane, part: rows of one lane and part make one array; a large host has a lane of its own."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", urls.host_and_path(F.col("url"))[0].alias("host"))
    bytes_of = F.coalesce(F.octet_length("html"), F.lit(0)) + 1
    sizes = common.written(rows.groupBy("host").agg(F.sum(bytes_of).alias("bytes")), 1)
    small = sizes.where(F.col("bytes") <= size).agg(F.sum("bytes")).first()[0] or 0
    large = sizes.where(F.col("bytes") > size).select(F.col("host").alias("large_host"), F.ceil(F.col("bytes") / size).alias("parts"))
    same = F.col("host") == F.col("large_host")
    if large.count() <= BROADCAST_HOSTS:
        found = rows.join(F.broadcast(large), same, "left")
    else:  # rows of a host are dealt over SALTS tasks, each with the narrow row of its size
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("own_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own_salt") == F.col("salt")), "left")
    lanes = max(1, -(-small // size))
    lane = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("host"), F.lit(lanes)).cast("string")).otherwise(F.concat(F.lit("="), F.col("host")))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("html"), F.col("parts")))
    return found.select("page_id", "url", "html", "host", lane.alias("lane"), part.cast("long").alias("part"))


def strings_elsewhere(large: DataFrame) -> DataFrame:
    """lane, part, digest of strings that repeat in the lane, but within this part in no two pages."""
    schema = "lane string, part long, digest long, distinct boolean"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, digest, distinct = Pages(table["host"].to_pylist(), table["html"].to_pylist()).strings()
        lane, part = (k.as_py() for k in key)
        return pa.table({"lane": pa.array([lane] * len(digest), pa.string()), "part": pa.array([part] * len(digest), pa.int64()), "digest": digest, "distinct": distinct})

    own = common.written(large.groupBy("lane", "part").applyInArrow(run, schema))
    repeated = own.groupBy("lane", "digest").agg(F.count("*").alias("parts"), F.max("distinct").alias("somewhere")).where("parts > 1 or somewhere").select("lane", "digest")
    return own.where(~F.col("distinct")).join(repeated, ["lane", "digest"]).select("lane", "part", "digest")


def extract_articles(pages: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (blocks of text that go, or would, because they repeat) of each row."""
    schema = "page_id long, url string, text string, n_chars long, n_repeated long"
    rows = dealt(pages, size)
    elsewhere = strings_elsewhere(rows.where(F.col("lane").startswith("=")))

    def run(own: pa.Table, foreign: pa.Table) -> pa.Table:
        texts, counts = zip(*Pages(own["host"].to_pylist(), own["html"].to_pylist()).texts(foreign["digest"].to_numpy()), strict=True) if len(own) else ((), ())
        columns = [own["page_id"].cast(pa.int64()), own["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())]
        return pa.table(columns, names=[x.split()[0] for x in schema.split(", ")])

    return rows.groupBy("lane", "part").cogroup(elsewhere.groupBy("lane", "part")).applyInArrow(run, schema)


def op12_html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(common.table(spark, sf_dir, "pages"))
