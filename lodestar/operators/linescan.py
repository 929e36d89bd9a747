"""Line metrics of texts of any length, as an associative scan over cut texts.

Whether a line is code or comment depends on one bit that is carried from line to line: is a block comment
open. A line, and so any run of lines, is a function of that bit: counts and an end
bit for either start. Functions of adjacent runs compose, in any grouping, so a text may be cut
at any line and its pieces counted by different tasks. ``text.line_metrics`` is the same
automaton as a fold over one row's text.

Edge cases: a null line counts as no line, but its text has a row; an empty text has zeros and a null one nulls; a
final line feed adds no line; texts and lines that repeat are counted each time; a key may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.store import bound_batches, stored

#: What a run of lines does for either start (0 closed, 1 open): its counts and whether a block is open at its end.
RUN = "blank long, code0 long, comment0 long, open0 boolean, code1 long, comment1 long, open1 boolean"
#: Runs that are composed in one row at a time.
FAN_IN = 512
#: Kinds of a line: blank; those that leave a block closed or open whatever was before; one that turns the bit over.
BLANK, SHUT, OPENS, TURNS, KEEPS, NO_LINE = range(6)


def line_kind(raw: Column) -> Column:
    """Two numbers in one byte: the kind of the line's function (above) and, from 8 on, whether it is a comment by itself."""
    line = F.btrim(raw, F.lit(" \t\r\x0b\x0c"))
    starts = line.startswith("/*")
    opens = starts & ~F.substring(line, 3, 1 << 30).contains("*/")
    ends = line.contains("*/")
    kind = F.when(opens & ends, TURNS).when(opens, OPENS).when(ends, SHUT).otherwise(KEEPS)
    return F.when(raw.isNull(), NO_LINE).when(line == "", BLANK).otherwise(kind + F.when(starts | line.startswith("//"), 8).otherwise(0)).cast("int")


def _open_before(kind: np.ndarray, start: bool) -> tuple[np.ndarray, bool]:
    """For each line whether a block is open before it, and whether one is after the last.

    KEEPS leaves an open block open and a closed one closed, as BLANK does. The bit is that of
    the last line that sets it, turned over as often as lines since then do so."""
    at = np.arange(1, len(kind) + 1)
    sets = (kind == SHUT) | (kind == OPENS)
    last = np.maximum.accumulate(np.where(sets, at, 0))
    turns = np.concatenate([[0], np.cumsum(kind == TURNS)])
    value = np.concatenate([[start], kind == OPENS])[last]
    after = value ^ ((turns[1:] - turns[last]) % 2 == 1)
    return np.concatenate([[start], after[:-1]]).astype(bool), bool(after[-1])


def _run(codes: np.ndarray) -> tuple:
    kind, own = codes & 7, codes >= 8
    blank, none = kind == BLANK, kind == NO_LINE
    found = [int(blank.sum())]
    for start in (False, True):
        before, end = _open_before(kind, start)
        comment = ~blank & ~none & (own | before)
        found += [int((~blank & ~none & ~comment).sum()), int(comment.sum()), end]
    return tuple(found)


def runs(lines: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and RUN for each stretch of rows of one key within an Arrow batch, with ``n``, the stretch's number
    in its partition. lines: in order within a key, as a text reader or an explode leaves them; a key's rows must
    lie in one partition, next to each other. Nothing is shuffled and no line is held beyond its batch."""
    bound_batches(lines.sparkSession)
    narrow = lines.select(*key, line_kind(F.col(value)).alias("_kind"))
    kept = narrow.select(*key).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for c in key:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change)])
            codes = batch.column("_kind").to_numpy(zero_copy_only=False)
            found = list(zip(*(_run(x) for x in np.split(codes, starts[1:])), strict=True))
            where = pa.array(starts)
            arrays = [batch.column(c).take(where) for c in key] + [pa.array(np.arange(n, n + len(starts)))]
            types = [pa.int64() if i % 3 != 0 or i == 0 else pa.bool_() for i in range(len(found))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, t) for x, t in zip(found, types, strict=True)], [*key, "n", *(x.split()[0] for x in RUN.split(", "))])
            n += len(starts)

    return narrow.mapInArrow(work, f"{schema}, n long, {RUN}")


def _then(a: Column, b: Column) -> Column:
    """The run a followed by the run b."""
    parts = [(a["blank"] + b["blank"]).alias("blank")]
    for s in "01":
        pick = lambda c: F.when(a[f"open{s}"], b[f"{c}1"]).otherwise(b[f"{c}0"])  # noqa: E731, B023
        parts += [(a[f"{c}{s}"] + pick(c)).alias(f"{c}{s}") for c in ("code", "comment")] + [pick("open").alias(f"open{s}")]
    return F.struct(*parts)


def compose(found: DataFrame, text: list[str], order: list[str], fan_in: int = FAN_IN) -> DataFrame:
    """text, code, comment, blank of runs (text, order, RUN), stored. While a text has more than fan_in runs, those
    that are neighbours in the last column of order are composed, fan_in at a time, so no row takes more of a text than that."""
    names = [x.split()[0] for x in RUN.split(", ")]
    counts, end = lambda s: [F.lit(0).cast("long").alias(f"{c}{s}") for c in ("code", "comment")], lambda s: F.lit(s == "1").alias(f"open{s}")
    nothing = F.struct(F.lit(0).cast("long").alias("blank"), *counts("0"), end("0"), *counts("1"), end("1"))
    composed = lambda at: F.aggregate(F.sort_array(F.collect_list(F.struct(*at, F.col("run")))), nothing, lambda a, x: _then(a, x["run"])).alias("run")
    level, order = found.select(*text, *order, F.struct(*names).alias("run")), list(order)
    while (level.groupBy(*text).count().agg(F.max("count")).first()[0] or 0) > fan_in:
        *above, own = order
        if level.where(F.col(own) != 0).isEmpty():
            order = above  # one run for each value of the columns above
            continue
        part = F.floor(F.col(own) / fan_in).cast("long")
        level = stored(level.groupBy(*text, *above, part.alias("_part")).agg(composed([F.col(own)])).withColumnRenamed("_part", own))
    return level.groupBy(*text).agg(composed([F.col(c) for c in order])).select(*text, *(F.col(f"run.{a}").alias(b) for a, b in (("code0", "code"), ("comment0", "comment"), ("blank", "blank"))))


def text_metrics(texts: DataFrame, key: str, source: str, lines_a_run: int = 1000) -> DataFrame:
    """key, code, comment, blank for each row of texts (key, source), whose lines are cut into runs."""
    cut = F.when(F.col(source) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(source, r"\n\z", ""), "\n"))
    numbered = texts.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(source).isNull().alias("_null"), cut.alias("_lines"))
    rows = numbered.select("_row", "_key", "_null", F.posexplode_outer("_lines").alias("_at", "_line"))  # a row's number is given before it becomes lines
    rows = rows.withColumn("_cut", F.coalesce(F.floor(F.col("_at") / lines_a_run), F.lit(0)).cast("long"))
    whole = ["_row", "_key", "_null"]
    found = compose(stored(runs(rows, [*whole, "_cut"], "_line")), whole, ["_cut", "n"])
    return found.select(F.col("_key").alias(key), *(F.when(~F.col("_null"), F.col(c)).alias(c) for c in ("code", "comment", "blank")))


def file_metrics(spark: SparkSession, *where: str) -> DataFrame:
    """file, code, comment, blank of text files at a path or glob, however long: a file is read in the splits that
    Spark gives it, and each split's lines are a run. An empty file has no row,
    as Spark's readers skip it."""
    lines = spark.read.option("lineSep", "\n").text(list(where)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    return compose(stored(runs(lines, ["file", "_block"], "value")), ["file"], ["_block", "n"])
