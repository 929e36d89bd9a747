"""Return lot matching (operator 13): which lots the units of each return came from.

Lots and returns of one key (a client and an item) meet in three steps.

1. Supply and demand are summed per key and day, which leaves at most two numbers
   for each day of the calendar, however many rows there are.
2. Each key's days of supply are taken in the rule's order, and each gives its
   units to the open days of demand after it, earliest first. A pointer per day
   leads to the next day that is still open, so no day is looked at again once it
   is met. That is what the returns would take one after the other, as every one
   of them ranks the lots alike.
3. A day's lots lie on a line in the order of their ties, and so do a day's
   returns; what day s gives to day r is one interval of each line. Lots that
   overlap the first interval and returns that overlap the second one are the
   pieces. Lines are cut in cells about two entries wide, and intervals meet in
   the cell where their overlap starts, so that no key's rows meet as pairs.

Places on the lines are running sums over rows in order. Rows are dealt by ranges
of the whole order and ties are dealt by their place in a file, so a key, a day or
a lot that repeats spreads over many tasks; each task sums its own range, and one
row for each task says what went before.

Edge cases: rows with a null key, day or number of units, or with fewer than one
unit, are left out; a null order column sorts first, and null order columns of
a lot or return come back as they are; repeated rows are lots (returns) of their
own; a return with no lot left has one piece without a lot; empty tables give an
empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEAST_CELL = 64
RULES = ("lifo", "fifo")
ALLOC = "lot_day long, return_day long, lot_from long, return_from long, units long, lot_cell long, return_cell long, returns_before long"
USED = "kind int, day long, cell long"


def allot(supply: list[tuple[int, int]], demand: list[tuple[int, int]], rule: str = "lifo") -> list[tuple[int | None, int, int, int, int]]:
    """(lot day, return day, units given before by the lot day, units got before by the
    return day, units) of days with units, each in ascending order. What no lot day can give has None."""
    days = [d for d, _ in demand]
    need = [u for _, u in demand]
    got = [0] * len(need)
    onward = list(range(len(need) + 1))  # the next open day at or after each day

    def next_open(i: int) -> int:
        while onward[i] != i:
            onward[i] = onward[onward[i]]
            i = onward[i]
        return i

    found = []
    first_after = [bisect_right(days, d) for d, _ in supply]
    ranked = range(len(supply)) if rule == "fifo" else reversed(range(len(supply)))
    for k in ranked:
        day, left = supply[k]
        given, i = 0, next_open(first_after[k])
        while given < left and i < len(days):
            units = min(left - given, need[i] - got[i])
            found.append((day, days[i], given, got[i], units))
            given += units
            got[i] += units
            if got[i] == need[i]:
                onward[i] = i + 1
            i = next_open(i)
    found += [(None, d, 0, g, n - g) for d, n, g in zip(days, need, got, strict=True) if g < n]
    return found


def _cell(units: int, rows: int) -> int:
    """The width of a line's cells: a power of two, about two entries."""
    return 1 << (max(LEAST_CELL, 2 * units // rows) - 1).bit_length()


def plan_days(totals: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """keys, allocs (array of ALLOC), used (array of USED: the days that take part, of lots and returns)
    from totals: keys, days (array of kind, day, units, rows), bounded by the calendar."""
    allocs, used = (T._parse_datatype_string(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in s.split(', '))}>>") for s in (ALLOC, USED))
    schema = T.StructType([*(totals.schema[k] for k in keys), T.StructField("allocs", allocs), T.StructField("used", used)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days = batch.column(len(keys))
            ends, flat = days.offsets.to_pylist(), days.values
            kind, day, units, rows = (flat.field(i).to_pylist() for i in range(4))
            columns: dict[str, list[list]] = {"allocs": [[] for _ in range(8)], "used": [[] for _ in range(3)]}
            sizes: dict[str, list[int]] = {"allocs": [0], "used": [0]}
            for a, b in zip(ends, ends[1:], strict=False):
                at = sorted(range(a, b), key=day.__getitem__)
                supply, demand = ([(day[i], units[i]) for i in at if kind[i] == k] for k in (0, 1))
                cell = {(kind[i], day[i]): _cell(units[i], rows[i]) for i in at}
                before, seen = {}, 0
                for i in at:
                    if kind[i] == 1:
                        before[day[i]] = seen
                        seen += rows[i]
                taking = dict.fromkeys((1, r) for r in before)
                for s, r, x, y, u in allot(supply, demand, rule):
                    if s is not None:
                        taking[0, s] = None
                    for column, value in zip(columns["allocs"], (s, r, x, y, u, cell.get((0, s)), cell[1, r], before[r]), strict=True):
                        column.append(value)
                for k, d in taking:
                    for column, value in zip(columns["used"], (k, d, cell[k, d]), strict=True):
                        column.append(value)
                for name, found in columns.items():
                    sizes[name].append(len(found[0]))
            lists = [_structs(columns[n], sizes[n], arrow.field(n).type) for n in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *lists], schema=arrow)

    return totals.select(*keys, "days").mapInArrow(run, schema)


def _structs(columns: list[list], ends: list[int], kind: pa.ListType) -> pa.ListArray:
    """Columns of values as an array of lists of structs, whose ends are given."""
    fields = list(kind.value_type)
    inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=kind)


def running(rows: DataFrame, segment: list[str], order: list[str]) -> DataFrame:
    """rows with place (units of its segment's rows before it) and rank (their number) in the given
    order. rows must be read from files: ties are told apart by their place there. No task gets more than its
    range of the whole order, whatever the size of a segment."""
    spark = rows.sparkSession
    tie, n = "_tie", common.shuffle_partitions(spark)
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *segment, *order, tie).sortWithinPartitions(*segment, *order, tie).drop(tie)
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(c, T.LongType()) for c in ("place", "rank")), T.StructField("part", T.IntegerType()), T.StructField("head", T.BooleanType()), T.StructField("last", T.BooleanType())])
    at = [ranged.columns.index(c) for c in segment]
    units_at = ranged.columns.index("units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, before, units, count, head = None, None, 0, 0, True
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                yield _flagged(held, part, False)
            new = np.zeros(len(batch), bool)
            for k in at:
                column = batch.column(k).to_numpy(zero_copy_only=False)
                new[1:] |= column[1:] != column[:-1]
            here = tuple(batch.column(k)[0].as_py() for k in at)
            if here != before:
                head = head and before is None
                units = count = 0
            starts = np.flatnonzero(new)
            own = batch.column(units_at).to_numpy(zero_copy_only=False)
            total = np.cumsum(own) - own + units
            number = np.arange(len(batch)) + count
            which = np.cumsum(new)
            total -= np.concatenate([[0], total[starts]])[which]
            number -= np.concatenate([[0], number[starts]])[which]
            held = (batch, total, number, (which == 0) & head)
            before = tuple(batch.column(k)[len(batch) - 1].as_py() for k in at)
            units, count, head = int(total[-1] + own[-1]), int(number[-1] + 1), head and not len(starts)
        if held is not None:
            yield _flagged(held, part, True)

    found = common.written(ranged.mapInArrow(run, schema))
    # one row for each task: the segment that it ends in, and what it has of it
    tails = found.where("last").select(*(F.col(c).alias(f"t_{c}") for c in segment), F.col("part").alias("t_part"), (F.col("place") + F.col("units")).alias("t_units"), (F.col("rank") + 1).alias("t_rows"))
    heads = found.where("head and rank = 0").select(*segment, F.col("part").alias("h_part"))
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in segment] + [F.col("t_part") < F.col("h_part")]
    moved = heads.join(F.broadcast(tails), [c for c in same]).groupBy("h_part").agg(F.sum("t_units").alias("m_units"), F.sum("t_rows").alias("m_rows"))
    joined = found.join(F.broadcast(moved), F.col("head") & (F.col("part") == F.col("h_part")), "left")  # at most one row a task
    place, rank = (F.col(a) + F.coalesce(F.col(b), F.lit(0)) for a, b in (("place", "m_units"), ("rank", "m_rows")))
    return joined.select(*rows.columns, place.alias("place"), rank.alias("rank"))


def _flagged(held: tuple, part: int, ends: bool) -> pa.RecordBatch:
    batch, total, number, head = held
    last = np.zeros(len(batch), bool)
    last[-1] = ends
    columns = [pa.array(total, pa.int64()), pa.array(number, pa.int64()), pa.array(np.full(len(batch), part, np.int32)), pa.array(head), pa.array(last)]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "place", "rank", "part", "head", "last"])


def _cells(start: Column, units: Column, cell: Column) -> Column:
    div = lambda a: F.call_function("div", a, cell)
    return F.explode(F.sequence(div(start), div(start + units - 1)))


def match_lots(lots: DataFrame, returns: DataFrame, keys: list[str], order: list[str], rule: str = "lifo") -> DataFrame:
    """The pieces of each return. Both tables have keys, day (long), units (long) and the columns of
    order, by which rows of one day and key go. A return takes from lots of earlier days; rule: lifo or
    fifo, by the lots' days. Gives keys, return_no (in the order of days, then order), piece_no, return_day, units,
    return_from and lot_from (units of the return, of the lot, that went before), lot_left, lot_day,
    and order of either side as return_<name> and lot_<name>; lot columns are null in a piece without a lot."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [*keys, "day", "units", *order]
    sides = [t.select(F.lit(k).alias("kind"), *names).dropna(subset=[*keys, "day", "units"]).where("units > 0") for k, t in enumerate((lots, returns))]
    entries = sides[0].unionByName(sides[1])
    totals = entries.groupBy(*keys, "kind", F.col("day").cast("int").alias("day")).agg(F.sum("units").alias("units"), F.count("*").alias("rows"))
    # only keys with returns; both joins stream the larger side past a hash table of their partition's keys
    wanted = sides[1].select(*keys).distinct().hint("shuffle_hash")
    totals = totals.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("kind", "day", "units", "rows")).alias("days"))
    plan = common.written(plan_days(totals, keys, rule))
    used, allocs = (plan.select(*keys, F.inline(c)) for c in ("used", "allocs"))
    entries = common.written(entries.join(used.hint("shuffle_hash"), [*keys, "kind", "day"]))
    placed = common.written(running(entries, [*keys, "kind", "day"], order))

    lot_rows = placed.where("kind = 0").select(*keys, F.col("day").alias("lot_day"), F.col("units").alias("lot_units"), F.col("place").alias("lot_place"), *(F.col(c).alias(f"lot_{c}") for c in order), _cells(F.col("place"), F.col("units"), F.col("cell")).alias("_cell"))
    given = allocs.where("lot_day is not null").withColumn("_cell", _cells(F.col("lot_from"), F.col("units"), F.col("lot_cell")))
    start, end = F.greatest("lot_place", "lot_from"), F.least(F.col("lot_place") + F.col("lot_units"), F.col("lot_from") + F.col("units"))
    parts = (
        given.join(lot_rows, [*keys, "lot_day", "_cell"]).where((start < end) & (F.call_function("div", start, F.col("lot_cell")) == F.col("_cell")))
        .select(*keys, "return_day", "return_cell", "returns_before", "lot_day", "lot_units", *(f"lot_{c}" for c in order), (start - F.col("lot_place")).alias("lot_taken"), (F.col("return_from") + start - F.col("lot_from")).alias("part_from"), (end - start).alias("part_units"))
    )
    open_parts = allocs.where("lot_day is null").select(*keys, "return_day", "return_cell", "returns_before", F.col("return_from").alias("part_from"), F.col("units").alias("part_units"))
    parts = parts.unionByName(open_parts, allowMissingColumns=True).withColumn("_cell", _cells(F.col("part_from"), F.col("part_units"), F.col("return_cell")))

    return_rows = placed.where("kind = 1").select(*keys, F.col("day").alias("return_day"), F.col("units").alias("return_units"), F.col("place").alias("return_place"), F.col("rank").alias("return_rank"), *(F.col(c).alias(f"return_{c}") for c in order), _cells(F.col("place"), F.col("units"), F.col("cell")).alias("_cell"))
    start, end = F.greatest("return_place", "part_from"), F.least(F.col("return_place") + F.col("return_units"), F.col("part_from") + F.col("part_units"))
    taken = F.col("lot_taken") + start - F.col("part_from")
    pieces = (
        parts.join(return_rows, [*keys, "return_day", "_cell"]).where((start < end) & (F.call_function("div", start, F.col("return_cell")) == F.col("_cell")))
        .select(*keys, (F.col("returns_before") + F.col("return_rank") + 1).alias("return_no"), "return_day", (end - start).alias("units"), (start - F.col("return_place")).alias("return_from"), taken.alias("lot_from"),
                (F.col("lot_units") - taken - (end - start)).alias("lot_left"), "lot_day", *(f"{side}_{c}" for side in ("return", "lot") for c in order))
    )
    one = Window.partitionBy(*keys, "return_no").orderBy("return_from")  # a return's pieces are at most its units
    return pieces.withColumn("piece_no", F.row_number().over(one).cast("long"))


def floor_div(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers, for b > 0."""
    return F.call_function("div", a - F.pmod(a, b), b)


def sale_lots(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """The lots of sale_lines with what each returns: client_id, item_id, day, sale_id, line_no, q, c, d
    (null discount: none), return_day, return_units (null where not flagged returned)."""
    own = sales.select("sale_id", F.col("client_id").cast("long").alias("client_id")).dropna()
    rows = lines.select("sale_id", "line_no", "item_id", "quantity", "amount", "discount", "flag", "shipped_at").dropna(subset=["sale_id", "item_id", "quantity", "amount", "shipped_at"]).where("quantity > 0")
    cents = lambda c: F.floor(100 * F.col(c) + 0.5).cast("long")
    h, q = F.crc32(F.concat(F.col("sale_id").cast("string"), F.lit(":"), F.coalesce(F.col("line_no").cast("string"), F.lit(""))).cast("binary")), F.col("quantity").cast("long")
    day, back = F.unix_date(F.to_date("shipped_at")).cast("long"), F.col("flag") == "returned"
    return rows.join(own.hint("shuffle_hash"), "sale_id").select(
        "client_id", F.col("item_id").cast("long").alias("item_id"), day.alias("day"), F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"),
        q.alias("q"), cents("amount").alias("c"), F.coalesce(cents("discount"), F.lit(0)).alias("d"),
        F.when(back, day + 1 + h % 13).alias("return_day"), F.when(back, 1 + h % (q + 10)).alias("return_units"),
    )


def returned_lots(lines: DataFrame, sales: DataFrame, rule: str = "lifo") -> DataFrame:
    """match_lots() of sale_lines and sales by client and item, with refund_cents and margin_cents."""
    rows = common.written(sale_lots(lines, sales))
    order = ["sale_id", "line_no", "q", "c", "d"]
    returns = rows.where("return_units is not null").select("client_id", "item_id", F.col("return_day").alias("day"), F.col("return_units").alias("units"), *order)
    found = match_lots(rows.withColumn("units", F.col("q")), returns, ["client_id", "item_id"], order, rule)
    spread = lambda share, q, a: floor_div((F.col(a) + F.col("units")) * share, q) - floor_div(F.col(a) * share, q)
    refund = spread(F.col("return_c") * (100 - F.col("return_d")), 100 * F.col("return_q"), "return_from")
    return found.withColumn("refund_cents", refund).withColumn("margin_cents", F.col("refund_cents") - spread(F.col("lot_c"), F.col("lot_q"), "lot_from"))


def op13_return_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = returned_lots(common.table(spark, sf_dir, "sale_lines"), common.table(spark, sf_dir, "sales"))
    return found.select("client_id", "item_id", "return_no", "piece_no", "return_day", "return_sale_id", "lot_sale_id", "lot_line_no", "units", "lot_left", "refund_cents", "margin_cents")


OP13_SQL = r"""
WITH RECURSIVE raw AS (SELECT client_id, item_id, datediff('day', DATE '1970-01-01', shipped_at::DATE)::BIGINT AS day, sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS c, coalesce(floor(100 * discount + 0.5)::BIGINT, 0) AS d, flag,
  xor(list_reduce(list_transform(string_split(sale_id::VARCHAR || ':' || coalesce(line_no::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295) AS h
  FROM sale_lines JOIN sales USING (sale_id) WHERE client_id IS NOT NULL AND item_id IS NOT NULL AND amount IS NOT NULL AND shipped_at IS NOT NULL AND quantity > 0),
back AS (SELECT *, day + 1 + h % 13 AS return_day, 1 + h % (q + 10) AS wanted, row_number() OVER (PARTITION BY client_id, item_id ORDER BY day + 1 + h % 13, sale_id, line_no, q, c, d) AS no FROM raw WHERE flag = 'returned'),
lots AS (SELECT client_id, item_id, day, sale_id, line_no, q, c, row_number() OVER (PARTITION BY client_id, item_id ORDER BY day DESC, sale_id, line_no, q, c, d) AS rank FROM raw WHERE (client_id, item_id) IN (SELECT (client_id, item_id) FROM back)),
t AS (SELECT *, 0::BIGINT AS no, q AS left_before, 0::BIGINT AS taken, 0::BIGINT AS ahead FROM lots
  UNION ALL
  SELECT client_id, item_id, day, sale_id, line_no, q, c, rank, no, have, greatest(0, least(CASE WHEN ripe THEN have ELSE 0 END, wanted - ahead)), ahead
  FROM (SELECT t.client_id, t.item_id, t.day, t.sale_id, t.line_no, t.q, t.c, t.rank, b.no, b.wanted, t.left_before - t.taken AS have, t.day < b.return_day AS ripe,
    coalesce(sum(CASE WHEN t.day < b.return_day THEN t.left_before - t.taken ELSE 0 END) OVER (PARTITION BY t.client_id, t.item_id ORDER BY t.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
    FROM t JOIN back b ON b.client_id = t.client_id AND b.item_id = t.item_id AND b.no = t.no + 1)),
got AS (SELECT client_id, item_id, no, sale_id AS lot_sale_id, line_no AS lot_line_no, taken AS units, ahead AS return_from, left_before - taken AS lot_left, (q - left_before) AS lot_from, q, c FROM t WHERE no > 0 AND taken > 0),
short AS (SELECT b.client_id, b.item_id, b.no, NULL::BIGINT, NULL::BIGINT, b.wanted - coalesce(sum(g.units), 0)::BIGINT, coalesce(sum(g.units), 0)::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM back b LEFT JOIN got g USING (client_id, item_id, no) GROUP BY b.client_id, b.item_id, b.no, b.wanted HAVING b.wanted > coalesce(sum(g.units), 0)),
p AS (SELECT g.*, b.return_day, b.sale_id AS return_sale_id, b.q AS rq, b.c * (100 - b.d) AS share FROM (SELECT * FROM got UNION ALL SELECT * FROM short) g JOIN back b USING (client_id, item_id, no)),
m AS (SELECT *, ((return_from + units) * share) // (100 * rq) - (return_from * share) // (100 * rq) AS refund_cents, ((lot_from + units) * c) // q - (lot_from * c) // q AS cost FROM p)
SELECT client_id, item_id, no AS return_no, row_number() OVER (PARTITION BY client_id, item_id, no ORDER BY return_from) AS piece_no, return_day, return_sale_id, lot_sale_id, lot_line_no, units, lot_left, refund_cents, refund_cents - cost AS margin_cents FROM m
"""
