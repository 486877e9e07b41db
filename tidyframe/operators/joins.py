"""Joins by time and by overlap."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..dtypes import group_key, kind_of, label, missing, name, present, unused
from ..session import checkpointed, shuffle_partitions
from .ordering import carry_last

#: Widths of levels grow by this factor; most levels.
STEP, LEVELS = 8, 24
#: Cells that an interval may cover; right and left rows of a cell that are kept together; crowded cells that are broadcast.
MOST_CELLS, CELL_ROWS, CELL_LEFT_ROWS, BROADCAST_CELLS = 4096, 4096, 1 << 16, 100_000
#: Right rows that travel as one, at most; rows of equal bounds that travel on their own, at least; pairs that a task compares; most tasks.
CHUNK_ROWS, RUN_ROWS, TASK_PAIRS, MOST_TASKS = 128, 32, 1 << 26, 10_000


def _right_names(left: DataFrame, right: DataFrame, dropped: Sequence[str], suffix: str) -> dict[str, str]:
    """The right side's columns that stay, and their names beside the left's."""
    kept = [c for c in right.columns if c not in dropped]
    out: dict[str, str] = {}
    for c in kept:
        taken = [*left.columns, *out.values()]
        clash = c.lower() in {t.lower() for t in taken}
        (out[c],) = unused(taken, c + suffix if clash else c)
    return out


def _comparable(df: DataFrame, column: str, other: DataFrame, other_column: str) -> None:
    a, b = label(kind_of(df, column)), label(kind_of(other, other_column))
    if a != b and {a, b} != {"integer", "float"} or a not in ("integer", "float", "datetime"):
        raise ValueError(f"{column} ({a}) and {other_column} ({b}) must both be numbers or both be datetimes")


def as_of_join(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None, by: Sequence[str] = (), direction: str = "backward", exact: bool = True, tolerance: float | None = None, ties: Sequence[str] = (), suffix: str = "_right") -> DataFrame:
    """Every row of ``left`` beside the nearest row of ``right`` before it (``forward``: after it), among rows of equal ``by``.

    ``on``, and ``right_on`` if it has another name, are numbers or datetimes. Without ``exact`` a row at the
    very moment does not count; beyond ``tolerance`` (datetimes: seconds) there is no match. Of several right
    rows at one moment the last by ``ties``, then any, is taken. Rows of ``left`` without a match, without a
    moment or without one of their ``by`` have nulls on the right; ``right``'s rows without such match
    nothing. Columns of ``right`` other than ``by`` follow, renamed where a name is taken.

    Both sides are dealt together to sorted ranges of (by, moment) by one shuffle, and the last right row is
    carried on, over the edges of partitions too: neither a key nor a moment with most of the rows is a burden.
    """
    right_on = right_on or on
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    _comparable(left, on, right, right_on)
    names = _right_names(left, right, by, suffix)
    keys = [f"k{i}" for i in range(len(by))]
    kind = "timestamp" if label(kind_of(left, on)) == "datetime" else kind_of(left, on) if kind_of(left, on) == kind_of(right, right_on) else T.DoubleType()

    def usable(df: DataFrame, at: str) -> Column:
        return reduce(lambda a, b: a & b, [~missing(df, c) for c in (at, *by)])

    def side(df: DataFrame, at: str, is_left: bool) -> DataFrame:
        row = F.struct(*[name(c) for c in df.columns])
        other = T.StructType(right.schema.fields) if is_left else T.StructType(left.schema.fields)
        none = F.lit(None).cast(other)
        moment = present(df, at).cast(kind)
        l, r = (row, none) if is_left else (none, row)
        # the row that is to be met first at a moment has the lower side
        lower = (not is_left) if exact else is_left
        tie = F.struct(*[name(c) for c in ties]) if ties and not is_left else F.lit(None).cast(T.StructType([right.schema[c] for c in ties])) if ties else F.lit(0)
        return df.select(*[group_key(df, c).alias(k) for c, k in zip(by, keys)], moment.alias("at"), F.lit(0 if lower else 1).alias("side"), tie.alias("tie"), usable(df, at).alias("usable"), l.alias("l"), r.alias("r"))

    both = side(left, on, True).unionByName(side(right.filter(usable(right, right_on)), right_on, False))
    at = F.col("at").asc_nulls_first() if direction == "backward" else F.col("at").desc_nulls_last()
    joined = carry_last(both, "r", [at, F.col("side"), F.col("tie").asc_nulls_first()], [F.col(k) for k in keys]).filter("l is not null")
    apart = F.abs(F.unix_micros("at") - F.unix_micros(F.col("r")[right_on].cast("timestamp"))) / 1e6 if kind == "timestamp" else F.abs(F.col("at") - F.col("r")[right_on])
    within = F.col("usable") if tolerance is None else F.col("usable") & (apart <= tolerance)
    return joined.select(*[F.col("l")[c].alias(c) for c in left.columns], *[F.when(within, F.col("r")[c]).alias(new) for c, new in names.items()])


def _cell_width(wanted: float, level: float) -> float:
    """A power of two, so that places are divided exactly, not below what is wanted or what MOST_CELLS of an interval allow."""
    least = max(wanted, level / MOST_CELLS, 2.0**-1000)
    return 2.0 ** math.ceil(math.log2(least)) if least < 2.0**1000 else math.inf


def overlap_join(left: DataFrame, right: DataFrame, interval: tuple[str, str], right_interval: tuple[str, str] | None = None, by: Sequence[str] = (), closed: bool = False, suffix: str = "_right") -> DataFrame:
    """Pairs of rows whose intervals (start, end) overlap, among rows of equal ``by``.

    Intervals are half-open, [start, end), unless ``closed``; a half-open one of no length is empty, as is one
    that ends before it starts. A missing start, end or ``by`` meets nothing. Starts and ends are numbers or
    datetimes. Columns of ``right`` other than ``by`` follow, renamed where a name is taken.

    Of a pair one interval starts within the other: either the right one at or after the left one's start, or the left
    one after the right one's. Each interval has the level of the least width that is not below its length; widths start
    at the median length and grow by STEP. It is dealt to the cells of its level that it covers, and its start to one cell
    of each level at which the other side has intervals, so that a pair meets once. Cells are so wide that those that the
    intervals of a level cover are about as many as all rows (MOST_CELLS an interval at most). Right rows of a cell that holds
    more than CELL_ROWS, and left rows of one that holds more than CELL_LEFT_ROWS, are dealt to blocks, by the hash of
    their values, and the other side's rows to all of these: rows are dealt in proportion to the input, and once more for
    about every CELL_ROWS right or CELL_LEFT_ROWS left rows that they are compared with.

    Right rows of a block are sorted by start and end and put together, up to CHUNK_ROWS in one row with its least and greatest
    bounds, so that a left row is compared with these, and with each of its rows only where they do not settle it; RUN_ROWS
    and more of equal bounds are put together without others, so that they always do.
    Columns of ``right`` travel together: what is not needed is best dropped before.
    Tasks are as many as the pairs to be compared need, TASK_PAIRS in each.
    All joins are by equal keys.
    """
    right_interval = right_interval or interval
    for c, d in zip(interval, right_interval):
        _comparable(left, c, right, d)
    names = _right_names(left, right, by, suffix)
    number = label(kind_of(left, interval[0])) != "datetime"

    def bound(df: DataFrame, c: str) -> Column:
        v = present(df, c)
        return v.cast("double") if number else F.unix_micros(v.cast("timestamp")).cast("double")

    def rows(df: DataFrame, ends: tuple[str, str], mark: str, held: Sequence[Column]) -> DataFrame:
        start, end = bound(df, ends[0]), bound(df, ends[1])
        keys = [group_key(df, c).alias(f"k{i}") for i, c in enumerate(by)]
        there = reduce(lambda a, b: a & b, [~missing(df, c) for c in by], start <= end if closed else start < end)
        salt = F.pmod(F.xxhash64(*[group_key(df, c) for c in df.columns]), F.lit(2**31 - 1)).cast("int").alias("salt")
        return df.filter(there).select(*keys, start.alias(f"{mark}s"), end.alias(f"{mark}e"), salt, *held)

    a = rows(left, interval, "a", [name(c).alias(f"l{i}") for i, c in enumerate(left.columns)])
    b = rows(right, right_interval, "b", [name(c).alias(f"r{i}") for i, c in enumerate(names)])
    lengths = a.select((F.col("ae") - F.col("as")).alias("n")).unionByName(b.select((F.col("be") - F.col("bs")).alias("n")))
    base = lengths.filter("n > 0").agg(F.percentile_approx("n", 0.5, 100)).first()[0] or 1.0
    # the last level is of all longer ones, infinite ones too, and is one cell
    widths = [*[float(base) * STEP ** (i - 2) for i in range(LEVELS - 1)], math.inf]

    def levelled(df: DataFrame, mark: str) -> DataFrame:
        long = F.col(f"{mark}e") - F.col(f"{mark}s")
        below = reduce(lambda x, y: x + y, [(F.lit(w) < long).cast("int") for w in widths])
        return df.withColumn("own", F.least(below, F.lit(LEVELS - 1)))

    a, b = levelled(a, "a"), levelled(b, "b")
    # the levels of each side, LEVELS at most
    sides = [df.select(F.lit(m).alias("side"), "own", (F.col(f"{m}e") - F.col(f"{m}s")).alias("long")) for df, m in ((a, "a"), (b, "b"))]
    levels = sides[0].unionByName(sides[1]).groupBy("side", "own").agg(F.count("*").alias("n"), F.sum("long").alias("long")).collect()
    total = sum(r.n for r in levels)
    cells = {m: {r.own: _cell_width(r.long / total, widths[r.own]) for r in levels if r.side == m} for m in "ab"}

    def dealt(df: DataFrame, mark: str, other: str) -> DataFrame:
        start, end, own, nth = F.col(f"{mark}s"), F.col(f"{mark}e"), F.col("own"), F.col("nth")
        width = F.coalesce(F.lit(None).cast("double"), *[F.when(own == i, F.lit(w)) for i, w in cells[mark].items()])
        first, last = F.floor(start / width), F.floor(end / width)
        if not closed:
            last = F.greatest(first, last - F.when(last.cast("double") == end / width, 1).otherwise(0))
        # the cells that it covers, the first to the last, and then one for its start at each of the other side's levels
        spread = df.withColumn("first", first).withColumn("span", (last - F.col("first")).cast("int"))
        spread = spread.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("span") + len(cells[other])))).withColumn("nth", nth - F.col("span"))
        part, level, cell = (F.when(nth <= 0, v) for v in (F.lit("ab".index(mark)), own, F.col("first") + (nth + F.col("span"))))
        for n, (i, w) in enumerate(cells[other].items(), 1):
            part, level, cell = part.when(nth == n, F.lit("ab".index(other))), level.when(nth == n, F.lit(i)), cell.when(nth == n, F.floor(start / F.lit(w)))
        return spread.select(*[c for c in df.columns if c != "own"], part.alias("part"), level.alias("level"), cell.alias("cell"))

    keys = [*[f"k{i}" for i in range(len(by))], "part", "level", "cell"]
    a, b = dealt(a, "a", "b"), dealt(b, "b", "a")
    # cells of both sides: each crowded one, and the others as one
    both = a.groupBy(*keys).agg(F.count("*").alias("lefts")).join(b.groupBy(*keys).agg(F.count("*").alias("rights")), keys)
    is_crowded = (F.col("lefts") > CELL_LEFT_ROWS) | (F.col("rights") > CELL_ROWS)
    blocks = [F.ceil(F.max("lefts") / CELL_LEFT_ROWS).cast("int").alias("a_blocks"), F.ceil(F.max("rights") / CELL_ROWS).cast("int").alias("b_blocks")]
    sized = checkpointed(both.groupBy(is_crowded.alias("crowded"), *[F.when(is_crowded, F.col(k)).alias(k) for k in keys]).agg(F.sum(F.col("lefts").cast("double") * F.col("rights")).alias("pairs"), *blocks))
    crowded = sized.filter("crowded").select(*keys, "a_blocks", "b_blocks")
    pairs, found = sized.agg(F.sum("pairs"), F.count_if("crowded")).first()
    if found:
        known = F.broadcast(crowded) if found <= BROADCAST_CELLS else crowded

        def blocked(df: DataFrame, mark: str, other: str) -> DataFrame:
            mine, others = (F.coalesce(F.col(f"{m}_blocks"), F.lit(1)) for m in (mark, other))
            return df.join(known, keys, "left").withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), others - 1))).withColumn(f"{mark}_block", F.pmod("salt", mine)).drop("a_blocks", "b_blocks")

        a, b = blocked(a, "a", "b"), blocked(b, "b", "a")
    at = [*keys, "a_block", "b_block"] if found else keys
    a, b = a.drop("salt"), b.drop("salt")
    tasks = math.ceil(min((pairs or 0) / TASK_PAIRS, MOST_TASKS))
    if tasks > 1:
        a, b = (df.repartition(max(tasks, shuffle_partitions(left.sparkSession)), *at) for df in (a, b))
    chunk = F.floor((F.row_number().over(Window.partitionBy(*at).orderBy("bs", "be")) - 1) / CHUNK_ROWS)
    equal = F.count("*").over(Window.partitionBy(*at, "bs", "be")) >= RUN_ROWS
    chunks = {"chunk": chunk, "run_start": F.when(equal, F.col("bs")), "run_end": F.when(equal, F.col("be"))}
    ends = [x for c in ("bs", "be") for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    b = b.withColumns(chunks).groupBy(*at, *chunks).agg(*ends, F.collect_list(F.struct("bs", "be", *[f"r{i}" for i in range(len(names))])).alias("rows"))

    def meet(least_start: str, greatest_start: str, least_end: str) -> Column:
        """Whether the left row meets all right rows within these bounds; with least and greatest changed over, whether it may meet one."""
        right_within = (F.col(least_start) >= F.col("as")) & (F.col(greatest_start) <= F.col("ae") if closed else F.col(greatest_start) < F.col("ae"))
        left_within = (F.col("as") > F.col(greatest_start)) & (F.col("as") <= F.col(least_end) if closed else F.col("as") < F.col(least_end))
        return F.when(F.col("part") == 0, right_within).otherwise(left_within)

    near = a.join(b, at).filter(meet("bs_max", "bs_min", "be_max"))
    lefts = ["part", "as", "ae", *[f"l{i}" for i in range(len(left.columns))]]
    # first on its own, so that it is not worked out for each pair
    sure = near.select(*lefts, meet("bs_min", "bs_max", "be_min").alias("sure"), "rows")
    met = sure.select(*lefts, "sure", F.inline("rows")).filter(F.col("sure") | meet("bs", "bs", "be"))
    return met.select(*[F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"r{i}").alias(new) for i, new in enumerate(names.values())])
