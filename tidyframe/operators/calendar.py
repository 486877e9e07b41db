"""Regular grids of time: gaps filled with rows, missing numbers interpolated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..dtypes import group_key, kind_of, label, missing, name, present, unused
from .ordering import carry_last

#: Points of a grid that a row makes at a time.
CHUNK = 10_000


def fill_gaps(df: DataFrame, at: str, seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """``df`` and a row for each point of a grid that has none: ``by`` and ``at`` set, all else missing.

    The grid of a key runs from its first to its last moment, at multiples of ``seconds`` since 1970-01-01 UTC.
    Rows beside the grid stay. A missing key is a key; rows without a moment stay and make no grid.
    Keys' ends are reduced before the shuffle; grids are made in chunks, so that a long one is many tasks' work.
    """
    if label(kind_of(df, at)) != "datetime":
        raise ValueError(f"{at} holds no datetimes")
    step = round(seconds * 1_000_000)
    if step < 1:
        raise ValueError("a grid needs steps of a microsecond or more")
    moment = F.unix_micros(present(df, at).cast("timestamp"))
    keys = [f"k{i}" for i in range(len(by))]
    # keys of any type: a group's own values come from any of its rows
    own = [F.any_value(name(c)).alias(f"v{i}") for i, c in enumerate(by)]
    placed = df.filter(~missing(df, at)).groupBy(*[group_key(df, c).alias(k) for c, k in zip(by, keys)]).agg(F.ceil(F.min(moment) / F.lit(step)).alias("first"), F.floor(F.max(moment) / F.lit(step)).alias("last"), *own).filter("first <= last")
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("last") - F.col("first")) / CHUNK))))
    # small rows, dealt on before they grow
    spread = chunks.repartition(*[F.col(k) for k in keys], "chunk") if keys else chunks.repartition("chunk")
    begin = F.col("first") + F.col("chunk") * CHUNK
    points = spread.withColumn("point", F.explode(F.sequence(begin, F.least(begin + CHUNK - 1, F.col("last"))))).withColumn("micros", F.col("point") * step)
    there = df.select(*[group_key(df, c).alias(f"t{i}") for i, c in enumerate(by)], moment.alias("there")).filter((F.col("there") % step) == 0)
    same = F.col("micros") == F.col("there")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"t{i}"))
    new = points.join(there, same, "left_anti")
    filled = {at: F.timestamp_micros("micros").cast(kind_of(df, at)), **{c: F.col(f"v{i}") for i, c in enumerate(by)}}
    return df.unionByName(new.select(*[filled.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema]))


def interpolate(df: DataFrame, column: str, at: str, by: Sequence[str] = (), outside: bool = False) -> DataFrame:
    """Missing numbers of a column from the present ones before and after in time, by their distances.

    Among rows of equal ``by``, a missing key being a key. Before the first and after the last present one a number stays
    missing, or with ``outside`` takes the nearest. Rows without a moment stay as they are, and at a moment of several
    rows any present one counts. A whole or decimal column becomes a double; present cells that no double holds are an error
    of the cast's rounding only where they are beyond 2 ** 53.

    Both neighbours come by ``carry_last``: one shuffle each way, over the edges of partitions, no task with a whole key.
    """
    if label(kind_of(df, column)) not in ("integer", "float"):
        raise ValueError(f"{column} holds no numbers")
    if label(kind_of(df, at)) not in ("integer", "float", "datetime"):
        raise ValueError(f"{at} is no order to interpolate by")
    time = F.unix_micros(present(df, at).cast("timestamp")) if label(kind_of(df, at)) == "datetime" else present(df, at)
    t, before, after = unused(df.columns, "_t", "_before", "_after")
    value = present(df, column).cast("double")
    known = F.when(value.isNotNull() & F.col(t).isNotNull(), F.struct(F.col(t).alias("t"), value.alias("v")))
    keys = [group_key(df, c) for c in by]
    ready = df.withColumn(t, time.cast("double")).withColumn(before, known).withColumn(after, known)
    held = carry_last(ready, before, [F.col(t).asc_nulls_last()], keys)
    held = carry_last(held, after, [F.col(t).desc_nulls_last()], keys)
    a, b = F.col(before), F.col(after)
    between = F.when(b["t"] == a["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"]))
    found = F.coalesce(between, a["v"], b["v"]) if outside else between
    made = F.coalesce(value, F.when(F.col(t).isNotNull(), found))
    return held.select(*[made.alias(c) if c == column else name(c) for c in df.columns])
