"""Grouping sets with exact medians and distinct counts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..dtypes import group_key, kind_of, label, name, present
from ..session import checkpointed
from .quantile import dealt_by_value, quantiles


def cube_sets(columns: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets of the columns, the largest first."""
    return [s for n in range(len(columns), -1, -1) for s in combinations(columns, n)]


def rollup_sets(columns: Sequence[str]) -> list[tuple[str, ...]]:
    """All beginnings of the columns, the longest first."""
    return [tuple(columns[:n]) for n in range(len(columns), -1, -1)]


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], column: str, shares: Sequence[float] = (0.5,)) -> DataFrame:
    """A row for each group of each set: the keys (null where a set leaves them out), grouping_id, n, count, sum, distinct, q50 and so on.

    n counts rows and count present numbers of ``column``; sum, and quantiles linear between the two nearest ranks,
    are doubles. grouping_id has a bit for each key, the first the highest, that is 1 where the set leaves the key out, so that a
    missing key and a left-out one stay apart. Repeated sets are one. An empty table gives no rows, but for the empty set one.

    The rows are counted once by all keys and value; the coarser sets are sums of these counts, which alone are expanded.
    """
    sets = list(dict.fromkeys(tuple(s) for s in sets))
    keys = [c for c in df.columns if any(c in s for s in sets)]
    for c in [c for s in sets for c in s]:
        kind_of(df, c)
    if label(kind_of(df, column)) not in ("integer", "float"):
        raise ValueError(f"{column} holds no numbers")
    order = list(dict.fromkeys(c for s in sets for c in s))
    named = [group_key(df, c).alias(f"k{i}") for i, c in enumerate(order)]
    finest = checkpointed(df.select(*named, present(df, column).cast("double").alias("v")).groupBy(*[f"k{i}" for i in range(len(order))], "v").agg(F.count("*").alias("n")))
    number = lambda s: sum(1 << (len(order) - 1 - i) for i, c in enumerate(order) if c not in s)
    level = lambda s: F.struct(F.lit(number(s)).alias("grouping_id"), *[(F.col(f"k{i}") if c in s else F.lit(None).cast(finest.schema[f"k{i}"].dataType)).alias(f"k{i}") for i, c in enumerate(order)])
    expanded = finest.select(F.explode(F.array(*[level(s) for s in sets])).alias("g"), "v", "n")
    counts = expanded.groupBy("g", "v").agg(F.sum("n").alias("n"))
    dealt = dealt_by_value(counts, ["g"], ["v"])
    there = dealt.filter("v is not null")
    q = quantiles(there, ["g"], ["v"], F.col("v"), shares)
    whole = dealt.groupBy("g").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("count"), F.sum(F.col("v") * F.col("n")).alias("sum"), F.count("v").alias("distinct"))
    if () in sets:
        nothing = df.sparkSession.range(1).select(F.struct(F.lit(number(())).alias("grouping_id"), *[F.lit(None).cast(finest.schema[f"k{i}"].dataType).alias(f"k{i}") for i in range(len(order))]).alias("g"))
        whole = whole.unionByName(nothing.join(whole, "g", "left_anti").select("g", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("count"), F.lit(None).cast("double").alias("sum"), F.lit(0).cast("bigint").alias("distinct")))
    found = whole.join(q, "g", "left")
    places = [F.get("q", F.lit(j)).alias("q" + f"{100 * s:g}".replace(".", "_")) for j, s in enumerate(shares)]
    return found.select(*[F.col("g")[f"k{order.index(c)}"].alias(c) for c in keys], F.col("g")["grouping_id"].alias("grouping_id"), "n", "count", "sum", "distinct", *places)
