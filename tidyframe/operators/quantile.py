"""Exact quantiles and modes of columns and groups with any number of distinct values.

Both start from a table of (keys, value, count), counted partly before its shuffle. Quantiles
range-partition it by key and value, add up what each partition holds, find the partitions in
which the wanted ranks lie, and walk only the keys' rows in these.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..dtypes import kind_of, label, present
from ..session import checkpointed, partitions_for


def numbered(df: DataFrame, column: str) -> tuple[Column, Callable[[Column], Column]]:
    """A column's present values as numbers (datetimes: microseconds), and what makes an average of these a value again."""
    c = present(df, column)
    if label(kind_of(df, column)) != "datetime":
        return c, lambda x: x
    return F.unix_micros(c.cast("timestamp")), lambda x: F.timestamp_micros(x.cast("bigint"))


def dealt_by_value(counts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The counts in range partitions by keys and value, with the partition's number _p, in reliable storage."""
    return checkpointed(counts.repartitionByRange(partitions_for(counts), *keys, *order).withColumn("_p", F.spark_partition_id()))


def quantiles(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """(keys..., q array<double>): linear between the two nearest ranks; ``dealt`` has keys, ``order``, n and _p.

    Keys are not null. A key with no rows has none here.
    """
    keys = list(keys)
    sums = dealt.groupBy(*keys, "_p").agg(F.sum("n").alias("_n"))  # about a row for each key and for each partition
    of_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sums.select(*keys, "_p", "_n", before.alias("_before"), F.sum("_n").over(of_key).alias("_total"))

    def ranks(j: int, share: float) -> list[Column]:
        at = (F.col("_total") - 1) * F.lit(float(share))
        low, beyond = F.floor(at), at - F.floor(at)
        one = lambda rank, weight: F.struct(F.lit(j).alias("j"), (rank - F.col("_before")).alias("at"), weight.alias("weight"))
        return [one(low, 1 - beyond), one(low + 1, beyond)]

    every = F.array(*[r for j, s in enumerate(shares) for r in ranks(j, s)])
    own = F.filter(every, lambda r: (r["at"] >= 0) & (r["at"] < F.col("_n")) & (r["weight"] > 0))
    wanted = spans.select(*keys, "_p", own.alias("_wanted")).filter(F.size("_wanted") > 0)
    near = dealt.join(wanted, [*keys, "_p"])
    upto = F.sum("n").over(Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    here = F.filter("_wanted", lambda r: (r["at"] < F.col("_upto")) & (r["at"] >= F.col("_upto") - F.col("n")))
    met = near.withColumn("_upto", upto).select(*keys, value.alias("_v"), F.inline(here))
    parts = [F.sum(F.when(F.col("j") == j, F.col("_v") * F.col("weight"))) for j in range(len(shares))]
    return met.groupBy(*keys).agg(F.array(*parts).alias("q"))


def group_quantiles(df: DataFrame, keys: Sequence[Column], value: Column, shares: Sequence[float]) -> DataFrame:
    """(k0, k1, ..., q): quantiles of a numeric value by keys that are not null; without keys one group k0.

    Null values do not count; q is null where a group has no others.
    """
    named = [k.alias(f"k{i}") for i, k in enumerate(keys or [F.lit(0)])]
    names = [f"k{i}" for i in range(len(named))]
    counts = df.select(*named, value.cast("double").alias("v")).groupBy(*names, "v").agg(F.count("v").alias("n"))
    dealt = dealt_by_value(counts, names, ["v"])
    return dealt.select(*names).distinct().join(quantiles(dealt, names, ["v"], F.col("v"), shares), names, "left")


def mode(df: DataFrame, value: Column) -> DataFrame:
    """One row (mode): the most frequent value that is not null, the smallest of ties; null if there is none."""
    counts = df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))
