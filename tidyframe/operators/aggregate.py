"""Grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..dtypes import missing, name, present
from .quantile import group_quantiles, numbered


def group_by_agg(df: DataFrame, keys: Sequence[str], column: str, how: str, approximate: bool = False) -> DataFrame:
    """One of sum, mean, median, count, min, max, std of a column, under its own name, by keys and in their order.

    Rows with a missing key are left out. Exact medians range-partition the groups' value counts, so
    that a group may be of any size; ``approximate`` ones take one pass. Means and medians of datetimes
    are datetimes, to the microsecond.
    """
    c = present(df, column)
    as_number, back = numbered(df, column)
    made = {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "mean": lambda: back(F.avg(as_number)),
        "median": lambda: back(F.percentile_approx(as_number, 0.5, 10000)),
        "count": lambda: F.count(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "std": lambda: F.stddev_samp(c),
    }
    if how not in made:
        raise ValueError(f"unknown aggregate {how!r}")
    rows = df
    for k in keys:
        rows = rows.filter(~missing(df, k))
    if how == "median" and not approximate:
        return _medians(rows, keys, column)
    return rows.groupBy(*[name(k) for k in keys]).agg(made[how]().alias(column)).orderBy(*[name(k) for k in keys])


def _medians(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    as_number, back = numbered(rows, column)
    found = group_quantiles(rows, [name(k) for k in keys], as_number, [0.5])
    ks = [f"k{i}" for i in range(len(keys))]
    return found.orderBy(*ks).select(*[F.col(n).alias(k) for n, k in zip(ks, keys)], back(F.get("q", F.lit(0))).alias(column))


def count_distinct(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """One row: distinct present values."""
    c = present(df, column)
    return df.agg((F.approx_count_distinct(c) if approximate else F.count_distinct(c)).alias("distinct_count"))
