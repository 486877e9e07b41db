"""Indicator columns. Widths come from the data: one pass finds the values, one projection makes the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..dtypes import format_cell, name, present

MAX_CATEGORIES = 1000


def _bounded(values: DataFrame, most: int) -> list:
    found = [r[0] for r in values.filter(F.col(values.columns[0]).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} distinct values: raise the limit or group them first")
    return sorted(found)


def one_hot_encode(df: DataFrame, column: str, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """{column}_{value} for each value, in order, at the end; the source goes; missing is false everywhere."""
    values = _bounded(df.select(present(df, column).alias("_v"), format_cell(df, column).alias("_t")).select(F.struct("_v", "_t").alias("_s")).filter("_s._v is not null"), max_categories)
    c = present(df, column)
    rest = [name(x) for x in df.columns if x != column]
    return df.select(*rest, *[F.coalesce(c == F.lit(s["_v"]), F.lit(False)).alias(f"{column}_{s['_t']}") for s in values])


def multi_label_binarizer(df: DataFrame, column: str, delimiter: str = ",", max_labels: int = MAX_CATEGORIES) -> DataFrame:
    """A 0/1 column for each label of delimited texts, in order; the source stays; empty labels are none."""
    parts: Column = F.split(name(column), "\\Q" + delimiter + "\\E")
    labels = [x for x in _bounded(df.select(F.explode(parts).alias("_l")), max_labels) if x != ""]
    clash = sorted(set(labels) & set(df.columns))
    if clash:
        raise ValueError(f"labels are also names of columns: {clash}")
    return df.select("*", *[F.coalesce(F.array_contains(parts, x), F.lit(False)).cast("int").alias(x) for x in labels])
