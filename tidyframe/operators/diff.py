"""What a step changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..dtypes import format_cell, group_key, name, present, unused
from ..session import checkpointed
from .ordering import Key, page


def _common(before: DataFrame, after: DataFrame, key: Sequence[str]) -> list[str]:
    return [c for c in after.columns if c in before.columns and c not in key]


def _joined(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of both tables by key, a missing key being equal to a missing one: _k0.. keys, _a0.., _b0.. common cells, _in__a, _in__b."""
    columns, cells = _common(before, after, key), _text_or_value(before, after)

    def side(df: DataFrame, mark: str) -> DataFrame:
        keys = [name(k).alias(f"{mark}k{i}") for i, k in enumerate(key)]
        return df.select(*keys, *[cells(df, c).alias(f"{mark}{i}") for i, c in enumerate(columns)], F.lit(True).alias(f"_in_{mark}"))

    same = reduce(lambda x, y: x & y, [F.col(f"_ak{i}").eqNullSafe(F.col(f"_bk{i}")) for i in range(len(key))])
    both = side(before, "_a").join(side(after, "_b"), same, "full_outer")
    return both.withColumns({f"_k{i}": F.coalesce(f"_ak{i}", f"_bk{i}") for i in range(len(key))})


def _text_or_value(df: DataFrame, other: DataFrame) -> Callable[[DataFrame, str], Column]:
    """Cells of one type on both sides as they are, others as text."""
    same = {f.name for f in df.schema if f.name in other.columns and other.schema[f.name].dataType == f.dataType}
    return lambda d, c: present(d, c) if c in same else format_cell(d, c)


def _delta(before: DataFrame, after: DataFrame) -> tuple[Column, Column]:
    added = [c for c in after.columns if c not in before.columns]
    removed = [c for c in before.columns if c not in after.columns]
    return F.lit(",".join(added)).alias("columns_added"), F.lit(",".join(removed)).alias("columns_removed")


def diff_summary(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows_added, rows_removed (net), cells_changed over common columns, columns_added, columns_removed.

    Missing equals missing, in keys too. Cells are only compared if both tables have the same keys.
    """
    columns = _common(before, after, key)
    joined = _joined(before, after, key)
    changed = reduce(lambda a, b: a + b, [F.count_if(~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))) for i in range(len(columns))], F.lit(0))
    one = joined.agg(F.count("_in__a").alias("n_a"), F.count("_in__b").alias("n_b"), F.count_if(F.col("_in__a").isNull() | F.col("_in__b").isNull()).alias("alone"), changed.cast("bigint").alias("changed"))
    return one.select(
        F.greatest(F.lit(0), F.col("n_b") - F.col("n_a")).alias("rows_added"),
        F.greatest(F.lit(0), F.col("n_a") - F.col("n_b")).alias("rows_removed"),
        F.when(F.col("alone") == 0, F.col("changed")).otherwise(0).alias("cells_changed"),
        *_delta(before, after),
    )


def diff_of_row_step(df: DataFrame, new_cells: dict[str, Column]) -> DataFrame:
    """``diff_summary`` of a step that only replaces or adds cells row by row: one projection, no join."""
    old = [c for c in new_cells if c in df.columns]
    changed = reduce(lambda a, b: a + b, [F.count_if(~present(df, c).eqNullSafe(new_cells[c])) for c in old], F.lit(0))
    added = ",".join(c for c in new_cells if c not in df.columns)
    return df.agg(changed.cast("bigint").alias("cells_changed")).select(F.lit(0).cast("bigint").alias("rows_added"), F.lit(0).cast("bigint").alias("rows_removed"), "cells_changed", F.lit(added).alias("columns_added"), F.lit("").alias("columns_removed"))


def changed_cells(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., column, old_value, new_value) of every changed cell of rows in both tables; added columns are not flagged.

    Cells are compared by value and shown as text, so that a change below a second has equal texts.
    Missing equals missing, in keys too.
    """
    columns = _common(before, after, key)
    joined = _joined(before, after, key).filter("_in__a and _in__b")

    def cell(i: int, c: str) -> Column:
        old, new = f"_a{i}", f"_b{i}"
        return F.when(~F.col(old).eqNullSafe(F.col(new)), F.struct(F.lit(c).alias("column"), format_cell(joined, old).alias("old_value"), format_cell(joined, new).alias("new_value")))

    found = F.filter(F.array(*[cell(i, c) for i, c in enumerate(columns)]), lambda x: x.isNotNull())
    return joined.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)], F.inline(found))


def row_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(columns..., n_before, n_after): the rows that one table holds more often than the other, without any key.

    Rows are equal if all cells are; missing equals missing, NaN too, and the order of columns does not
    matter. Both tables must have the same columns; cells of unlike types are compared as text. An empty result
    means equal tables, repeats included.

    Only digests and counts of all rows are shuffled, counted partly before; whole rows follow for the
    digests that differ, and are then counted by all their cells, so that rows of one digest stay apart. Digests
    are two hashes of 64 bits, of which one names the row and the sum of the other verifies its count.
    """
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError(f"columns differ: {sorted(set(before.columns) ^ set(after.columns))}")
    cells = _text_or_value(before, after)
    columns = before.columns
    d, mark, n_a, n_b = unused(columns, "_digest", "_check", "n_before", "n_after")
    sides = [df.select(*[cells(df, c).alias(c) for c in columns]) for df in (before, after)]

    def digested(df: DataFrame, own: int) -> DataFrame:
        keys = [group_key(df, c) for c in columns]
        return df.select(F.xxhash64(*keys).alias(d), F.xxhash64(F.lit("again"), *keys).alias(mark), F.lit(own).alias(n_a))

    both = digested(sides[0], 1).unionByName(digested(sides[1], -1))
    odd = both.groupBy(d).agg(F.sum(n_a).alias(n_a), F.sum(F.col(mark).cast("decimal(38,0)") * F.col(n_a)).alias(mark)).filter(F.col(n_a).cast("boolean") | F.col(mark).cast("boolean")).select(d)
    odd = checkpointed(odd)

    def wanted(df: DataFrame, a: int) -> DataFrame:
        keys = [group_key(df, c) for c in columns]
        kept = df.withColumn(d, F.xxhash64(*keys)).join(odd, d, "left_semi")
        return kept.select(F.struct(*[group_key(kept, c).alias(f"k{i}") for i, c in enumerate(columns)]).alias(d), F.struct(*[name(c) for c in columns]).alias(mark), F.lit(a).alias(n_a), F.lit(1 - a).alias(n_b))

    counted = wanted(sides[0], 1).unionByName(wanted(sides[1], 0)).groupBy(d).agg(F.any_value(mark).alias(mark), F.sum(n_a).alias(n_a), F.sum(n_b).alias(n_b)).filter(F.col(n_a) != F.col(n_b))
    return counted.select(*[F.col(mark)[c].alias(c) for c in columns], n_a, n_b)


def preview(df: DataFrame, step: Callable[[DataFrame], DataFrame], key: Sequence[str], order_by: Sequence[Key], start: int = 0, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of a step's result, and what the step would change; nothing is kept."""
    after = step(df)
    return page(after, order_by, start, end), diff_summary(df, after, key)
