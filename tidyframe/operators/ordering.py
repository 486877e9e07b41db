"""Order, pages, positions, search and order-dependent fills."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..dtypes import format_cell, group_key, holds_map, kind_of, name, present, unused
from ..session import checkpointed, partitions_for
from .filters import FilterSpec, apply_filters

PAGE_ROWS = 500
Key = str | tuple[str, bool]


def sort_columns(df: DataFrame, keys: Sequence[Key]) -> list[Column]:
    """Sort expressions of columns, or (column, descending); missing last either way."""
    pairs = [(k, False) if isinstance(k, str) else k for k in keys]
    return [present(df, c).desc_nulls_last() if down else present(df, c).asc_nulls_last() for c, down in pairs]


def sort_rows(df: DataFrame, keys: Sequence[Key], order_by: Sequence[Key] = ()) -> DataFrame:
    """Rows by keys; ``order_by``, the load order, settles ties."""
    return df.orderBy(*sort_columns(df, [*keys, *order_by]))


def sort_step(df: DataFrame, columns: Sequence[str], ascending: bool = True, order_by: Sequence[Key] = ()) -> DataFrame:
    return sort_rows(df, [(c, not ascending) for c in columns], order_by)


def view(df: DataFrame, filters: Sequence[FilterSpec] = (), keys: Sequence[Key] = (), order_by: Sequence[Key] = ()) -> DataFrame:
    """Filters first, then the sort."""
    out = apply_filters(df, filters)
    return sort_rows(out, keys, order_by) if [*keys, *order_by] else out


def _need(order_by: Sequence[Key]) -> None:
    if not order_by:
        raise ValueError("order_by is needed: Spark's rows have no order of their own")


def page(df: DataFrame, order_by: Sequence[Key], start: int = 0, end: int | None = None) -> DataFrame:
    """Rows [start, end) in order, within bounds. First pages are a top-k; for deep ones use ``with_row_id``."""
    _need(order_by)
    start = max(0, start)
    end = start + PAGE_ROWS if end is None else max(start, end)
    return sort_rows(df, order_by).offset(start).limit(end - start)


def view_row_count(df: DataFrame, filters: Sequence[FilterSpec] = ()) -> DataFrame:
    """One row: rows that meet the filters, and all rows."""
    total = df.agg(F.count("*").alias("total_rows"))
    return apply_filters(df, filters).agg(F.count("*").alias("rows")).crossJoin(F.broadcast(total))


def _dealt(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows in sorted range partitions by keys; rows of one key are dealt on by their hash and where they come from."""
    hashed = [name(f.name) for f in df.schema if not holds_map(f.dataType)]
    tie, origin = unused(df.columns, "_tie", "_origin")
    marked = df.withColumns({tie: F.xxhash64(*hashed) if hashed else F.lit(0), origin: F.spark_partition_id()})
    order = [*keys, F.col(tie), F.col(origin)]
    return marked.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order).drop(tie, origin)


def row_position(df: DataFrame, order_by: Sequence[Key], into: str = "row_position") -> DataFrame:
    """Each row's position in order, from 0: range partitions, numbers within each, offsets from their counts."""
    _need(order_by)
    m, p, n, before = unused(df.columns, "_m", "_part", "_n", "_before")
    rows = checkpointed(_dealt(df, sort_columns(df, order_by)).withColumn(m, F.monotonically_increasing_id()))
    part, at = F.shiftright(m, 33), F.col(m).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias(p)).agg(F.count("*").alias(n))
    earlier = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select(p, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    joined = rows.withColumn(p, part).join(F.broadcast(offsets), p)
    return joined.select(*[name(c) for c in df.columns], (at + F.col(before)).alias(into))


with_row_id = row_position


def page_by_position(df: DataFrame, order_by: Sequence[Key], start: int, end: int) -> DataFrame:
    """Rows [start, end) however deep: no task gathers the rows before them."""
    (at,) = unused(df.columns, "_at")
    placed = row_position(df, order_by, at).filter(F.col(at).between(start, end - 1))
    return placed.orderBy(at).drop(at)


def search_values(df: DataFrame, column: str, query: str, order_by: Sequence[Key]) -> DataFrame:
    """Positions in order of rows whose cell's text holds the query, case folded."""
    keys = list(dict.fromkeys(k if isinstance(k, str) else k[0] for k in order_by))
    hit, at = unused(keys, "_hit", "row_position")
    shown = df.select(*[name(k) for k in keys], F.lower(format_cell(df, column)).contains(query.lower()).alias(hit))
    return row_position(shown, order_by, at).filter(hit).select(F.col(at).alias("row_position"))


def carry_last(df: DataFrame, column: str, order: Sequence[Column], keys: Sequence[Column] = ()) -> DataFrame:
    """``df`` with each null of a column replaced by the last value before it in order, among rows of equal keys.

    Rows are range-partitioned by key and order, so that a key with most of the rows is dealt to many
    tasks. Each sorted partition is filled as its Arrow batches pass, with the last value held; what a partition
    hands on to the next goes over a table of one row for each partition. A missing key equals a missing one.
    """
    place = df.columns.index(column)
    k1, k2, m, p, tail, carry = unused(df.columns, "_k1", "_k2", "_m", "_part", "_tail", "_carry")
    # two hashes of the keys stand for them: one could be equal for two keys of many
    marked = df.withColumns({k1: F.xxhash64(*keys), k2: F.xxhash64(F.lit("again"), *keys)}) if keys else df.withColumns({k1: F.lit(0).cast("bigint"), k2: F.lit(0).cast("bigint")})
    at_key = marked.columns.index(k1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column(place)
            key = np.stack([b.column(i).to_numpy() for i in (at_key, at_key + 1)])
            run = np.maximum.accumulate(np.where(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)), np.arange(b.num_rows), 0))
            last = np.maximum.accumulate(np.where(c.is_valid().to_numpy(zero_copy_only=False), np.arange(b.num_rows), -1))
            last = np.where(last >= run, last, -1)
            if held is not None and (key[:, 0] == own).all():
                last = np.where((last < 0) & (run == 0), b.num_rows, last)
                c = pa.concat_arrays([c, held])
            c = c.take(pa.array(last, mask=last < 0))
            held, own = (pa.concat_arrays([c[-1:]]) if c[-1].is_valid else None), key[:, -1].copy()
            yield b.set_column(place, b.schema.field(place), c)

    dealt = _dealt(marked, [F.col(k1), F.col(k2), *order]).mapInArrow(fill, marked.schema)
    rows = checkpointed(dealt.withColumn(m, F.monotonically_increasing_id())).withColumn(p, F.shiftright(m, 33))
    last = F.struct(F.col(k1).alias("k1"), F.col(k2).alias("k2"), name(column).alias("v"))
    tails = rows.groupBy(p).agg(F.max_by(last, F.col(m)).alias(tail)).withColumn(tail, F.when(F.col(tail)["v"].isNotNull(), F.col(tail)))
    earlier = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = tails.select(p, F.last(tail, ignorenulls=True).over(earlier).alias(carry))
    joined = rows.join(F.broadcast(carried), p)
    same = (F.col(carry)["k1"] == F.col(k1)) & (F.col(carry)["k2"] == F.col(k2))
    return joined.select(*[F.coalesce(name(c), F.when(same, F.col(carry)["v"])).alias(c) if c == column else name(c) for c in df.columns])


def fill_in_order(df: DataFrame, column: str, order_by: str, backward: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """Missing cells take the last present value before them (after them if backward) in order, among rows of equal ``partition_by``.

    Rows without a key of order come last. Missing keys equal each other. No task sees a whole key.
    """
    kind_of(df, column)
    value, at = present(df, column), present(df, order_by)
    present_only = df.select(*[value.alias(c) if c == column else name(c) for c in df.columns])
    return carry_last(present_only, column, [at.desc_nulls_first() if backward else at.asc_nulls_last()], [group_key(df, c) for c in partition_by])
