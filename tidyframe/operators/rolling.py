"""Exact medians and quantiles over frames that slide along an order."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..dtypes import group_key, kind_of, label, name, present, unused
from .ordering import row_position

#: Rows of a bin where frames are counted in rows, and about the rows of a task.
BIN_ROWS, TASK_ROWS = 4096, 20_000


def _slid(at: np.ndarray, value: np.ndarray, own: np.ndarray, reach: float, shares: Sequence[float]) -> np.ndarray:
    """For each own row the quantiles of values at [at - reach, at]; rows are in order, missing values are NaN."""
    out = np.full((int(own.sum()), len(shares)), np.nan)
    rows = np.flatnonzero(own)
    low, high = np.searchsorted(at, at[rows] - reach, "left").tolist(), np.searchsorted(at, at[rows], "right").tolist()
    values, held, first, last = value.tolist(), [], 0, 0
    for i, (a, b) in enumerate(zip(low, high)):
        if a >= last:  # nothing of the frame before is left
            held, first, last = [], a, a
        for x in values[last:b]:
            if x == x:
                insort(held, x)
        last = max(last, b)
        for x in values[first:a]:
            if x == x:
                del held[bisect_left(held, x)]
        first = max(first, a)
        if held:
            for j, share in enumerate(shares):
                place = (len(held) - 1) * share
                k = int(place)
                out[i, j] = held[k] if k == place else held[k] + (held[k + 1] - held[k]) * (place - k)
    return out


def rolling_quantiles(df: DataFrame, column: str, order_by: str, shares: Sequence[float] = (0.5,), partition_by: Sequence[str] = (), rows: int | None = None, within: float | None = None) -> DataFrame:
    """``df`` with a column for each share, {column}_q50 for the median: quantiles of a number over the frame that ends with the row.

    The frame is the last ``rows`` rows of equal ``partition_by``, or those whose ``order_by`` is at most
    ``within`` (datetimes: seconds) before the row's, those at the same moment included. Quantiles are linear
    between the two nearest ranks; missing values do not count, and a frame without any has null. Missing keys
    equal each other. Rows without ``order_by`` come last where rows are counted; else they have null. Values
    count as doubles.

    Rows are dealt to bins of the frame's reach (or BIN_ROWS rows), each of which also gets the bin before it, so that
    no task needs more than its bins; a key with most of the rows is many bins. A frame's rows must fit in a task.
    """
    if (rows is None) == (within is None):
        raise ValueError("give either rows or within")
    if label(kind_of(df, column)) not in ("integer", "float"):
        raise ValueError(f"{column} holds no numbers")
    at, value, k1, k2, bin_, own, bundle = unused(df.columns, "_at", "_value", "_k1", "_k2", "_bin", "_own", "_bundle")
    keys = [group_key(df, c) for c in partition_by]
    if rows is not None:
        if rows < 1:
            raise ValueError("a frame has at least one row")
        placed, reach, width = row_position(df, [*partition_by, order_by], at), rows - 1, max(rows, BIN_ROWS)
        placed = placed.withColumn(at, F.col(at).cast("double"))
    else:
        moment = label(kind_of(df, order_by)) == "datetime"
        reach = float(within) * (1e6 if moment else 1)
        width = reach or 1.0
        moved = present(df, order_by)
        placed = df.withColumn(at, (F.unix_micros(moved.cast("timestamp")) if moment else moved).cast("double"))
    hashes = {k1: F.xxhash64(*keys) if keys else F.lit(0).cast("bigint"), k2: F.xxhash64(F.lit("again"), *keys) if keys else F.lit(0).cast("bigint")}
    columns, named = df.columns, [f"{column}_q" + f"{100 * share:g}".replace(".", "_") for share in shares]
    ready = placed.withColumns(hashes | {value: present(df, column).cast("double"), bin_: F.floor(F.col(at) / width)})
    bundles = max(1, -(-2 * df.count() // TASK_ROWS))
    dealt = ready.filter(F.col(at).isNotNull()).withColumn(own, F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(bin_, F.when(F.col(own), F.col(bin_)).otherwise(F.col(bin_) + 1))
    dealt = dealt.withColumn(bundle, F.pmod(F.xxhash64(k1, k2, bin_), F.lit(bundles)))

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(k1, "ascending"), (k2, "ascending"), (bin_, "ascending"), (at, "ascending")]))
        ids = np.stack([table.column(c).to_numpy() for c in (k1, k2, bin_)])
        cuts = np.flatnonzero(np.append(True, (ids[:, 1:] != ids[:, :-1]).any(axis=0))).tolist()
        a, v = table.column(at).to_numpy(), table.column(value).to_numpy(zero_copy_only=False).astype(float)
        mine = table.column(own).to_numpy(zero_copy_only=False).astype(bool)
        found = [_slid(a[s:e], v[s:e], mine[s:e], reach, shares) for s, e in zip(cuts, [*cuts[1:], len(a)]) if mine[s:e].any()]
        q = np.concatenate(found) if found else np.zeros((0, len(shares)))
        kept = table.filter(pa.array(mine)).select(columns)
        for j, n in enumerate(named):
            kept = kept.append_column(n, pa.array(q[:, j], mask=np.isnan(q[:, j])))
        return kept

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in named]])
    out = dealt.groupBy(bundle).applyInArrow(run, schema)
    if within is None:
        return out
    late = placed.filter(F.col(at).isNull()).select(*[name(c) for c in df.columns], *[F.lit(None).cast("double").alias(n) for n in named])
    return out.unionByName(late)
