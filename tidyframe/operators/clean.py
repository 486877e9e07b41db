"""Cleaning steps on rows and columns."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..dtypes import FALSE_TOKENS, TRUE_TOKENS, exact_number, group_key, kind_of, label, may_be_nan, missing, name, present, py_literal, typed_literal, unused
from ..functions import numeric, text
from ..sources.files import parse_datetime
from .ordering import fill_in_order
from .quantile import group_quantiles, mode, numbered

MOST_PARTS = 1000


def _known(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        kind_of(df, c)


def replaced(df: DataFrame, column: str, value: Column) -> DataFrame:
    """The table with one column's cells replaced, in place."""
    _known(df, [column])
    return df.select(*[value.alias(c) if c == column else name(c) for c in df.columns])


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _known(df, columns)
    return df.select(*[name(c) for c in columns])


def drop_column(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    columns = [columns] if isinstance(columns, str) else columns
    _known(df, columns)
    return df.select(*[name(c) for c in df.columns if c not in columns])


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    _known(df, [column])
    return df.select(*[name(c).alias(new_name if c == column else c) for c in df.columns])


def clone_column(df: DataFrame, column: str, new_name: str | None = None) -> DataFrame:
    _known(df, [column])
    return df.withColumn(new_name or f"{column}_copy", name(column))


def formula_column(df: DataFrame, new_name: str, formula: str) -> DataFrame:
    """A new or replaced column from SQL text."""
    return df.withColumn(new_name, F.expr(formula))


def changed_type(df: DataFrame, column: str, to: str) -> Column:
    c, what = present(df, column), label(kind_of(df, column))
    if to == "string":
        return c.cast("string")
    if to == "float64":
        return (F.trim(c) if what == "string" else c).try_cast("double") if what != "datetime" else F.unix_millis(c).cast("double")
    if to == "int64":
        if what == "string":
            n = F.trim(c).try_cast("double")
            return F.coalesce(F.trim(c).try_cast("bigint"), F.when(n == F.floor(n), n.try_cast("bigint")))
        if what == "float":
            return F.when(c == F.floor(c), c.try_cast("bigint"))
        return F.unix_millis(c) if what == "datetime" else c.cast("bigint")
    if to == "boolean":
        if what == "string":
            return F.when(F.trim(c).isin(*TRUE_TOKENS), True).when(F.trim(c).isin(*FALSE_TOKENS), False)
        return c if what == "boolean" else c != 0
    if to == "datetime":
        if what == "string":
            return parse_datetime(c)
        return F.timestamp_millis(c.cast("bigint")) if what in ("integer", "float") else c.cast("timestamp")
    raise ValueError(f"unknown type {to!r}")


def change_type(df: DataFrame, column: str, to: str) -> DataFrame:
    """To int64, float64, string, boolean or datetime; what does not parse becomes missing."""
    return replaced(df, column, changed_type(df, column, to))


def drop_missing(df: DataFrame, columns: Sequence[str] = (), how: str = "any") -> DataFrame:
    """Rows without any (or with not all) of the columns' cells missing; no columns: all."""
    _known(df, columns)
    gone = [missing(df, c) for c in columns or df.columns]
    together = gone[0]
    for g in gone[1:]:
        together = together | g if how == "any" else together & g
    return df.filter(~together)


def drop_duplicates(df: DataFrame, columns: Sequence[str] = (), keep: str = "first", order_by: str | None = None) -> DataFrame:
    """One row (first or last by ``order_by``) of each group of equal keys, or only rows alone in theirs (none).

    Missing equals missing. A group is reduced before it is shuffled, so a hot key is no burden.
    A missing ``order_by`` comes last. Without ``order_by`` any row of a group may stay.
    """
    _known(df, columns)
    keys = [group_key(df, c) for c in columns or df.columns]
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[name(c) for c in df.columns])
    if keep == "none":
        kept = df.groupBy(*named).agg(F.any_value(row).alias("_r"), F.count("*").alias("_n")).filter("_n = 1")
    elif keep in ("first", "last"):
        if order_by is None and not columns and all(isinstance(f.dataType, T.AtomicType) and not may_be_nan(f.dataType) for f in df.schema):
            return df.dropDuplicates()
        pick = F.min_by if keep == "first" else F.max_by
        kept = df.groupBy(*named).agg(F.any_value(row).alias("_r")) if order_by is None else df.groupBy(*named).agg(pick(row, F.struct(missing(df, order_by), name(order_by))).alias("_r"))
    else:
        raise ValueError(f"unknown keep {keep!r}")
    return kept.select("_r.*")


def fill_missing(df: DataFrame, column: str, method: str = "value", value: Any = None, order_by: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """By a value, mean, median, mode (the smallest of ties), ffill or bfill.

    Present cells stay as they are. A whole column keeps its type where the fill is a whole number; a
    fraction, mean or median makes it a double, and a cell that no double holds is then an error.
    Decimals stay decimals: a value may add decimal places, means and medians are rounded to theirs.
    """
    c, kind = present(df, column), kind_of(df, column)
    if method == "value":
        v = py_literal(value)
        if not isinstance(v, (int, float)) or isinstance(v, bool) or label(kind) not in ("integer", "float"):
            return replaced(df, column, F.coalesce(c, typed_literal(kind, value)))
        if isinstance(kind, T.DecimalType):
            return replaced(df, column, _with_decimal(c, kind, value))
        if label(kind) == "integer":
            whole = isinstance(v, int) or v.is_integer()
            return replaced(df, column, F.coalesce(c, exact_number(int(v))) if whole else F.coalesce(_as_double(c, column), F.lit(float(v))))
        return replaced(df, column, F.coalesce(c, F.lit(v)))
    if method in ("ffill", "bfill"):
        if order_by is None:
            raise ValueError("order_by is needed: Spark's rows have no order of their own")
        return fill_in_order(df, column, order_by, method == "bfill", partition_by)
    (fill,) = unused(df.columns, "_fill")
    as_number, back = numbered(df, column)
    if method == "median":
        one = group_quantiles(df, [], as_number, [0.5]).agg(back(F.max(F.get("q", F.lit(0)))).alias(fill))
    elif method == "mode":
        one = mode(df, c).select(F.col("mode").alias(fill))
    elif method == "mean":
        one = df.agg(back(F.avg(as_number)).alias(fill))
    else:
        raise ValueError(f"unknown method {method!r}")
    filler = F.col(fill)
    if isinstance(kind, T.DecimalType):
        filler = F.round(filler, kind.scale).cast(kind)
    elif label(kind) == "integer" and method != "mode":
        c = _as_double(c, column)
    # ``one`` is a single row
    return replaced(df.crossJoin(F.broadcast(one)), column, F.coalesce(c, filler)).select(*[name(x) for x in df.columns])


def _as_double(c: Column, column: str) -> Column:
    """Whole numbers as doubles; one that no double holds is an error."""
    far = c.cast("double").cast("decimal(38,0)") != c.cast("decimal(38,0)")
    return F.when(far, F.raise_error(F.concat(F.lit(f"{column}: filling with a fraction would change "), c.cast("string")))).otherwise(c.cast("double"))


def _with_decimal(c: Column, kind: T.DecimalType, value: Any) -> Column:
    """A decimal column filled with a number, with as many places as either has."""
    number = Decimal(format(Decimal(str(value).strip()), "f"))
    _, digits, exponent = number.as_tuple()
    scale = max(kind.scale, -exponent)
    precision = max(kind.precision - kind.scale, len(digits) + exponent) + scale
    if precision > 38:
        raise ValueError(f"{value} and {kind.simpleString()} do not fit in 38 digits")
    wide = T.DecimalType(precision, scale)
    return F.coalesce(c.cast(wide), F.lit(number).cast(wide))


def find_replace(df: DataFrame, column: str, find: str, replacement: str, regex: bool = False) -> DataFrame:
    return replaced(df, column, text.replace_text(name(column).cast("string"), find, replacement, regex))


def text_step(function) -> Any:
    """A step that applies a text function to some columns."""

    def step(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
        own = [columns] if isinstance(columns, str) else list(columns)
        _known(df, own)
        return df.select(*[function(name(c)).alias(c) if c in own else name(c) for c in df.columns])

    return step


strip_whitespace = text_step(text.strip_whitespace)
lowercase = text_step(text.lowercase)
uppercase = text_step(text.uppercase)
capitalize = text_step(text.capitalize)
title_case = text_step(text.title_case)


def calc_text_length(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_length", text.text_length(name(column)))


def split_text(df: DataFrame, column: str, delimiter: str, max_splits: int = -1, n_parts: int | None = None, regex: bool = False, most_parts: int = MOST_PARTS) -> DataFrame:
    """Columns {column}_1 ... {column}_n beside the source; n: most parts in any row, unless given.

    Raises where a row has more than ``most_parts``: a table of as many columns is of no use.
    """
    parts = text.split_text(name(column).cast("string"), delimiter, max_splits, regex)
    n = n_parts or df.agg(F.max(F.size(parts))).first()[0] or 1
    if n > most_parts:
        raise ValueError(f"a row has {n} parts, more than {most_parts}: give max_splits, n_parts or a higher most_parts")
    return df.withColumns({f"{column}_{i + 1}": F.get(parts, F.lit(i)) for i in range(n)})


def scale_min_max(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    c = present(df, column)
    lo, hi = unused(df.columns, "_lo", "_hi")
    ends = df.agg(F.min(c).alias(lo), F.max(c).alias(hi))  # a single row
    wide = df.crossJoin(F.broadcast(ends))
    return replaced(wide, column, numeric.scaled(c, F.col(lo), F.col(hi), low, high)).drop(lo, hi)


def round_column(df: DataFrame, column: str, decimals: int = 0) -> DataFrame:
    return replaced(df, column, numeric.round_half_even(name(column), decimals))


def floor_column(df: DataFrame, column: str) -> DataFrame:
    return replaced(df, column, numeric.floor(present(df, column)))


def ceiling_column(df: DataFrame, column: str) -> DataFrame:
    return replaced(df, column, numeric.ceiling(present(df, column)))
