"""View filters: predicates AND-ed over the rows, repeats counted over the whole column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..dtypes import exact_number, format_cell, is_exact, kind_of, label, may_be_nan, missing, name, present, py_literal, typed_literal, unused

COMPARE = ("eq", "ne", "gt", "gte", "lt", "lte")
TEXT = ("contains", "starts_with", "ends_with", "regex")
PRESENCE = ("is_missing", "is_not_missing")
REPEATS = ("is_duplicated", "is_unique")
STEP = ("equals", "not_equals", "greater_than", "less_than", "contains", "starts_with", "ends_with", *PRESENCE, *REPEATS)


@dataclass(frozen=True)
class FilterSpec:
    column: str
    op: str
    value: Any = None
    case_insensitive: bool = False


def _compared(c: Column, op: str, v: Column) -> Column:
    return {"eq": c == v, "ne": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]


def _on_text(c: Column, op: str, value: str, folded: bool) -> Column:
    if op == "regex":
        return c.rlike(("(?i)" if folded else "") + value)
    c, v = (F.lower(c), value.lower()) if folded else (c, value)
    return {"contains": c.contains, "starts_with": c.startswith, "ends_with": c.endswith}[op](v)


def predicate(df: DataFrame, spec: FilterSpec) -> Column:
    """The condition of a filter that looks at one row; a missing cell matches no value."""
    kind = kind_of(df, spec.column)
    if spec.op in PRESENCE:
        gone = missing(df, spec.column)
        return gone if spec.op == "is_missing" else ~gone
    if spec.op in TEXT:
        c = name(spec.column) if label(kind) == "string" else format_cell(df, spec.column)
        return _on_text(c, spec.op, str(spec.value), spec.case_insensitive)
    if spec.op not in COMPARE:
        raise ValueError(f"unknown filter {spec.op!r}")
    if label(kind) == "boolean" and spec.op not in ("eq", "ne"):
        raise ValueError("booleans can only be equal or not")
    c, v = name(spec.column), typed_literal(kind, spec.value)
    if label(kind) == "string" and spec.case_insensitive:
        c, v = F.lower(c), F.lit(str(spec.value).lower())
    found = _compared(c, spec.op, v)
    return found & ~F.isnan(c) if may_be_nan(kind) else found


def _counted(df: DataFrame, column: str, op: str, into: str) -> DataFrame:
    """Values that occur more than once, or once, in a column; keys only are shuffled, partly counted first."""
    counts = df.select(present(df, column).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > 1 if op == "is_duplicated" else F.col("n") == 1).select(F.col("v").alias(into))


def keep_repeats(df: DataFrame, column: str, op: str, counted_in: DataFrame | None = None, missing_repeat: bool = False) -> DataFrame:
    """Rows whose value is_duplicated or is_unique in ``counted_in`` (by default these rows).

    Missing values never match unless ``missing_repeat``: then they are equal to each other.
    """
    (v,) = unused(df.columns, "_v")
    values = _counted(counted_in if counted_in is not None else df, column, op, v)
    if missing_repeat:
        return df.join(values, present(df, column).eqNullSafe(F.col(v)), "left_semi")
    return df.join(values.filter(F.col(v).isNotNull()), present(df, column) == F.col(v), "left_semi")


def apply_filters(df: DataFrame, specs: Sequence[FilterSpec]) -> DataFrame:
    """Rows that meet all filters; repeats are counted before any of them is applied."""
    rows = [predicate(df, s) for s in specs if s.op not in REPEATS]
    out = df.filter(reduce(lambda a, b: a & b, rows)) if rows else df
    for s in specs:
        if s.op in REPEATS:
            out = keep_repeats(out, s.column, s.op, counted_in=df)
    return out


def quick_merge(specs: Sequence[FilterSpec], new: FilterSpec) -> list[FilterSpec]:
    """``specs`` with one more: it takes the place of its opposite on the column, exact repeats are dropped."""
    group = next((g for g in (PRESENCE, REPEATS) if new.op in g), ())
    kept = [s for s in specs if not (s.column == new.column and s.op in group)]
    return kept if new in kept else [*kept, new]


def filter_step(df: DataFrame, column: str, condition: str, value: Any = None, regex: bool = False) -> DataFrame:
    """A filter as a cleaning step: the value is typed by its form, missing cells are unequal to any value and repeat each other."""
    if condition not in STEP:
        raise ValueError(f"unknown condition {condition!r}")
    if condition in REPEATS:
        return keep_repeats(df, column, condition, missing_repeat=True)
    if condition in PRESENCE:
        return df.filter(predicate(df, FilterSpec(column, condition)))
    if condition in ("contains", "starts_with", "ends_with"):
        return df.filter(predicate(df, FilterSpec(column, "regex" if regex and condition == "contains" else condition, str(value))))
    kind = kind_of(df, column)
    v = py_literal(value)
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    if number and is_exact(kind):
        literal = exact_number(value)  # as written: a double would be equal to its neighbours too
    else:
        literal = F.lit(v) if number and label(kind) == "float" else typed_literal(kind, v)
    c = present(df, column)
    if condition == "not_equals":
        return df.filter(~c.eqNullSafe(literal))
    return df.filter(_compared(c, {"equals": "eq", "greater_than": "gt", "less_than": "lt"}[condition], literal))
