"""Profiles of nested JSON by path: which types occur where, how often a path is there, and where types conflict."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..dtypes import kind_of, label, name

#: Paths that a task counts before it hands them on.
PATHS = 50_000
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}
_COUNTED = "path string, parent string, kind string, rows bigint, n bigint"


def _step(key: str) -> str:
    """A key as a step of a path; keys that hold a dot, a bracket or a quote are quoted."""
    return f".{key}" if key and not set(key) & set('.[]"') else f".{json.dumps(key)}"


def _no_number(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def _walk(value: Any, path: str, parent: str | None, found: dict) -> None:
    """Counts the values at each path: found[path, parent, kind] = number."""
    left = [(value, path, parent)]
    while left:
        v, at, above = left.pop()
        key = (at, above, _KINDS[type(v)])
        found[key] = found.get(key, 0) + 1
        if isinstance(v, dict):
            left += [(x, at + _step(k), at) for k, x in v.items()]
        elif isinstance(v, list):
            left += [(x, f"{at}[]", at) for x in v]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (path, parent, kind): rows that have it, and values."""
    counts: dict[tuple, list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = list(zip(*[(*k, *v) for k, v in counts.items()])) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["path", "parent", "kind", "rows", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            found: dict[tuple, int] = {}
            try:
                if text is None:
                    found["$", None, "missing"] = 1
                else:
                    _walk(json.loads(text, parse_constant=_no_number), "$", None, found)
            except (ValueError, RecursionError):
                found = {("$", None, "invalid"): 1}
            for key, n in found.items():
                held = counts.setdefault(key, [0, 0])
                held[0] += 1
                held[1] += n
        if len(counts) >= PATHS:
            yield out()
            counts.clear()
    yield out()


def joined_type(kinds: Column) -> Column:
    """The least type of the lattice that holds all of some kinds: integer below number, null below everything, else ``mixed``."""
    real = F.array_sort(F.array_except(kinds, F.array(F.lit("null"), F.lit("missing"), F.lit("invalid"))))
    return F.when(F.size(real) == 0, "null").when(F.size(real) == 1, F.get(real, F.lit(0))).when(real == F.array(F.lit("integer"), F.lit("number")), "number").otherwise("mixed")


def merged(partial: DataFrame) -> DataFrame:
    """Sums of partial counts (path, parent, kind, rows, n), such as those of several days: they are counts again."""
    return partial.groupBy("path", "parent", "kind").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"))


def path_counts(df: DataFrame, column: str) -> DataFrame:
    """(path, parent, kind, rows, n): how many rows have a value of that kind at a path, and how many values; mergeable.

    The path of a row's own value is ``$``; keys follow after a dot, values of an array are ``[]``. A missing row counts as kind
    missing, text that is no JSON as invalid. Of repeated keys in an object the last counts.
    """
    if label(kind_of(df, column)) != "string":
        raise ValueError(f"{column} holds no text")
    return merged(df.select(name(column)).mapInArrow(_counted, _COUNTED))


def json_profile(counts: DataFrame) -> DataFrame:
    """A row for each path of ``path_counts``, or of several put together by ``merged``.

    path, type (the least that holds all its kinds), conflict (kinds that no type but ``mixed`` holds), n values and nulls among
    them, kinds (kind to number), and presence: of the objects or arrays that could have the path, the share that do; for
    values of an array their mean number.
    """
    by_path = counts.groupBy("path", "parent").agg(F.collect_set("kind").alias("found"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("n"))), F.lit(0)).alias("nulls"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    holders = counts.filter(F.col("kind").isin("object", "array")).groupBy(F.col("path").alias("parent"), "kind").agg(F.sum("n").alias("holders"))
    whole = counts.filter("path = '$'").agg(F.sum("n").alias("whole"))  # a single row
    holder = F.when(F.col("path").endswith("[]"), "array").otherwise("object")
    joined = by_path.withColumn("kind", holder).join(holders, ["parent", "kind"], "left").crossJoin(F.broadcast(whole))
    kind = joined_type(F.col("found"))
    return joined.select("path", kind.alias("type"), (kind == "mixed").alias("conflict"), "n", "nulls", F.map_from_entries("kinds").alias("kinds"), (F.col("n") / F.when(F.col("parent").isNull(), F.col("whole")).otherwise(F.col("holders"))).alias("presence"))
