"""Column statistics, histograms, frequencies, completeness and quality.

Exact quantiles come from counts of all numbers by (column, value) in range partitions. Distinct counts and frequencies come from one table of (column, value, count): the rows are
unpivoted once and counted partly before the shuffle, which later uses share (they count n, not
rows, so that their plans stay equal up to it).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..dtypes import format_cell, kind_of, label, missing, name, present
from ..session import checkpointed
from .quantile import dealt_by_value, quantiles

BINS, TOP_TEXT, TOP_BOOLEAN, DOMAIN = 12, 5, 2, 12
QUARTILES = (0.25, 0.5, 0.75)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): present values of each column, shown as text; datetimes of one second are values of their own."""
    columns = list(columns or df.columns)
    moments = [c for c in columns if label(kind_of(df, c)) == "datetime"]
    at = lambda c: F.unix_micros(present(df, c).cast("timestamp")) if c in moments else F.lit(None).cast("bigint")
    cells = [F.struct(F.lit(c).alias("column"), format_cell(df, c).alias("value"), *([at(c).alias("at")] if moments else [])) for c in columns]
    long = df.select(F.inline(F.array(*cells))).filter("value is not null")
    return long.groupBy("column", "value", *(["at"] if moments else [])).agg(F.count("*").alias("n")).select("column", "value", "n")


_NATIVE = {"integer": "bigint", "float": "double", "datetime": "timestamp", "boolean": "boolean"}


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct) of present values: columns of one kind are unpivoted together, in their own type."""
    found = []
    for kind in dict.fromkeys(_NATIVE.get(label(kind_of(df, c)), "string") for c in columns):
        own = [c for c in columns if _NATIVE.get(label(kind_of(df, c)), "string") == kind]
        cells = [F.struct(F.lit(i).alias("i"), (format_cell(df, c) if kind == "string" else present(df, c).cast(kind)).alias("v")) for i, c in enumerate(own)]
        counts = df.select(F.inline(F.array(*cells))).filter("v is not null").groupBy("i", "v").agg(F.count("*").alias("n")).groupBy("i").agg(F.count("n").alias("distinct"))
        found.append(counts.select(F.get(F.array(*[F.lit(c) for c in own]), F.col("i")).alias("column"), "distinct"))
    return reduce(DataFrame.unionByName, found)


def _numbers(df: DataFrame, columns: Sequence[str], ranked: Sequence[str]) -> DataFrame:
    """(column, distinct, q): distinct values of number and datetime columns, and quartiles of the ``ranked`` among them.

    Integers and datetimes are counted as whole numbers, the others as doubles, all in one pass.
    """
    def cell(i: int, c: str) -> Column:
        kind, v = label(kind_of(df, c)), present(df, c)
        whole = F.unix_micros(v.cast("timestamp")) if kind == "datetime" else v.cast("bigint") if kind == "integer" else F.lit(None).cast("bigint")
        return F.struct(F.lit(i).alias("i"), whole.alias("b"), (v.cast("double") if kind == "float" else F.lit(None).cast("double")).alias("d"))

    long = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).filter("b is not null or d is not null")
    dealt = dealt_by_value(long.groupBy("i", "b", "d").agg(F.count("*").alias("n")), ["i"], ["b", "d"])
    sought = dealt.filter(F.col("i").isin(*[i for i, c in enumerate(columns) if c in ranked]))
    q = quantiles(sought, ["i"], ["b", "d"], F.coalesce(F.col("d"), F.col("b").cast("double")), QUARTILES)
    found = dealt.groupBy("i").agg(F.count("n").alias("distinct")).join(F.broadcast(q), "i", "left")  # a row for each column
    return found.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("i")).alias("column"), "distinct", "q")


def _number(df: DataFrame, column: str) -> Column:
    c = present(df, column)
    return F.unix_millis(c.cast("timestamp")).cast("double") if label(kind_of(df, column)) == "datetime" else c.cast("double")


def _kinds(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema if label(f.dataType) in kinds]


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """A row for each column.

    count, missing, distinct; min, max, mean, std_pop, std_samp, sum, p25, p50, p75 of numbers; min
    and max of datetimes in epoch milliseconds; the most frequent value of texts and booleans,
    ties by value. ``approximate`` quantiles and distinct counts take one pass and little memory;
    exact ones sort the distinct values.
    """
    columns = list(columns or df.columns)
    aggregates = []
    for i, c in enumerate(columns):
        kind, v = label(kind_of(df, c)), _number(df, c) if label(kind_of(df, c)) in ("integer", "float", "datetime") else None
        aggregates += [F.count(present(df, c)).alias(f"{i}_count"), F.count_if(missing(df, c)).alias(f"{i}_missing")]
        if v is not None:
            aggregates += [F.min(v).alias(f"{i}_min"), F.max(v).alias(f"{i}_max")]
        if kind in ("integer", "float"):
            aggregates += [F.avg(v).alias(f"{i}_mean"), F.stddev_pop(v).alias(f"{i}_std_pop"), F.stddev_samp(v).alias(f"{i}_std_samp"), F.sum(v).alias(f"{i}_sum")]
            if approximate:
                aggregates.append(F.percentile_approx(v, list(QUARTILES), 10000).alias(f"{i}_q"))
        if approximate:
            aggregates.append(F.approx_count_distinct(present(df, c)).alias(f"{i}_distinct"))
    one = df.agg(*aggregates)
    have = set(one.columns)
    made = lambda i, what, kind="double": F.col(f"{i}_{what}") if f"{i}_{what}" in have else F.lit(None).cast(kind)
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(label(kind_of(df, c))).alias("kind"), F.col(f"{i}_count").alias("count"), F.col(f"{i}_missing").alias("missing"),
            *[made(i, w).alias(w) for w in ("min", "max", "mean", "std_pop", "std_samp", "sum")],
            *([made(i, "q", "array<double>").alias("q"), F.col(f"{i}_distinct").alias("distinct")] if approximate else []),
        )
        for i, c in enumerate(columns)
    ]
    stats = one.select(F.inline(F.array(*rows)))
    own = df.select(*[name(c) for c in columns])
    numbers, topped = _kinds(own, "integer", "float", "datetime"), _kinds(own, "string", "boolean")
    others = [c for c in columns if c not in numbers + topped]
    null = lambda **kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
    parts = []
    if topped:
        counts = value_counts(df, topped)
        parts.append(counts.groupBy("column").agg(F.count("n").alias("distinct")).join(_first_of(counts), "column", "left").select("column", "distinct", *null(q="array<double>"), "top_value", "top_count"))
    if not approximate:
        if numbers:
            parts.append(_numbers(df, numbers, _kinds(own, "integer", "float")).select("*", *null(top_value="string", top_count="bigint")))
        if others:
            parts.append(distinct_counts(df, others).select("column", "distinct", *null(q="array<double>", top_value="string", top_count="bigint")))
    if parts:
        found = reduce(DataFrame.unionByName, parts)
        stats = stats.join(F.broadcast(found.drop("distinct", "q") if approximate else found), "column", "left")  # a row for each column
    else:
        stats = stats.select("*", *null(top_value="string", top_count="bigint"))
    # quantiles of no values are an array of nulls or none at all
    quartiles = [F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p25", "p50", "p75"))]
    return stats.select("column", "kind", "count", "missing", F.coalesce("distinct", F.lit(0)).alias("distinct"), "min", "max", "mean", "std_pop", "std_samp", "sum", *quartiles, "top_value", "top_count")


def _first_of(counts: DataFrame) -> DataFrame:
    """(column, top_value, top_count): the most frequent value of each column, the smallest of ties; both steps combine partly."""
    most = counts.groupBy("column").agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(most), ["column", "n"]).groupBy("column").agg(F.min("value").alias("top_value"), F.first("n").alias("top_count"))


def top_n(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(value, count) of the n most frequent present values, shown as text, ties by value."""
    if label(kind_of(df, column)) != "datetime":
        counts = df.select(format_cell(df, column).alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("count"))
        return counts.orderBy(F.desc("count"), F.asc("value")).limit(n)
    counts = df.select(name(column).alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("count"))
    first = counts.orderBy(F.desc("count"), F.asc("value")).limit(n)
    return first.select(format_cell(first, "value").alias("value"), "count")


def _ends(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind, missing, lo, hi): a row for each column, from one pass that is made at once."""
    number = set(_kinds(df, "integer", "float", "datetime"))
    wanted = [(F.count_if(missing(df, c)), *(f(_number(df, c)) if c in number else F.lit(None).cast("double") for f in (F.min, F.max))) for c in columns]
    one = df.agg(*[x.alias(f"{what}{i}") for i, row in enumerate(wanted) for what, x in zip(("m", "lo", "hi"), row)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(label(kind_of(df, c))).alias("kind"), F.col(f"m{i}").alias("missing"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, c in enumerate(columns)]
    return checkpointed(one.select(F.inline(F.array(*rows))))


def _bins(df: DataFrame, columns: Sequence[str], bins: int, ends: DataFrame) -> DataFrame:
    """(column, bin, lower, upper, n) of equal widths over [min, max]; the last bin is closed; one bin where all values are equal."""
    ends = ends.filter("lo is not null").select("column", "lo", "hi")  # a row for each column
    values = [F.struct(F.lit(c).alias("column"), _number(df, c).alias("v")) for c in columns]
    long = df.select(F.inline(F.array(*values))).filter("v is not null")
    width, one = (F.col("hi") - F.col("lo")) / F.lit(bins), F.col("hi") == F.col("lo")
    at = F.when(one, F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1))).cast("int")
    counts = long.join(F.broadcast(ends), "column").groupBy("column", at.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.when(one, F.lit(0)).otherwise(F.lit(bins - 1)))).alias("bin"))
    upper = F.when(one | (F.col("bin") == bins - 1), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width)
    return every.join(F.broadcast(counts), ["column", "bin"], "left").select("column", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"), upper.alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, lower, upper, n), empty bins kept; datetimes in epoch milliseconds; an empty column has no rows."""
    return _bins(df, [column], bins, _ends(df, [column])).drop("column")


def quick_insights(df: DataFrame) -> DataFrame:
    """For every column its kind, missing and distinct, and on rows of their own the bins or top values.

    (column, kind, missing, distinct, slot, value, lower, upper, n): slots count bins or ranks from 0; a column
    with nothing to show has one row with slot null.
    """
    numbers, shown_as_text = _kinds(df, "integer", "float", "datetime"), _kinds(df, "string", "boolean")
    ends = _ends(df, df.columns)
    rest = [c for c in df.columns if c not in shown_as_text]
    parts, found = [], []
    null = lambda *names: [F.lit(None).cast(k).alias(n) for n, k in names]
    if shown_as_text:
        counts = value_counts(df, shown_as_text)
        found.append(counts.groupBy("column").agg(F.count("n").alias("distinct")))
        w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
        # a limit on the bare rank: Spark then keeps each task's first ranks alone before the shuffle
        ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP_TEXT).withColumn("slot", F.col("rank") - 1)
        most = F.when(F.col("column").isin(*_kinds(df, "boolean")), TOP_BOOLEAN).otherwise(TOP_TEXT)
        parts.append(ranked.filter(F.col("slot") < most).select("column", "slot", "value", *null(("lower", "double"), ("upper", "double")), "n"))
    if rest:
        found.append(distinct_counts(df, rest))
    if numbers:
        parts.append(_bins(df, numbers, BINS, ends).select("column", F.col("bin").alias("slot"), *null(("value", "string")), "lower", "upper", "n"))
    distinct = reduce(DataFrame.unionByName, found)
    out = ends.select("column", "kind", "missing").join(F.broadcast(distinct), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    if not parts:
        return out.select("*", *null(("slot", "int"), ("value", "string"), ("lower", "double"), ("upper", "double"), ("n", "bigint")))
    return out.join(reduce(DataFrame.unionByName, parts), "column", "left")


def value_domain(df: DataFrame, most: int = DOMAIN) -> DataFrame:
    """(column, value, n) of every column with at most ``most`` distinct values."""
    counts = value_counts(df)
    few = counts.groupBy("column").agg(F.count("n").alias("_d")).filter(F.col("_d") <= most).select("column")
    return counts.join(F.broadcast(few), "column", "left_semi")


def completeness(df: DataFrame) -> DataFrame:
    """One row: cells, missing cells, the share present in percent, and its band (high from 95, medium from 80, else low)."""
    gone = reduce(lambda a, b: a + b, [F.count_if(missing(df, c)) for c in df.columns], F.lit(0))
    one = df.agg((F.count("*") * len(df.columns)).alias("cells"), gone.alias("missing_cells"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.try_divide(100.0 * (F.col("cells") - F.col("missing_cells")), F.col("cells")), F.lit(100.0))))
    return one.withColumn("complete_pct", share).withColumn("band", F.when(F.col("complete_pct") >= 95, "high").when(F.col("complete_pct") >= 80, "medium").otherwise("low"))


def quality_report(df: DataFrame) -> DataFrame:
    """Per column: shares missing and unique, flags from 10 and 20 % missing, all missing, and the headline figure."""
    s = column_stats(df)
    total = F.col("count") + F.col("missing")
    gone = F.coalesce(F.try_divide(100.0 * F.col("missing"), total), F.lit(0.0))
    unique = F.coalesce(F.try_divide(100.0 * F.col("distinct"), F.col("count")), F.lit(0.0))
    numeric = F.col("kind").isin("integer", "float")
    return s.select(
        "column", "kind", gone.alias("missing_pct"), unique.alias("unique_pct"), (gone >= 10).alias("missing_10"), (gone >= 20).alias("missing_20"), (F.col("count") == 0).alias("all_missing"),
        F.when(gone >= 20, "missing").when(numeric, "mean").otherwise("unique").alias("headline"),
        F.when(gone >= 20, gone).when(numeric, F.col("mean")).otherwise(unique).alias("headline_value"), "top_value",
    )
