"""Profiles that grow by parts: a sketch for each part and column is stored, and all parts are merged without reading their rows again.

Counts, sums, moments and ends merge exactly. Distinct values are HyperLogLog sketches (2 ** LG registers:
standard error 1.04 / 2 ** (LG / 2), 1.6 % at 12), quantiles KLL sketches (rank error about 1.3 % at K 200), frequent values
keep ITEMS counters, so that a count is off by at most about rows / ITEMS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..dtypes import format_cell, kind_of, label, missing, name, present

#: Sizes of the three sketches.
LG, K, ITEMS = 12, 200, 4096
QUARTILES = (0.25, 0.5, 0.75)


def _number(df: DataFrame, column: str) -> Column:
    kind, c = label(kind_of(df, column)), present(df, column)
    if kind == "datetime":
        return F.unix_millis(c.cast("timestamp")).cast("double")
    return c.cast("double") if kind in ("integer", "float") else F.lit(None).cast("double")


def _text(df: DataFrame, column: str) -> Column:
    """The cell's text; datetimes with their microseconds, so that those of one second stay apart."""
    if label(kind_of(df, column)) == "datetime":
        return F.date_format(present(df, column).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return format_cell(df, column)


def sketch_parts(df: DataFrame, part: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each value of ``part`` (as text; missing is one of its own) and column: exact counts and moments, and sketches.

    Rows are unpivoted once and reduced before the shuffle, so that a part with most of the rows is no burden.
    Datetimes count as epoch milliseconds. An empty table gives no rows.
    """
    columns = [c for c in (columns or df.columns) if c != part]
    cells = [F.struct(F.lit(c).alias("column"), F.lit(label(kind_of(df, c))).alias("kind"), missing(df, c).alias("gone"), _text(df, c).alias("text"), _number(df, c).alias("number")) for c in columns]
    long = df.select(format_cell(df, part).alias("part"), F.inline(F.array(*cells)))
    return long.groupBy("part", "column", "kind").agg(
        F.count_if(~F.col("gone")).alias("count"),
        F.count_if("gone").alias("missing"),
        F.count("number").alias("numbers"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.sum("number").alias("sum"),
        (F.var_pop("number") * F.count("number")).alias("m2"),
        F.hll_sketch_agg("text", LG).alias("distinct_sketch"),
        F.kll_sketch_agg_double("number", K).alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(text, {ITEMS})").alias("top_sketch"),
    )


def update_profile(df: DataFrame, path: str, part: str, columns: Sequence[str] | None = None) -> None:
    """Writes the sketches of the parts in ``df`` below ``path``; those that are there already are replaced, others stay untouched.

    A part must be given whole. Doing so again, after a failure say, changes nothing.
    """
    rows = sketch_parts(df, part, columns).withColumn("of_part", F.coalesce(F.col("part"), F.lit("(missing)")))
    rows.write.partitionBy("of_part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("of_part")


def merged_profile(sketches: DataFrame, top: int = 5) -> DataFrame:
    """A row for each column over all parts of ``sketches``, which may be filtered by part first.

    column, kind, parts, count, missing, min, max, sum, mean, std_pop: exact up to the rounding of doubles. distinct,
    p25, p50, p75 and ``top`` (value, count) are estimates; see the module for their errors. ``top`` leaves out values that
    are no more frequent than its error, so that it is empty for a column of very many values, all rare. Sketches of one
    column under several kinds are rows of their own.
    """
    of_column = Window.partitionBy("column", "kind")
    mean = F.sum("sum").over(of_column) / F.sum("numbers").over(of_column)
    # the squares around the mean of all: each part's own, and its mean's distance
    moved = F.when(F.col("numbers") > 0, F.col("m2") + F.col("numbers") * F.pow(F.col("sum") / F.col("numbers") - F.col("mean"), 2))
    filled = sketches.withColumn("mean", F.when(F.sum("numbers").over(of_column) > 0, mean)).withColumn("moved", moved)
    merged = filled.groupBy("column", "kind").agg(
        F.count("*").alias("parts"),
        F.sum("count").alias("count"),
        F.sum("missing").alias("missing"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("sum").alias("sum"),
        F.first("mean").alias("mean"),
        F.sqrt(F.sum("moved") / F.sum("numbers")).alias("std_pop"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"),
        F.sum("numbers").alias("numbers"),
        F.kll_merge_agg_double("quantile_sketch").alias("q"),
        F.expr(f"approx_top_k_combine(top_sketch, {ITEMS})").alias("t"),
    )
    quartiles = [F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("q", F.lit(s))).alias(f"p{round(100 * s)}") for s in QUARTILES]
    most = F.transform(F.expr(f"approx_top_k_estimate(t, {int(top)})"), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("count")))
    return merged.select("column", "kind", "parts", "count", "missing", "min", "max", "sum", "mean", "std_pop", "distinct", *quartiles, F.filter(most, lambda x: x["value"].isNotNull()).alias("top"))
