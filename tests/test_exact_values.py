"""Values that text to the second, or a double, would change or confuse."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidyframe.operators import clean, diff, filters, profile
from tidyframe.operators.filters import FilterSpec

BIG = 2**53 + 1
AT = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def decimals(spark):
    return spark.createDataFrame([(1, Decimal("12345678901234567890.12"), BIG), (2, Decimal("12345678901234567890.99"), BIG - 1), (3, None, None)], "i int, d decimal(38,2), n bigint")


def ids(df):
    return sorted(x.i for x in df.collect())


def test_comparisons_of_decimals_and_large_numbers(decimals):
    one = "12345678901234567890.12"
    for op, want in (("eq", [1]), ("ne", [2]), ("gt", [2]), ("gte", [1, 2]), ("lt", []), ("lte", [1])):
        assert ids(filters.apply_filters(decimals, [FilterSpec("d", op, one)])) == want, op
    assert ids(filters.filter_step(decimals, "d", "equals", one)) == [1] and ids(filters.filter_step(decimals, "d", "not_equals", one)) == [2, 3]
    assert ids(filters.filter_step(decimals, "n", "greater_than", "9007199254740992.0")) == [1]
    assert ids(filters.filter_step(decimals, "n", "less_than", "9007199254740992.5")) == [2]
    assert ids(filters.filter_step(decimals, "n", "greater_than", 1e30)) == [] and ids(filters.filter_step(decimals, "n", "less_than", 1e60)) == [1, 2]
    with pytest.raises(ValueError):
        filters.apply_filters(decimals, [FilterSpec("d", "eq", "ten")])


def test_fills_change_no_present_cell(decimals):
    values = lambda df, c: [x[c] for x in df.orderBy("i").collect()]
    whole = clean.fill_missing(decimals, "n", "value", "7.0")
    assert dict(whole.dtypes)["n"] == "bigint" and values(whole, "n") == [BIG, BIG - 1, 7]
    small = decimals.filter("i <> 1")
    assert values(clean.fill_missing(small, "n", "value", "0.5"), "n") == [2.0**53, 0.5] and values(clean.fill_missing(small, "n", "mean"), "n") == [2.0**53] * 2
    for how in ({"method": "value", "value": "0.5"}, {"method": "mean"}, {"method": "median"}):
        with pytest.raises(Exception, match="would change"):
            clean.fill_missing(decimals, "n", **how).collect()
    assert values(clean.fill_missing(decimals, "n", "mode"), "n") == [BIG, BIG - 1, BIG - 1]
    for how in ({"method": "value", "value": "0.5"}, {"method": "mean"}, {"method": "median"}, {"method": "mode"}):
        got = clean.fill_missing(decimals, "d", **how)
        assert dict(got.dtypes)["d"] == "decimal(38,2)" and values(got, "d")[:2] == [Decimal("12345678901234567890.12"), Decimal("12345678901234567890.99")] and values(got, "d")[2] is not None
    fine = clean.fill_missing(decimals.select("i", F.col("i").cast("decimal(5,1)").alias("d")).withColumn("d", F.when(F.col("i") < 3, F.col("d"))), "d", "value", "0.125")
    assert dict(fine.dtypes)["d"] == "decimal(7,3)" and values(fine, "d") == [Decimal("1.000"), Decimal("2.000"), Decimal("0.125")]
    with pytest.raises(ValueError):
        clean.fill_missing(decimals, "d", "value", "0.125")


@pytest.fixture(scope="module")
def instants(spark):
    rows = [(1, AT), (2, AT + timedelta(milliseconds=100)), (3, AT + timedelta(milliseconds=100)), (None, AT)]
    return spark.createDataFrame(rows, "k int, at timestamp")


def test_changes_below_a_second(instants):
    moved = instants.withColumn("at", F.when(F.col("k") == 1, F.col("at") + F.expr("interval 10 milliseconds")).otherwise(F.col("at")))
    assert [tuple(x) for x in diff.changed_cells(instants, moved, ["k"]).collect()] == [(1, "at", "2024-01-01 12:00:00", "2024-01-01 12:00:00")]
    assert diff.diff_summary(instants, moved, ["k"]).first().cells_changed == 1


def test_missing_keys_meet(instants):
    moved = instants.withColumn("at", F.col("at") + F.expr("interval 1 day")).withColumn("new", F.lit(1))
    assert diff.diff_summary(instants, moved, ["k"]).first().cells_changed == 4
    assert sorted([x.k for x in diff.changed_cells(instants, moved, ["k"]).collect()], key=str) == [1, 2, 3, None]
    nan = instants.select(F.when(F.col("k") == 1, float("nan")).otherwise(F.col("k").cast("double")).alias("k"), "at")
    assert diff.diff_summary(nan, nan.withColumn("at", F.lit(None).cast("timestamp")), ["k"]).first().cells_changed == 4


def test_frequencies_by_value(instants):
    assert [tuple(x) for x in profile.top_n(instants, "at").collect()] == [("2024-01-01 12:00:00", 2), ("2024-01-01 12:00:00", 2)]
    domain = [(x.value, x.n) for x in profile.value_domain(instants).filter("column = 'at'").collect()]
    assert domain == [("2024-01-01 12:00:00", 2)] * 2 and profile.value_domain(instants, 1).filter("column = 'at'").count() == 0


def test_repeats_of_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}, [{"x": 1}]), (1, {"b": 2, "a": 1}, [{"x": 1}]), (2, None, None), (2, None, None), (1, {"a": 1}, None)], "i int, m map<string,int>, s array<map<string,int>>")
    assert clean.drop_duplicates(df).count() == 3 and clean.drop_duplicates(df, keep="none").count() == 1
    assert clean.drop_duplicates(df, ["m"], "first", order_by="i").count() == 3
