"""Filters, sort, pages, positions, search and fills, with missing cells and many partition counts."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tidyframe.dtypes import label, physical, py_literal, typed_literal
from tidyframe.operators import filters, ordering
from tidyframe.operators.filters import FilterSpec as Spec


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("Alice", 30, "NY", 50000), ("Bob", 25, "LA", 60000), ("Carol", None, "SF", None), ("Dave", 45, "NY", 75000)], "name string, age bigint, city string, salary bigint")


@pytest.fixture(scope="module")
def messy(spark):
    import datetime as dt

    rows = [(1, " a ", 1.0, True, dt.datetime(2024, 1, 1)), (2, "A", float("nan"), False, None), (3, None, None, None, dt.datetime(2024, 5, 1, 12)), (4, "b.c", -0.0, True, dt.datetime(2023, 1, 1)), (5, "B.C", 0.0, None, None), (6, "a", float("inf"), False, dt.datetime(2024, 1, 1))]
    return spark.createDataFrame(rows, "id bigint, k string, v double, b boolean, ts timestamp")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_people(people):
    names = lambda df: [r.name for r in df.collect()]
    assert names(ordering.sort_rows(people, ["age"])) == ["Bob", "Alice", "Dave", "Carol"]
    assert names(ordering.sort_rows(people, [("age", True)])) == ["Dave", "Alice", "Bob", "Carol"]
    assert names(ordering.view(people, [Spec("city", "eq", "NY")], [("age", True)])) == ["Dave", "Alice"]
    assert [r.row_position for r in ordering.search_values(people, "name", "A", ["name"]).orderBy("row_position").collect()] == [0, 2, 3]
    assert tuple(ordering.view_row_count(people, [Spec("city", "eq", "NY")]).first()) == (2, 4)


@pytest.mark.parametrize(
    "spec,want",
    [
        (Spec("v", "ne", "1"), [4, 5, 6]),
        (Spec("v", "gt", "0.5"), [1, 6]),
        (Spec("v", "eq", 0), [4, 5]),
        (Spec("v", "is_missing"), [2, 3]),
        (Spec("v", "is_not_missing"), [1, 4, 5, 6]),
        (Spec("v", "is_duplicated"), [4, 5]),
        (Spec("v", "is_unique"), [1, 6]),
        (Spec("k", "eq", "a", True), [2, 6]),
        (Spec("k", "contains", "."), [4, 5]),
        (Spec("k", "regex", "^b.c$", True), [4, 5]),
        (Spec("k", "ends_with", "C", True), [4, 5]),
        (Spec("k", "gt", "a"), [4]),
        (Spec("b", "eq", "1"), [1, 4]),
        (Spec("b", "ne", "true"), [2, 6]),
        (Spec("ts", "gte", "2024-01-01 00:00:00"), [1, 3, 6]),
        (Spec("ts", "eq", "1704067200000"), [1, 6]),
        (Spec("ts", "contains", "12:00"), [3]),
        (Spec("id", "starts_with", "4"), [4]),
    ],
)
def test_predicates(messy, spec, want):
    assert ids(filters.apply_filters(messy, [spec])) == want


def test_errors(messy):
    for spec in (Spec("id", "gt", "x"), Spec("id", "odd"), Spec("none", "eq", 1), Spec("b", "gt", "1")):
        with pytest.raises(ValueError):
            filters.apply_filters(messy, [spec])
    with pytest.raises(ValueError):
        ordering.page(messy, [])
    with pytest.raises(ValueError):
        filters.filter_step(messy, "id", "odd")


def test_repeats_count_all_rows_and_steps_differ(spark, messy):
    both = [Spec("k", "is_duplicated"), Spec("id", "gt", 4)]
    doubled = messy.unionAll(messy.filter("id = 6"))
    assert ids(filters.apply_filters(doubled, both)) == [6, 6]
    twice = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "b"), (5, "a")], "id bigint, x string")
    assert ids(filters.apply_filters(twice, [Spec("x", "is_duplicated")])) == [3, 5]
    assert ids(filters.filter_step(twice, "x", "is_duplicated")) == [1, 2, 3, 5]
    assert ids(filters.filter_step(twice, "x", "is_unique")) == [4]
    assert ids(filters.filter_step(twice, "x", "not_equals", "a")) == [1, 2, 4]
    assert ids(filters.filter_step(twice, "id", "greater_than", "3.5")) == [4, 5]


def test_quick_merge():
    a, b, c = Spec("x", "is_missing"), Spec("x", "is_unique"), Spec("y", "eq", 1)
    merged = filters.quick_merge(filters.quick_merge([a, b, c], Spec("x", "is_not_missing")), c)
    assert merged == [b, c, Spec("x", "is_not_missing")]
    assert filters.quick_merge([b], Spec("x", "is_duplicated")) == [Spec("x", "is_duplicated")]


@pytest.mark.parametrize("text,value", [("true", True), ("None", None), ("7", 7), ("-1.5", -1.5), ("1e3", 1000.0), (" 7", " 7"), ("7d", "7d"), ("", "")])
def test_py_literal(text, value):
    assert py_literal(text) == value and type(py_literal(text)) is type(value)


def test_labels(messy):
    assert [label(f.dataType) for f in messy.schema] == ["integer", "string", "float", "boolean", "datetime"]
    assert [physical(f.dataType) for f in messy.schema] == ["int64", "utf8", "float64", "bool", "datetime"]
    with pytest.raises(ValueError):
        typed_literal(messy.schema["v"].dataType, "x")


@settings(max_examples=12, deadline=None, database=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.one_of(st.none(), st.floats(-5, 5), st.just(float("nan")))), min_size=1, max_size=60, unique_by=lambda x: x[0]), st.sampled_from(["1", "2", "7"]))
def test_fills_and_positions(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "t bigint, v double").repartition(3)
        for backward in (False, True):
            held, want = None, {}
            for t, v in sorted(rows, reverse=backward):
                held = held if v is None or math.isnan(v) else v
                want[t] = held
            assert {r.t: r.v for r in ordering.fill_in_order(df, "v", "t", backward).collect()} == want
        place = {t: i for i, (t, _) in enumerate(sorted(rows, key=lambda r: -r[0]))}
        assert {r.t: r.row_position for r in ordering.row_position(df, [("t", True)]).collect()} == place
        assert [r.t for r in ordering.page_by_position(df, ["t"], 1, 4).collect()] == sorted(place)[1:4] == [r.t for r in ordering.page(df, ["t"], 1, 4).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
