"""Names that clash, values at the edges of types, readers that lose nothing, and plans."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidyframe.dtypes import unused
from tidyframe.operators import aggregate, clean, diff, encode, filters, ordering, profile
from tidyframe.operators.filters import FilterSpec as Spec
from tidyframe.sources import files, quoted

OWN = ("_key", "_n", "_kept", "_found", "_score", "_v", "_p", "_m", "_part", "_fill", "_lo", "_hi", "_at", "_tail", "_carry", "_before", "_tie", "_origin", "_hit", "_odd", "_r", "_k0")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "a", 1.0), (2, "b", None), (3, None, 2.5), (4, "a", 2.5)]
    return spark.createDataFrame(rows, "id bigint, k string, v double").select("*", *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in OWN])


@pytest.mark.parametrize(
    "step",
    [
        lambda d: ordering.row_position(d, ["v", "id"], "at"),
        lambda d: ordering.page_by_position(d, ["id"], 0, 9),
        lambda d: ordering.page(d, ["id"]),
        lambda d: ordering.fill_in_order(d, "v", "id"),
        lambda d: ordering.fill_in_order(d, "v", "id", True),
        lambda d: ordering.fill_in_order(d, "v", "id", partition_by=["k"]),
        lambda d: filters.apply_filters(d, [Spec("v", "is_duplicated")]),
        lambda d: filters.filter_step(d, "k", "is_unique"),
        lambda d: clean.drop_duplicates(d, ["k"], "first", "id"),
        lambda d: clean.drop_duplicates(d, ["k"], "none"),
        lambda d: clean.fill_missing(d, "v", "mean"),
        lambda d: clean.fill_missing(d, "v", "median"),
        lambda d: clean.fill_missing(d, "k", "mode"),
        lambda d: clean.scale_min_max(d, "v"),
        lambda d: encode.one_hot_encode(d, "k"),
        lambda d: encode.multi_label_binarizer(d, "k"),
        lambda d: clean.split_text(d, "k", ","),
    ],
)
def test_own_columns_stay_as_they_are(clashing, step):
    got = step(clashing)
    assert set(OWN) <= set(got.columns)
    assert all(r[c] == f"{c}{r['id']}" for r in got.collect() for c in OWN)


def test_profiles_and_diffs_of_clashing_names(clashing):
    assert profile.column_stats(clashing).filter("distinct = 4").count() == len(OWN) + 1
    assert profile.quick_insights(clashing).filter("column = '_v'").count() == 4
    assert tuple(diff.diff_summary(clashing, clean.uppercase(clashing, "_v"), ["id"]).first())[:3] == (0, 0, 4)
    assert ordering.search_values(clashing, "_m", "M3", ["id"]).first()[0] == 2
    assert unused(["A", "a_"], "a", "b") == ["a__", "b"]


def test_floor_and_ceiling_of_large_numbers(spark):
    df = spark.createDataFrame([(1, 1e30), (2, -1e30), (3, float("inf")), (4, 2.0**53 + 2), (5, -2.5), (6, float("nan")), (7, None)], "id bigint, v double")
    got = [[r.v for r in f(df, "v").orderBy("id").collect()] for f in (clean.floor_column, clean.ceiling_column)]
    assert got[0] == [1e30, -1e30, math.inf, 2.0**53 + 2, -3.0, None, None] and got[1] == [1e30, -1e30, math.inf, 2.0**53 + 2, -2.0, None, None]


def test_bad_literals_raise(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id bigint, b boolean")
    assert filters.apply_filters(df, [Spec("b", "eq", "0")]).count() == filters.apply_filters(df, [Spec("b", "ne", True)]).count() == 1
    with pytest.raises(ValueError):
        filters.apply_filters(df, [Spec("b", "eq", "maybe")])


def test_averages_of_datetimes(spark):
    at = [dt.datetime(2024, 1, d) for d in (1, 3, 9)]
    df = spark.createDataFrame([("x", at[0]), ("x", at[1]), ("x", None), ("y", at[2])], "k string, t timestamp")
    for how in ("median", "mean"):
        assert {r.k: r.t for r in aggregate.group_by_agg(df, ["k"], "t", how).collect()} == {"x": dt.datetime(2024, 1, 2), "y": at[2]}
    assert clean.fill_missing(df, "t", "median").filter("t = timestamp'2024-01-03'").count() == 2
    assert clean.fill_missing(df.withColumn("t", F.col("t").cast("date")), "t", "mode").dtypes == [("k", "string"), ("t", "date")]


def test_split_width_is_bounded(spark):
    df = spark.createDataFrame([("a," * 1200,)], "x string")
    with pytest.raises(ValueError):
        clean.split_text(df, "x", ",")
    assert len(clean.split_text(df, "x", ",", 3).columns) == 5 and len(clean.split_text(df, "x", ",", n_parts=2).columns) == 3


def test_ties_are_placed_once(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.lit("same").alias("x")).repartition(5)
    got = ordering.row_position(df, ["k"]).collect()
    assert sorted(r.row_position for r in got) == list(range(3000)) and all(r.row_position < 1500 for r in got if r.k == 0)
    nested = spark.createDataFrame([(i, [i] if i % 3 == 0 else None, {"a": i}) for i in range(20)], "t bigint, v array<bigint>, m map<string,bigint>")
    assert [r.v for r in ordering.fill_in_order(nested, "v", "t").orderBy("t").collect()] == [[i - i % 3] for i in range(20)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert "WindowGroupLimit" in plan(profile.quick_insights(items))
    filled = plan(ordering.fill_in_order(items, "l_tax", "l_shipdate"))
    assert "hashpartitioning" not in filled.replace("hashpartitioning(_part", "")  # the rows are not shuffled a second time


def test_csv_loses_nothing(spark, tmp_path):
    (tmp_path / "late.csv").write_text("n,A,a\n" + "1,2,x\n" * 3000 + "hello,2.5,y\n")
    df = files.read_csv(spark, str(tmp_path / "late.csv"))
    assert df.dtypes == [("n", "string"), ("A", "double"), ("a_2", "string")] and df.filter("n = 'hello' and A = 2.5").count() == 1 and df.filter("n is null").count() == 0
    assert files.read_csv(spark, str(tmp_path / "late.csv"), sample=10).dtypes[0] == ("n", "bigint")
    (tmp_path / "wide.csv").write_text("a,_odd\n1,2\n3,4,5,2024-01-01\n6\n")
    wide = files.read_csv(spark, str(tmp_path / "wide.csv"))
    assert wide.dtypes == [("a", "bigint"), ("_odd", "bigint"), ("col_3", "bigint"), ("col_4", "timestamp")] and wide.count() == 3
    assert files.read_csv(spark, str(tmp_path / "wide.csv"), width=2).columns == ["a", "_odd"]
    assert quoted.split_starts(spark, str(tmp_path / "wide.csv"), ",", "utf-8") is None
    (tmp_path / "l.csv").write_bytes("a,b\n1,\xe9\n2,\"x\ny\"\n".encode("latin-1"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").collect()) == [(1, "é"), (2, "x\ny")]
    (tmp_path / "u.csv").write_bytes("a,b\n1,é\n".encode("utf-16"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "u.csv"), encoding="UTF-16").collect()] == [(1, "é")]


def test_json_keys(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text('{"Id": 1, "id": "x"}\n{"id": "y"}\n')
    df = files.read_jsonl(spark, str(tmp_path / "k.jsonl"))
    assert df.dtypes == [("Id", "bigint"), ("id_2", "string")] and sorted(r["id_2"] for r in df.collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "k.jsonl"), most_keys=1)


def test_partitions_follow_the_files(spark, monkeypatch):
    from tidyframe import session
    from tidyframe.operators import ordering

    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    assert session.partitions_for(df) == session.partitions_for(spark.range(10)) == 8
    monkeypatch.setattr(session, "PARTITION_BYTES", 50_000)
    assert 20 < session.partitions_for(df) == session.partitions_for(df.groupBy("l_orderkey").count()) < 60
    placed = ordering.row_position(df.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    assert placed.agg(F.count("*"), F.countDistinct("row_position"), F.max("row_position")).first()[:] == (60_000, 60_000, 59_999)
