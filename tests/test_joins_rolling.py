"""Joins by time and overlap, sliding quantiles, and differences without a key, against brute force."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyframe.operators import clean, diff, joins, ordering, rolling


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def moments(spark):
    """One key holds most rows, and one moment of it many; keys and moments are missing."""
    r = random.Random(2)
    left = [(i, r.choice([1] * 9 + [2, 3, None]), r.choice([None, 7, 7, 7, *range(40)])) for i in range(500)]
    right = [(i, r.choice([1] * 9 + [2, 4, None]), r.choice([None, 7, *range(0, 40, 3)]), i % 5) for i in range(120)]
    return left, right, spark.createDataFrame(left, "i bigint, k int, t int").repartition(5), spark.createDataFrame(right, "i bigint, k int, t int, z int").repartition(3)


@pytest.mark.parametrize("direction,exact,tolerance", [("backward", True, None), ("backward", False, 3), ("forward", True, 2), ("forward", False, None)])
def test_as_of(spark, moments, direction, exact, tolerance):
    left, right, l, r = moments
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = joins.as_of_join(l, r, "t", by=["k"], direction=direction, exact=exact, tolerance=tolerance, ties=["z", "i"]).collect()
        assert len(got) == len(left)
        found = {x.i: x.i_right for x in got}
        for i, k, t in left:
            near = [(abs(t - x[2]), -x[3], -x[0], x[0]) for x in right if t is not None and x[2] is not None and k is not None and x[1] == k and (x[2] < t if direction == "backward" else x[2] > t)] if t is not None else []
            near += [(0, -x[3], -x[0], x[0]) for x in right if exact and t is not None and k is not None and x[1] == k and x[2] == t]
            best = min(near, default=None)
            assert found[i] == (best[3] if best and (tolerance is None or best[0] <= tolerance) else None)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_as_of_names_moments_and_edges(spark):
    """Datetimes with a tolerance in seconds, other names, clashing names, maps, empty sides."""
    at = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, at, "a"), (2, at + timedelta(seconds=5), "b")], "k int, ts timestamp, k_right string")
    right = spark.createDataFrame([(9, at + timedelta(seconds=2), {"m": 1})], "k int, moment timestamp, m map<string,int>")
    got = joins.as_of_join(left, right, "ts", "moment", tolerance=3.5)
    assert got.columns == ["k", "ts", "k_right", "k_right_", "moment", "m"]
    assert [(x.k, x.k_right_, x.m) for x in got.orderBy("k").collect()] == [(1, None, None), (2, 9, {"m": 1})]
    assert [x.k_right_ for x in joins.as_of_join(left, right, "ts", "moment", tolerance=2).orderBy("k").collect()] == [None, None]
    assert joins.as_of_join(left.limit(0), right, "ts", "moment").count() == 0
    assert [x.moment for x in joins.as_of_join(left, right.limit(0), "ts", "moment").collect()] == [None, None]
    with pytest.raises(ValueError):
        joins.as_of_join(left, right, "ts", "k")


def test_as_of_deals_a_hot_key_to_many_tasks(spark):
    """All rows have one key: no task of the sorted partitions holds them all."""
    left = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 20_000, 10).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = joins.as_of_join(left, right, "t", by=["k"])
    assert got.filter("v <> t - t % 10 or v is null").count() == 0
    sizes = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 8000


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("by", [(), ("k",)])
def test_overlaps(spark, closed, by):
    """Nested, touching, empty, reversed and very long intervals; each pair comes once."""
    r = random.Random(3)

    def made(n):
        for i in range(n):
            s = r.choice([None, *range(1000)])
            yield i, r.choice([1] * 5 + [2, None]), s, None if s is None else s + r.choice([0, 1, 2, 5, 5, 5, 50, 700, -3, 10**7])

    a, b = list(made(200)), list(made(220))
    df, other = (spark.createDataFrame(x, "i int, k int, s int, e int") for x in (a, b))
    good = lambda x: x[2] is not None and (x[2] <= x[3] if closed else x[2] < x[3])
    meet = lambda x, y: max(x[2], y[2]) <= min(x[3], y[3]) if closed else max(x[2], y[2]) < min(x[3], y[3])
    want = sorted((x[0], y[0]) for x in a for y in b if good(x) and good(y) and meet(x, y) and (not by or x[1] is not None and x[1] == y[1]))
    got = joins.overlap_join(df, other, ("s", "e"), by=by, closed=closed)
    assert sorted((x.i, x.i_right) for x in got.collect()) == want and len(want) > 500
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins.overlap_join(df.limit(0), other, ("s", "e"), by=by).count() == 0


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_in_crowded_cells(spark, monkeypatch, closed):
    """Many intervals at one moment, equal rows, maps, negative, fractional and infinite bounds; small blocks, cells that are joined and broadcast."""
    r = random.Random(7)
    inf = float("inf")

    def made(n):
        for i in range(n):
            s = r.choice([5.0] * 6 + [-inf, -0.0, *[x / 3 for x in range(-90, 90)]])
            yield i // 2, s, r.choice([inf, s, s + 0.1, s + 1, s + 1, s + 2.5, s + 40, s + 1e300]), {"m": i // 2}

    a, b = list(made(150)), list(made(170))
    df, other = (spark.createDataFrame(x, "i int, s double, e double, m map<string,int>").repartition(3) for x in (a, b))
    good = lambda x: x[1] <= x[2] if closed else x[1] < x[2]
    meet = lambda x, y: max(x[1], y[1]) <= min(x[2], y[2]) if closed else max(x[1], y[1]) < min(x[2], y[2])
    want = sorted((x[0], y[0]) for x in a for y in b if good(x) and good(y) and meet(x, y))
    monkeypatch.setattr(joins, "CELL_ROWS", 4)
    for cells in (100, 0):
        monkeypatch.setattr(joins, "BROADCAST_CELLS", cells)
        assert sorted((x.i, x.i_right) for x in joins.overlap_join(df, other, ("s", "e"), closed=closed).collect()) == want


def test_overlaps_with_long_intervals_are_dealt_to_small_cells(spark, tmp_path):
    """300 intervals over 15,000 others each: no task repeats all of these for each, so that the written pairs repeat what is near."""
    r = random.Random(8)
    a = spark.createDataFrame([(r.getrandbits(60), s, s + 15_000) for s in (r.randrange(5000) for _ in range(300))], "i bigint, s int, e int")
    b = spark.createDataFrame([(r.getrandbits(60), s, s + 1) for s in range(20_000)], "i bigint, s int, e int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins.overlap_join(a, b, ("s", "e")).select("i", "i_right").write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 300 * 15_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 300 * 15_000


def test_overlaps_of_many_left_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    """20,000 rows at one moment meet 10 others: their pairs are no one task's."""
    for c, n in {"CELL_LEFT_ROWS": 500, "TASK_PAIRS": 10_000}.items():
        monkeypatch.setattr(joins, c, n, raising=False)
    a = spark.range(20_000).select(F.col("id").alias("i"), F.lit(5).alias("s"), F.lit(7).alias("e"))
    b = spark.range(12).select(F.col("id").alias("i"), F.col("id").cast("int").alias("s"), F.lit(20).alias("e")).filter("s <> 7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.overlap_join(a, b, ("s", "e"), closed=True).select("i", "i_right", F.spark_partition_id().alias("p"))
        sizes = [x["count"] for x in got.filter("i_right < 7").groupBy("p").count().collect()]
        assert got.filter("i_right < 7").select("i", "i_right").distinct().count() == sum(sizes) == got.count() == 140_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) >= 8 and max(sizes) < 50_000


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_by_chunks_and_runs(spark, monkeypatch, closed):
    """Runs of equal bounds, chunks that a left row meets wholly, in part and not; left and right blocks, many tasks."""
    r = random.Random(9)

    def made(n):
        for i in range(n):
            s = r.choice([3, 3, 3, 4, *range(40)])
            yield i, r.choice(["x", "x", "y", None]), s, s + r.choice([1, 2, 2, 2, 9, 30])

    a, b = list(made(160)), list(made(190))
    df, other = (spark.createDataFrame(x, "i int, k string, s int, e int").repartition(3) for x in (a, b))
    meet = lambda x, y: max(x[2], y[2]) <= min(x[3], y[3]) if closed else max(x[2], y[2]) < min(x[3], y[3])
    want = sorted((*x, y[0], *y[2:]) for x in a for y in b if x[1] is not None and x[1] == y[1] and meet(x, y))
    for sizes in ({"CHUNK_ROWS": 5, "RUN_ROWS": 3, "CELL_ROWS": 40, "CELL_LEFT_ROWS": 20, "TASK_PAIRS": 1000}, {"CHUNK_ROWS": 4, "RUN_ROWS": 1000}):
        for c, n in sizes.items():
            monkeypatch.setattr(joins, c, n, raising=False)
        assert sorted(map(tuple, joins.overlap_join(df, other, ("s", "e"), by=["k"], closed=closed).collect())) == want


def test_overlap_of_datetimes(spark):
    at = datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, at, at + timedelta(days=400)), (2, at, at + timedelta(seconds=1))], "i int, s timestamp, e timestamp")
    b = spark.createDataFrame([(5, at + timedelta(days=399), at + timedelta(days=399, seconds=2)), (6, at + timedelta(seconds=1), at + timedelta(seconds=3))], "i int, x timestamp, y timestamp")
    assert sorted((x.i, x.i_right) for x in joins.overlap_join(a, b, ("s", "e"), ("x", "y")).collect()) == [(1, 5), (1, 6)]


def quantile(values, share):
    return float(np.quantile(values, share)) if values else None


@pytest.mark.parametrize("parts", ["1", "5"])
@pytest.mark.parametrize("rows,within", [(1, None), (7, None), (5000, None), (None, 0), (None, 11), (None, 10_000)])
def test_sliding_quantiles(spark, monkeypatch, parts, rows, within):
    """A hot key, missing values and keys, equal moments, frames longer than the table; small bins and tasks."""
    monkeypatch.setattr(rolling, "BIN_ROWS", 40)
    monkeypatch.setattr(rolling, "TASK_ROWS", 150)
    r = random.Random(4)
    data = [(i, r.choice([1] * 8 + [2, None]), i if rows else r.choice([None, *range(300)]), r.choice([None, float("nan"), *[x / 4 for x in range(40)]])) for i in range(400)]
    df = spark.createDataFrame(data, "i int, k int, t int, v double").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {x.i: (x["v_q50"], x["v_q90"]) for x in rolling.rolling_quantiles(df, "v", "t", [0.5, 0.9], ["k"], rows, within).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(data)
    for i, k, t, _ in data:
        mine = [x for x in data if x[1] == k]
        frame = sorted((x for x in mine if x[2] <= t), key=lambda x: x[2])[-rows:] if rows else [x for x in mine if t is not None and x[2] is not None and t - within <= x[2] <= t]
        values = [x[3] for x in frame if x[3] is not None and x[3] == x[3]]
        assert got[i] == pytest.approx((quantile(values, 0.5), quantile(values, 0.9)))


def test_sliding_quantiles_of_datetimes_and_edges(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(at + timedelta(seconds=s), v) for s, v in ((0, 1), (60, 5), (61, 3), (200, None))], "t timestamp, _at int")
    assert [x["_at_q50"] for x in rolling.rolling_quantiles(df, "_at", "t", within=60).orderBy("t").collect()] == [1, 3, 4, None]
    assert rolling.rolling_quantiles(df.limit(0), "_at", "t", rows=3).count() == 0
    for wrong in ({}, {"rows": 1, "within": 1}, {"rows": 0}):
        with pytest.raises(ValueError):
            rolling.rolling_quantiles(df, "_at", "t", **wrong)


def test_difference_without_a_key(spark):
    """As multisets, null and NaN equal, maps and arrays too; columns in another order."""
    nan = float("nan")
    a = [(1, "x", 1.0, {"m": 1, "n": 2}), (1, "x", 1.0, {"n": 2, "m": 1}), (None, None, nan, None), (2, "y", -0.0, {}), (3, "z", 3.0, None)]
    b = [(1, "x", 1.0, {"m": 1, "n": 2}), (None, None, nan, None), (None, None, nan, None), (2, "y", 0.0, {}), (4, "z", 3.0, None)]
    df, other = (spark.createDataFrame(x, "i int, s string, v double, m map<string,int>") for x in (a, b))
    got = {(x.i, x.n_before, x.n_after) for x in diff.row_difference(df, other.select("m", "v", "s", "i")).collect()}
    assert got == {(1, 2, 1), (None, 1, 2), (3, 1, 0), (4, 0, 1)}
    assert diff.row_difference(df, df.repartition(3)).count() == diff.row_difference(df.limit(0), df.limit(0)).count() == 0
    assert diff.row_difference(df, df.limit(0)).count() == 4
    with pytest.raises(ValueError):
        diff.row_difference(df, df.drop("i"))


def test_difference_equals_except_all(spark, monkeypatch):
    r = random.Random(5)
    make = lambda: [(r.choice([None, *range(6)]), r.choice(["a", "b", None])) for _ in range(300)]
    a, b = make(), make()
    df, other = (spark.createDataFrame(x, "n_before int, _digest string") for x in (a, b))
    got = diff.row_difference(df, other).collect()
    left, right = Counter(a), Counter(b)
    assert {(tuple(x)[:2]): (tuple(x)[2:]) for x in got} == {k: (left[k], right[k]) for k in left | right if left[k] != right[k]}
    # one digest for all rows: whole rows still stay apart
    hashed = F.xxhash64
    monkeypatch.setattr(diff.F, "xxhash64", lambda *c: hashed(F.lit(1)))
    assert sorted(map(str, diff.row_difference(df, other.limit(299)).collect())) != [] and diff.row_difference(df, df).count() == 0


def test_fills_by_a_hot_key(spark):
    """Keys fill on their own, over the edges of partitions, whatever their type; a missing key is one key."""
    r = random.Random(6)
    data = [(i, r.choice(["hot"] * 8 + ["b", None]), r.choice([None] * 6 + [i])) for i in range(900)]
    df = spark.createDataFrame(data, "t int, k string, v int").repartition(7)
    for backward in (False, True):
        held, want = {}, {}
        for t, k, v in sorted(data, reverse=backward):
            held[k] = v if v is not None else held.get(k)
            want[t] = held[k]
        got = ordering.fill_in_order(df, "v", "t", backward, ["k"])
        assert {x.t: x.v for x in got.collect()} == want
        sizes = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 450
    keyed = df.select("t", "v", F.create_map(F.lit("k"), "k").alias("m"))
    assert {x.t: x.v for x in clean.fill_missing(keyed, "v", "bfill", order_by="t", partition_by=["m"]).collect()} == want
