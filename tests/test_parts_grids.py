"""Profiles by parts, grids of time, grouping sets, nested JSON and sessions, against brute force."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyframe.operators import calendar, cube, incremental, json_profile, profile
from tidyframe.plans import queries
from tidyframe.streaming.sessions import all_available, sessions

AT = datetime(2024, 1, 1)


def test_merged_profile_equals_one_of_all(spark, tmp_path):
    """Parts in any order, one twice, a missing one; counts are exact and estimates within their errors."""
    r = np.random.default_rng(1)
    rows = [(int(i), None if i % 97 == 0 else int(i % 5), float(x) if i % 11 else None, f"t{int(x * 3) % 40}", AT + timedelta(milliseconds=int(i))) for i, x in enumerate(r.normal(1e6, 5, 6000))]
    df = spark.createDataFrame(rows, "id bigint, part int, v double, s string, ts timestamp")
    path = str(tmp_path / "p")
    for keep in ("part in (0, 3)", "part = 1", "part is null", "part in (2, 4)", "part = 1"):
        incremental.update_profile(df.filter(keep), path, "part")
    got = {x.column: x for x in incremental.merged_profile(incremental.stored_sketches(spark, path)).collect()}
    want = {x.column: x for x in profile.column_stats(df.drop("part")).collect()}
    assert got.keys() == want.keys() and got["v"].parts == 6
    for c, w in want.items():
        g = got[c]
        assert (g["count"], g.missing, g.min, g.max) == (w["count"], w.missing, w.min, w.max) and abs(g.distinct - w.distinct) <= 0.06 * w.distinct
    assert got["v"].mean == pytest.approx(want["v"].mean, rel=1e-12) and got["v"].std_pop == pytest.approx(want["v"].std_pop, rel=1e-9)
    values = sorted(x[2] for x in rows if x[2] is not None)
    for share, q in ((0.25, got["v"].p25), (0.5, got["v"].p50), (0.75, got["v"].p75)):
        assert abs(np.searchsorted(values, q) / len(values) - share) < 0.02
    assert (got["s"].top[0].value, got["s"].top[0]["count"]) == (want["s"].top_value, want["s"].top_count) and len(got["s"].top) == 5
    one = incremental.merged_profile(incremental.stored_sketches(spark, path).filter("part = '1'")).filter("column = 'id'").first()
    assert one["count"] == sum(x[1] == 1 for x in rows)
    assert incremental.merged_profile(incremental.sketch_parts(df.limit(0), "part")).count() == 0


def test_profile_of_many_rare_values(spark, tmp_path):
    """More users than counters, none frequent: their top is empty, and the query has all its rows."""
    day = F.lit(AT).cast("timestamp") + F.make_dt_interval((F.col("id") % 30).cast("int"))
    events = spark.range(60_000).select(F.col("id").alias("event_id"), day.alias("ts"), (F.col("id") * 7919 % 20_011).alias("user_id"), F.element_at(F.array(F.lit("view"), F.lit("click")), (F.col("id") % 7 % 2 + 1).cast("int")).alias("event_type"), (F.col("id") % 50).cast("double").alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {x.column: x for x in queries.QUERIES["incremental_profile"](spark, str(tmp_path)).collect()}
    assert {c: (x["count"] + x.missing, x.parts, x.near) for c, x in got.items()} == {c: (60_000, 30, True) for c in ("value", "user_id", "event_type")}
    tops = {x.column: x.top for x in incremental.merged_profile(incremental.sketch_parts(events.select("user_id", "event_type", F.to_date("ts").alias("day")), "day")).collect()}
    assert tops["user_id"] == [] and sum(x["count"] for x in tops["event_type"]) == 60_000


def test_gaps_and_interpolation(spark, monkeypatch):
    """A hot key, a missing one, moments beside the grid and missing ones; small chunks."""
    monkeypatch.setattr(calendar, "CHUNK", 7)
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + ["b", None]), AT + timedelta(seconds=s * 30), r.choice([None, float(s)])) for s in r.sample(range(400), 150)] + [("hot", None, 5.0), ("hot", None, None), ("only", AT + timedelta(seconds=1), 1.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double").repartition(5)
    got = calendar.fill_gaps(df, "t", 60, ["k"])
    have, want = defaultdict(list), []
    for k, t, _ in rows:
        if t is not None:
            have[k].append(t)
    for k, ts in have.items():
        t = AT - timedelta(seconds=60)
        while t <= max(ts):
            if t >= min(ts) and t not in ts:
                want.append((k, t, None))
            t += timedelta(seconds=60)
    key = lambda x: str(x)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(rows + want, key=key) and len(want) > 100
    filled = sorted((tuple(x) for x in calendar.interpolate(got, "v", "t", ["k"]).collect()), key=key)
    near = sorted((tuple(x) for x in calendar.interpolate(got, "v", "t", ["k"], outside=True).collect()), key=key)

    def at(k, t, v, outside):
        if v is not None or t is None:
            return v
        known = sorted((b, c) for a, b, c in rows if a == k and b is not None and c is not None)
        before, after = [x for x in known if x[0] <= t][-1:], [x for x in known if x[0] >= t][:1]
        if before and after:
            (a, x), (b, y) = before[0], after[0]
            return x if a == b else x + (y - x) * (t - a).total_seconds() / (b - a).total_seconds()
        return (before or after or [(0, None)])[0][1] if outside else None

    for found, outside in ((filled, False), (near, True)):
        want_v = sorted(((k, t, at(k, t, v, outside)) for k, t, v in rows + want), key=key)
        assert [x[:2] for x in sorted(found, key=lambda x: (str(x[:2]), str(x[2])))] == [x[:2] for x in sorted(want_v, key=lambda x: (str(x[:2]), str(x[2])))]
        values = lambda xs: {(k, t): v for k, t, v in xs if t is not None}
        assert values(found) == pytest.approx(values(want_v))
    assert calendar.fill_gaps(df.limit(0), "t", 60, ["k"]).count() == calendar.interpolate(df.limit(0), "v", "t").count() == 0
    with pytest.raises(ValueError):
        calendar.fill_gaps(df, "v", 60)


def test_grouping_sets(spark):
    """Missing keys apart from left-out ones, NaN as missing, a map as a key, repeated sets, no rows."""
    r = random.Random(4)
    rows = [(r.choice(["x", "y", None]), r.choice([1, 2, None]), r.choice([None, float("nan"), *[x / 2 for x in range(9)]])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b int, v double")
    got = {(x.grouping_id, x.a, x.b): (x.n, x["count"], x.sum, x.distinct, x.q50, x.q90) for x in cube.grouping_sets(df, [*cube.cube_sets(["a", "b"]), ("a",)], "v", [0.5, 0.9]).collect()}
    want = {}
    for g, of in ((0, lambda x: (x[0], x[1])), (1, lambda x: (x[0], None)), (2, lambda x: (None, x[1])), (3, lambda x: (None, None))):
        groups = defaultdict(list)
        for x in rows:
            groups[of(x)].append(x[2])
        for k, vs in groups.items():
            there = [v for v in vs if v is not None and v == v]
            want[(g, *k)] = (len(vs), len(there), sum(there), len(set(there)), float(np.quantile(there, 0.5)), float(np.quantile(there, 0.9)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert cube.rollup_sets(["a", "b"]) == [("a", "b"), ("a",), ()]
    empty = cube.grouping_sets(df.limit(0), cube.cube_sets(["a"]), "v").collect()
    assert [(x.a, x.grouping_id, x.n, x.q50) for x in empty] == [(None, 1, 0, None)]
    mapped = df.select(F.create_map(F.lit("k"), "a").alias("m"), "v")
    assert cube.grouping_sets(mapped, [("m",), ()], "v").count() == 4


def test_rows_are_counted_once_for_all_sets(spark):
    """Only counts are expanded: one value over 50,000 rows is a few rows by then."""
    df = spark.range(50_000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), F.lit(1.0).alias("v"))
    plan = cube.grouping_sets(df, cube.cube_sets(["a", "b"]), "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0, 50000" not in plan and "Expand" not in plan
    assert cube.grouping_sets(df, cube.cube_sets(["a", "b"]), "v").agg(F.sum("n")).first()[0] == 200_000


def test_json_paths(spark, monkeypatch):
    lines = ['{"a":1,"b":{"c":[1,2.5,null]}}', '{"a":null,"b":{"c":[]},"x.y":"t"}', '{"a":"t","b":3}', "[true,{}]", "7", "not json", "NaN", None, '{"a":1,"a":2}']
    df = spark.createDataFrame([(x,) for x in lines], "line string").repartition(3)
    for paths in (50_000, 1):
        monkeypatch.setattr(json_profile, "PATHS", paths)
        counts = json_profile.path_counts(df, "line")
        got = {x.path: x for x in json_profile.json_profile(counts).collect()}
        assert got.keys() == {"$", "$.a", "$.b", "$.b.c", "$.b.c[]", '$."x.y"', "$[]"}
        assert got["$"].kinds == {"object": 4, "array": 1, "integer": 1, "invalid": 2, "missing": 1} and got["$"].type == "mixed" and got["$"].presence == 1
        assert (got["$.a"].type, got["$.a"].conflict, got["$.a"].n, got["$.a"].nulls, got["$.a"].presence) == ("mixed", True, 4, 1, 1.0)
        assert (got["$.b.c[]"].type, got["$.b.c[]"].conflict, got["$.b.c[]"].presence) == ("number", False, 1.5)
        assert got['$."x.y"'].presence == 0.25 and got["$[]"].kinds == {"boolean": 1, "object": 1}
    halves = [json_profile.path_counts(df.filter(f"line {how} like '%a%'"), "line") for how in ("", "not")] + [json_profile.path_counts(df.filter("line is null"), "line")]
    together = json_profile.json_profile(json_profile.merged(halves[0].unionByName(halves[1]).unionByName(halves[2])))
    assert {x.path: (x.type, x.n, json.dumps(x.kinds, sort_keys=True)) for x in together.collect()} == {p: (x.type, x.n, json.dumps(x.kinds, sort_keys=True)) for p, x in got.items()}
    assert json_profile.json_profile(json_profile.path_counts(df.limit(0), "line")).count() == 0


def brute_sessions(rows, gap):
    out, last = [], {}
    for k, t, v in sorted((x for x in rows if x[1] is not None), key=lambda x: x[1]):
        if k in last and (t - last[k][2]).total_seconds() <= gap:
            s = last[k]
            s[2], s[3], s[4] = t, s[3] + 1, s[4] + (v or 0)
        else:
            last[k] = [k, t, t, 1, v or 0]
            out.append(last[k])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions_of_any_order_of_arrival(spark, tmp_path, seed):
    """Events up to the delay late, in files of any order: the stream gives the table's sessions."""
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), AT + timedelta(seconds=r.randrange(4000)), float(r.randrange(9))) for _ in range(250)]
    found = lambda df: sorted(((x.k, x.session_start, x.last_event, x.events, x.total) for x in df.collect()), key=str)
    schema = "k string, t timestamp, v double"
    want = brute_sessions(rows, 60)
    table = spark.createDataFrame([*rows, ("a", None, 1.0)], schema)
    assert found(sessions(table, "t", 60, ["k"], "v")) == want
    late = sorted(rows, key=lambda x: x[1] + timedelta(seconds=r.randrange(1000)))  # up to 1000 seconds late
    for i in range(0, 250, 50):
        spark.createDataFrame(late[i : i + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", AT + timedelta(days=9), 0.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert found(all_available(sessions(stream, "t", 60, ["k"], "v", delay=1200))) == want
    with pytest.raises(ValueError):
        sessions(stream, "t", 60, ["k"])
