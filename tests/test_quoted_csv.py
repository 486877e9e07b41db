"""Delimited text with line ends in quotes, read by many tasks, against Python's own reader of whole files."""

import csv
import random

import numpy as np
import pyarrow as pa
import pytest

from tidyframe.sources import files, quoted

CELLS = ["a", "1", "", "x y", '"q, r"', '"line\none"', '"crlf\r\nin"', '"say ""hi"""', '"""start\n"""', '5" pipe', '"l1\n\nl3,\n"', '""', 'é"ü', '"a"b c', "' '", '",\n,"', '"\r"']


@pytest.fixture
def small_splits(spark):
    """Splits of any size; they are put back afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "0")

    yield use
    for n in names:
        spark.conf.unset(n)


def written(path, text, delimiter=","):
    path.write_bytes(text.encode())
    rows = [r for r in csv.reader(open(path, newline="", encoding="utf-8"), delimiter=delimiter) if r]
    return [tuple(c or None for c in r) for r in rows]


@pytest.mark.parametrize("size,tasks", [("128m", 2), ("3000", 20), ("150", 300)])
def test_any_split(spark, tmp_path, small_splits, size, tasks):
    """Two files, line ends of both kinds inside and outside quotes, quotes that mean nothing, headers after a blank line."""
    r = random.Random(7)
    row = lambda i: ",".join([str(i), *[r.choice(CELLS) for _ in range(3)]])
    want = written(tmp_path / "a.csv", "id,b,c,d\n" + "".join(row(i) + r.choice(["\n", "\r\n"]) for i in range(2500)))[1:]
    want += written(tmp_path / "b.csv", '\n"id",b,c,d\n' + "\n".join(row(i) for i in range(5000, 5600)))[1:]
    want = [tuple('"a"b c' if c == "ab c" else c for c in w) for w in want]  # text after a closing quote: Spark keeps the quotes
    small_splits(size)
    df = files.read_csv(spark, str(tmp_path / "*.csv"), infer=False)
    assert df.columns == ["id", "b", "c", "d"] and sorted([tuple(x) for x in df.collect()], key=str) == sorted(want, key=str)
    assert df.rdd.getNumPartitions() >= tasks


def test_record_over_many_splits(spark, tmp_path, small_splits):
    """One quoted field longer than many splits, some of which hold no quote; types are inferred; surplus fields are columns."""
    long = "\n".join(f"line {i}" for i in range(3000))
    (tmp_path / "l.csv").write_text(f'n,t\n1,"{long}"\n2,"""\n"\n3,x,extra\n')
    small_splits("500")
    df = files.read_csv(spark, str(tmp_path / "l.csv"))
    assert df.dtypes == [("n", "bigint"), ("t", "string"), ("col_3", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, long, None), (2, '"\n', None), (3, "x", "extra")]


def test_delimiters_encodings_and_ends(spark, tmp_path, small_splits):
    small_splits("40")
    (tmp_path / "d.csv").write_text('a||b\n"x||\ny"||1\n||"p\n"\nlast||"never\nends||')
    got = files.read_csv(spark, str(tmp_path / "d.csv"), delimiter="||", infer=False)
    rows = sorted([tuple(x) for x in got.collect()], key=str)
    assert rows[1:] == [("x||\ny", "1"), (None, "p\n")] and rows[0][0] == "last" and "never\nends||" in rows[0][1]
    (tmp_path / "l.csv").write_bytes('k\tv\né\t"ß\r\nü"\n'.encode("latin-1"))
    assert [tuple(x) for x in files.read_tsv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").collect()] == [("é", "ß\r\nü")]
    (tmp_path / "b.csv").write_bytes('"first ""\n""",b\n"1\n",2\n'.encode("utf-8-sig"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "b.csv"), has_header=False, infer=False).collect())) == [("1\n", "2"), ('first "\n"', "b")]


def test_plain_files_take_no_second_form(spark, tmp_path):
    """Stray quotes alone ask for nothing; a plan without quoted line ends has no Python."""
    (tmp_path / "s.csv").write_text('a,b\n5" pipe,x\n"q, ""r""",y"\n')
    assert quoted.split_starts(spark, str(tmp_path / "s.csv"), ",", "utf-8") is None
    df = files.read_csv(spark, str(tmp_path / "s.csv"))
    assert "MapInArrow" not in df._jdf.queryExecution().toString() and sorted(map(tuple, df.collect())) == [('5" pipe', "x"), ('q, "r"', 'y"')]


def test_lines_compose():
    """What a run of lines does equals the lines one after another, from either state."""
    r = np.random.default_rng(1)
    for n in (1, 2, 50):
        for _ in range(50):
            opens, stays = r.random(n) < 0.5, r.random(n) < 0.5
            for inside in (False, True):
                state, want = inside, []
                for o, s in zip(opens, stays):
                    state = bool(s if state else o)
                    want.append(state)
                assert quoted._after(opens, stays, inside).tolist() == want


def test_effects_of_splits_in_parts():
    """A split that comes in several batches has one effect."""
    batch = lambda start, opens, stays: pa.RecordBatch.from_arrays([pa.array([1] * len(opens)), pa.array([start] * len(opens)), pa.array(opens), pa.array(stays)], ["file", "start", "opens", "stays"])
    (out,) = quoted._effects(iter([batch(0, [True], [False]), batch(0, [True], [False]), batch(9, [True, False], [True, True])]))
    assert out.to_pylist() == [{"file": 1, "start": 0, "opens": False, "stays": True}, {"file": 1, "start": 9, "opens": True, "stays": True}]


def test_white_space_survives_a_round_trip(spark, tmp_path):
    rows = [(1, "  x \n"), (2, "\t"), (3, "\r\n y")]
    files.write_csv(spark.createDataFrame(rows, "n bigint, t string"), str(tmp_path / "w"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "w"), infer=False).collect())) == [("1", "  x \n"), ("2", "\t"), ("3", "\r\n y")]
