"""Exact duplicates against grouping in Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidyframe.llm import exact_dedup


def brute(rows, largest):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        keep = (max if largest else min)((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_groups_over_many_partitions(spark, largest, partitions):
    """A group of over half the rows spans partitions; long texts share a prefix."""
    rows = [(i, "hot text " * 40) for i in range(900)] + [(2000 + i, f"{'shared prefix ' * 30}{i % 50}") for i in range(400)] + [(5000 + i, None if i % 2 else "") for i in range(9)] + [(6000, "x" * 300_000), (6001, "x" * 300_000), (7, "again"), (7, "again"), (None, "again"), (None, "only null")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = exact_dedup.exact_duplicates(df, keep="most" if largest else "least", partitions=partitions).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows, largest)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_normalised_and_dropped(spark):
    rows = [(3, "A b", "x"), (1, "a  B", "y"), (2, "other", None), (2, "other", None), (None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, keep_id string")
    fold = lambda c: F.lower(F.regexp_replace(c, " +", " "))
    kept = exact_dedup.drop_exact_duplicates(df, fold)
    assert kept.columns == df.columns and sorted([tuple(r) for r in kept.collect()], key=str) == sorted([(1, "a  B", "y"), (2, "other", None), (None, None, "z")], key=str)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


def test_edges_are_joined_by_text_not_digest(spark, monkeypatch):
    """A digest that is the same for all texts joins no texts that differ; a hot long text holds no batches."""
    sha = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: sha(F.lit("one"), n))
    rows = [(i, f"{'same start ' * 9}{i % 7}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = exact_dedup.exact_duplicates(df, partitions=1).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 7, 10) for i in range(70)}
    many = exact_dedup.exact_duplicates(df, partitions=9).collect()
    assert all(r.doc_id % 7 == r.keep_id % 7 for r in many)


def test_hot_long_text_holds_ids_only():
    import pyarrow as pa

    def batches():
        for i in range(200):
            yield pa.RecordBatch.from_arrays([pa.array([2 * i, 2 * i + 1]), pa.array([b"d", b"d"]), pa.array(["x" * 500_000] * 2)], ["doc_id", "sha", "text"])

    class Task:
        def partitionId(self):
            return 0

    before, exact_dedup.TaskContext.get = exact_dedup.TaskContext.get, classmethod(lambda cls: Task())
    try:
        held = pa.total_allocated_bytes()
        source, most = batches(), 0

        def watched():
            nonlocal most
            for b in source:
                most = max(most, pa.total_allocated_bytes() - held)
                yield b

        (out,) = list(exact_dedup._runs(watched()))
    finally:
        exact_dedup.TaskContext.get = before
    assert out.num_rows == 400 and most < 20_000_000


def test_clashing_names(spark):
    own = ("_key", "_n", "sha", "part", "run", "text_group")
    rows = [(i, "ab"[i % 2], *own) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in own))
    assert sorted(tuple(r) for r in exact_dedup.drop_exact_duplicates(df).collect()) == [(0, "a", *own), (1, "b", *own)]
