"""Decontamination against exact containment over all pairs."""

import re

import pytest
from pyspark.sql import functions as F

from tidyframe.llm import decontam


def words(text):
    return [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]


def grams(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, share=0.8):
    """Items of fewer than five words are one shingle of as many words as they have."""
    sets = {i: (min(5, len(words(t))), grams(t, min(5, len(words(t))))) for i, t in items if words(t)}
    out = {}
    for d, t in docs:
        own = {k: grams(t, k) for k in {k for k, _ in sets.values()}}
        for i, (k, s) in sets.items():
            if len(own[k] & s) >= share * len(s) - 1e-9:
                out[d, i] = (len(own[k] & s), len(s))
    return out


@pytest.mark.parametrize("rows", [200_000, 0])
def test_whole_tables(spark, sf_dir, monkeypatch, rows):
    """With broadcast and with shuffled joins."""
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): (r.matched, r.item_shingles) for r in decontam.contaminated(docs, items).collect()}
    assert got == want and want


def test_partial_containment(spark):
    """Every share around the threshold, in items of every size class."""
    items, docs = [], []
    for n in (1, 2, 3, 4, 5, 6, 9, 12, 20, 33, 64, 100):
        words = [f"i{n}x{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        for cut in range(0, n + 1, max(1, n // 12)):
            docs.append((len(docs), "Lead in text, " * 30 + " ".join(words[cut:]).upper() + ". and a tail " * 40))
        docs.append((len(docs), " ".join(words)))
    got = {(r.doc_id, r.item_id): (r.matched, r.item_shingles) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == brute(docs, items)


def test_short_items_inside_long_texts(spark):
    docs = spark.createDataFrame([(1, "Some " * 500 + "Alpha, beta gamma delta; and more"), (2, "alpha beta"), (3, "gamma"), (4, "beta alpha")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, "Gamma!")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(1, 1), (1, 2), (1, 3), (2, 2), (3, 3)]


def test_clashing_names(spark):
    own = ("_found", "words", "w0", "h", "item_id", "width")
    docs = spark.createDataFrame([(1, "one two three four five six", *own), (2, "clean", *own)], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in own))
    items = docs.select("doc_id", "text", "_found", "words").filter("doc_id = 1").withColumn("item_id", docs["doc_id"])
    assert [tuple(r) for r in decontam.drop_contaminated(docs, items).collect()] == [(2, "clean", *own)]


def test_ids_in_several_rows_count_as_one(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(a, a + 8))) for a in range(0, 13, 3)], "doc_id bigint, text string")
    assert decontam.contaminated(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).count() == 1


def test_odd_rows(spark):
    long = "filler " * 120_000 + "one two three four five six seven eight " + "more " * 1000
    rows = [(1, None, "a"), (2, "", "b"), (3, "one two three four five six seven eight", "c"), (3, "one two three four five six seven eight", "c"), (None, "one two three four five six seven eight", "d"), (5, long, "e"), (6, "clean text of many other words here", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, "One two three, four five six seven eight!", 9), (1, "One two three, four five six seven eight!", 9), (2, None, 1), (3, "  ", 1), (None, "x", 1)], "item_id bigint, text string, doc_id int")
    assert sorted((r.doc_id, r.item_id, r.matched) for r in decontam.contaminated(docs, items).collect()) == [(3, 1, 4), (5, 1, 4)]
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "None"]
    assert decontam.contaminated(docs.limit(0), items).count() == decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == 7


def test_one_pass_for_items_of_all_widths(spark):
    """Items of one to eight words: the texts are read and split once, whatever widths are sought."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id bigint, text string")
    words = docs.select("doc_id", decontam.normal_words(F.col("text")).alias("words"))
    plan = decontam._grams(words, "doc_id", 5, [1, 2, 3, 4, 5])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Union" not in plan
    items = spark.createDataFrame([(n, " ".join("abcdefgh"[:n])) for n in range(1, 9)] + [(20, "b d")], "item_id bigint, text string")
    assert sorted((r.item_id, r.matched) for r in decontam.contaminated(docs, items).collect()) == [(n, max(1, n - 4)) for n in range(1, 9)]


def test_a_phrase_that_all_have_is_in_no_sketch(spark):
    """Items and documents share a phrase: it is met by none of the sketches, as each item has rarer shingles."""
    common = "one two three four five"
    items = spark.createDataFrame([(i, f"{common} " + " ".join(f"i{i}w{j}" for j in range(12))) for i in range(30)], "item_id bigint, text string")
    docs = spark.createDataFrame([(d, f"{common} and d{d}") for d in range(200)] + [(1000 + i, "x " + t) for i, t in enumerate(r.text for r in items.limit(3).collect())], "doc_id bigint, text string")
    k = spark.range(1).select(F.xxhash64(*[F.lit(w) for w in common.split()])).first()[0]
    full = items.select("item_id", F.explode(F.array(*[F.lit(x) for x in (k, 5, 6, 7)])).alias("h")).withColumn("h", F.when(F.col("h") == k, k).otherwise(F.col("h") + 10 * F.col("item_id"))).withColumn("m", F.lit(2))
    hits = docs.select("doc_id", F.lit(k).alias("h"))
    assert decontam._sketches(full, hits).filter(F.col("h") == k).count() == 0
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(1000, 0), (1001, 1), (1002, 2)]
