"""Toxicity on held-out rows, and the pipeline's stages."""

import math
import re
from collections import defaultdict

import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from test_hyper_minhash import shingles
from test_simhash import brute_components

import corpus_pipeline
from tidyframe.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "good day", "c"), (4, "vile " * 100_000, "d"), (4, "vile", "d"), (5, "%% --", "e")] + [(100 + i, f"word{i} vile thing" if i % 2 else f"word{i} kind thing", "f") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(200)] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    got = {(r.doc_id, i): r for i, r in enumerate(toxicity.judge(df, labels).collect())}
    score = {d: r.score for (d, _), r in got.items()}
    assert len(got) == 206 and score[1] == score[2] == score[5] and score[4] > 0.9 > score[None] and score[101] > score[100]
    named = toxicity.drop_toxic(df.withColumn("_score", F.col("score")), labels)
    assert named.columns[-1] == "_score" and all(r._score == r.score for r in named.collect())
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.filter("doc_id = 4").count() == 0
    none = toxicity.judge(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and toxicity.judge(df.limit(0), labels).count() == 0


def brute_fit(rows):
    """FTRL-proximal by its formulas, a coordinate at a time, in dictionaries; rows: (text, label)."""
    def places(text):
        plain = [re.sub(r"[\W_]+", "", w.lower()) for w in text.split()]
        h = [xxhash.xxh64_intdigest(w) for w in plain if w]
        single = [*h, *[xxhash.xxh64_intdigest(f"{w[:n]}~") for w in plain for n in (4, 5, 6) if len(w) > n]]
        pair = lambda a, b, odd: (a * odd + b) * 0x9E3779B97F4A7C15 % 2**64
        every = single + [pair(a, b, 0xC2B2AE3D27D4EB4F) for a, b in zip(h, h[1:])] + [pair(a, b, 0x165667B19E3779F9) for a, b in zip(h, h[2:])]
        return sorted({x >> 44 for x in every} | {1 << 20})

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= 12.0:
            return 0.0
        return -(z[i] - math.copysign(12.0, z[i])) / ((1.0 + math.sqrt(n[i])) / 3.0 + 0.03)

    score = lambda text: 1 / (1 + math.exp(-sum(map(weight, places(text)))))
    for _ in range(4):
        for text, label in rows:
            at = places(text)
            w = {i: weight(i) for i in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - label) * (5.0 if label else 1.0)
            for i in at:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 3.0
                z[i] += g - step * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z) if weight(i)}, score


def test_against_brute_force(spark, sf_dir):
    """All labelled rows of a small table: weights and scores."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").collect()
    want, score = brute_fit([(r.text or "", r.toxic) for r in known])
    at, w = toxicity.train(docs, labels)
    assert len(want) > 20 and set(at.tolist()) == set(want) and all(math.isclose(want[i], x, rel_tol=1e-6) for i, x in zip(at.tolist(), w.tolist()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.judge(docs, labels).collect():
        assert math.isclose(r.score, score(texts[r.doc_id] or ""), rel_tol=1e-6, abs_tol=1e-9) and r.predicted == (r.score >= 0.7)


def test_rows_that_repeat_an_id_are_one_example(spark):
    """Two labelled ids over many rows put two rows into the task that fits."""
    docs = spark.range(20_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id bigint, toxic int")
    assert [(r.doc_id, r.label, r.text) for r in toxicity.examples(docs, labels).orderBy("doc_id").collect()] == [(0, 0, "text 0"), (1, 1, "text 0")]
    nulls = docs.withColumn("text", F.when(F.col("doc_id") == 0, F.col("text")))
    assert [r.text for r in toxicity.examples(nulls, labels).orderBy("doc_id").collect()] == ["text 0", ""]


def one_of_each(ids, texts):
    """The least id of each group linked at a similarity of five-word shingles of 0.8 or more; texts without words are alike."""
    sets = {d: shingles(texts[d]) for d in ids}
    root = brute_components(ids, lambda a, b: sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    return {d for d in ids if root[d] == d}


def holds_an_item(text, items):
    """Whether a text holds 0.8 of an item's five-word shingles."""
    split = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    own = split(text)
    for item in items:
        w = split(item)
        k = min(5, len(w))
        if k and len(grams(own, k) & grams(w, k)) >= 0.8 * len(grams(w, k)) - 1e-9:
            return True
    return False


def test_odd_rows_through_the_pipeline(spark, tmp_path, sf_dir):
    """Null and empty texts, null and repeated ids, repeated rows, short texts and further columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = [(90_001, None, "en", "x", None), (90_002, "", None, None, 0), (90_003, " \n", "en", "x", 2), (90_004, "two words", "en", "x", 9), (90_004, "two words", "en", "x", 9), (90_004, "other text of this id", "en", "x", 21), (None, "text without an id", "en", "x", 18), (90_005, "word " * 60_000, "en", "x", 300_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("_kept", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    toxic = {(r.doc_id) for r in toxicity.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").collect()}
    kept = {r.doc_id for r in ran}
    assert None in kept and {90_001, 90_004, 90_005} <= kept and not {90_002, 90_003} & kept and not toxic & kept
    assert sum(r.doc_id == 90_004 for r in ran) == 2
    empty = spark.createDataFrame([], docs.schema)
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    sets = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        if name != names[-1]:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert after.exceptAll(docs).count() == 0
        sets.append({r.doc_id for r in after.select("doc_id").collect()})
        docs = after if name != names[-1] else docs
    everything = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.judge(everything, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").collect()}
    assert sets[0] == {r.doc_id for r in everything.collect()} - toxic
    least = {r.d for r in everything.filter(F.col("doc_id").isin(list(sets[0]))).groupBy("text").agg(F.min("doc_id").alias("d")).collect()}
    texts = {r.doc_id: r.text for r in everything.collect()}
    near = one_of_each(least, texts)
    clean = {d for d in near if not holds_an_item(texts[d], [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])}
    assert sets[1] == least and sets[2] == near and sets[3] == clean and sets[4] == clean and len(clean) < len(near) < len(least)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in spark.read.parquet(path).limit(50).collect():
        assert r.n_tokens == len(model.encode(texts[r.doc_id], add_bos=True, add_eos=True))
