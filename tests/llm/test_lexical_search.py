"""Ranked search against scoring every pair in whole numbers."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidyframe.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k):
    """docs, items: (id, text); every document is scored for every item."""
    own = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(TERM.findall(lowered(t)))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c, n in own:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in terms.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0, d))
        scored.sort()
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.mark.parametrize("leaves", [(64, 8), (2, 1)])
def test_all_documents(spark, sf_dir, monkeypatch, leaves):
    """Also with small trees, batches and blocks of items, so that all paths are taken."""
    monkeypatch.setattr(ls, "DOC_LEAF", leaves[0])
    monkeypatch.setattr(ls, "ITEM_LEAF", leaves[1])
    if leaves[0] == 2:
        monkeypatch.setattr(ls, "TREE_DOCS", 50)
        monkeypatch.setattr(ls, "BLOCK_TERMS", 600)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 20)
    assert found(ls.best_documents(docs.repartition(3), items)) == want and len(want) > 500


def test_edges(spark):
    """Nulls, ties, repeats, odd characters, a very long text, names that clash."""
    docs = [(i, "same words here", i) for i in range(30)] + [(7, "same words here", 0), (None, "same words", 1), (100, None, 2), (101, "...  --", 3), (102, "Ünder_the BRIDGE é9 ß", 4), (103, "under the bridge", 5), (104, "words " * 60_000, 6)]
    items = [(1, "SAME words"), (2, "ünder É9 Under"), (3, None), (4, "nothing of this"), (5, "same"), (5, "bridge same"), (None, "here here")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, score bigint").repartition(4)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    for k in (3, 40):
        assert found(ls.best_documents(df, q, k)) == brute([d[:2] for d in docs], items, k)
    assert ls.best_documents(df.limit(0), q).count() == ls.best_documents(df, q.limit(0)).count() == 0
    assert ls.best_documents(spark.createDataFrame([("b", "x y"), ("a", "x y")], "doc_id string, text string"), q.select("item_id", ls.F.lit("x").alias("text")).limit(1)).collect()[0].doc_id == "a"


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_bounds_prune_and_lose_nothing(kind):
    """Groups of documents with words of their own: an item's search leaves the other groups out."""
    r = np.random.default_rng(5)
    groups, width = 32, 32 * 40
    rows = [np.unique(g * 40 + r.integers(0, 40, 12)) for g in range(groups) for _ in range(64)]
    values = [r.integers(1, 1000, len(c)) for c in rows]
    make = lambda rows, values, leaf: ls.Tree(np.concatenate(([0], np.cumsum([len(c) for c in rows]))), np.concatenate(rows), np.concatenate(values).astype(np.int64), width, leaf, kind)
    docs, items = make(rows, values, 64), make(rows[::64], values[::64], 8)
    search = ls.Search(items, 5, width, kind)
    item, doc, score = search.run(docs, np.arange(len(rows)))
    dense = np.zeros((len(rows), width), np.int64)
    for i, (c, v) in enumerate(zip(rows, values)):
        dense[i, c] = v
    every = dense[::64] @ dense.T
    want = sorted((i, j, int(every[i, j])) for i in range(groups) for j in sorted(range(len(rows)), key=lambda j: (-every[i, j], j))[:5] if every[i, j])
    assert sorted(zip(items.order[item].tolist(), docs.order[doc].tolist(), score.tolist())) == want
    assert search.scored < 0.5 * every.size
