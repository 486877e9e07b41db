"""The source audit against counting and pricing in Python's whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidyframe.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    """rows: (text, lang, source)."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        own = {s: {t: c[t] for t in kept} for (one, s), c in counts.items() if one == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, p = prob(whole), {s: prob(c) for s, c in own.items()}
        price = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(-sum(price(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-price(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x[2], -x[0], i + 1) for i, x in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("small", [False, True])
def test_all_documents(spark, sf_dir, monkeypatch, small):
    """Also where tasks hand on early, blocks are small and trees are built of few terms."""
    if small:
        for name, value in (("TOKENS", 2000), ("BLOCK_BITS", 5), ("CELLS", 100), ("PAIRS", 3), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(dv, name, value)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()])
    assert found(dv.audit(docs.repartition(5))) == want and len(want) > 1500


def test_edges(spark):
    """Nulls, groups without terms, languages without kept terms, ties, repeats, a very long text, names that clash."""
    rows = [("a b c", "x", "s1"), ("a B ç", "x", "s2"), ("A b9ç", "x", None), (None, "x", "s4"), ("123 !", "x", "s5"), ("rare words", "y", "s1"), ("other ones", "y", "s2"), (None, None, None), ("a a a", "z", "only"), ("a", "z", "only"), ("a c", "z", "only"), ("a c", "x", "s1"), ("ç Ç b", "x", "s1"), ("long " * 90_000, "x", "s1"), ("long", "x", "s2"), ("long", "x", "s2")]
    df = spark.createDataFrame([(t, lang, s, 1, 2) for t, lang, s in rows], "text string, lang string, source string, value int, block int").repartition(4)
    assert found(dv.audit(df)) == brute(rows)
    assert found(dv.audit(df, least_docs=1, top=2)) == brute(rows, 1, 2)
    assert dv.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("sources,terms", [(1, 1), (3, 7), (6, 300)])
def test_trees_walk_to_all_leaves(sources, terms):
    """Pairs of leaves with their number are those of the tables themselves; equal subtrees are one node."""
    r = np.random.default_rng(terms)
    counts = r.integers(0, 3, (sources, terms)) * (r.random((sources, terms)) < 0.2)
    roots, levels, leaves = dv.trees(counts)
    first, second = np.triu_indices(sources, 1)
    got = Counter()
    for pair, a, b, times in zip(*dv.leaf_pairs(roots, levels, first, second)):
        if leaves[a] >= 0:
            got[int(pair), int(leaves[a]), int(leaves[b])] += int(times)
    want = Counter((i, int(counts[x, t]), int(counts[y, t])) for i, (x, y) in enumerate(zip(first, second)) for t in range(terms))
    assert got == want
    for left, right in levels:
        assert len(set(zip(left.tolist(), right.tolist()))) == len(left)


def test_equal_subtrees_are_followed_once():
    """Two sources of 2 ** 14 terms, all but a few without occurrence: as many steps as levels, not as terms."""
    counts = np.zeros((2, 1 << 14), np.int64)
    counts[0, :3], counts[1, 1:5] = 5, 7
    roots, levels, _ = dv.trees(counts)
    assert sum(len(left) for left, _ in levels) < 60
    assert len(dv.leaf_pairs(roots, levels, np.array([0]), np.array([1]))[0]) == 4


def test_probability_is_exact():
    r = np.random.default_rng(2)
    for high in (10, 10**6, 10**12, 9 * 10**14):
        total = r.integers(1, high, 200)
        count = (total * r.random(200)).astype(np.int64)
        got = dv.probability(count, total, 77)
        assert got.tolist() == [1 + 10**9 * (c + 1) // (t + 77) for c, t in zip(count.tolist(), total.tolist())]
