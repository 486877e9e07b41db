"""HyperMinHash against all pairs of whole shingle sets."""

import numpy as np
import pytest
from test_simhash import brute_components

from tidyframe.llm import hyper_minhash as hm


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    """doc_id to (set size, component) by comparing all pairs of rows."""
    sets = {d: shingles(t) for d, t in rows}
    near = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    root = brute_components(sets, near)
    return {d: (len(sets[d]), root[d]) for d in sets}


def edited(r, words, share):
    """Some words replaced."""
    out = list(words)
    for i in r.choice(len(words), max(1, int(share * len(words))), replace=False):
        out[i] = f"new{r.integers(1 << 40)}"
    return out


@pytest.mark.parametrize("tile", [8192, 5])
def test_whole_table(spark, sf_dir, tile):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hm.near_duplicates(docs, tile=tile).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("tile", [8192, 30])
def test_near_copies_of_all_sizes(spark, tile):
    """Pairs around the threshold, chains, a large group, sets of six and seven shingles."""
    r = np.random.default_rng(3)
    word = lambda: f"w{r.integers(1 << 40)}"
    texts = []
    for n in (10, 11, 12, 40, 200, 1000):
        for _ in range(12):
            base = [word() for _ in range(n)]
            texts += [base, base[1:], base[: n - 1], base + [word()], edited(r, base, 0.015), edited(r, base, 0.03)]
    base = [word() for _ in range(300)]
    texts += [edited(r, base, 0.004) for _ in range(120)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in hm.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), tile=tile).collect()}
    assert got == brute(rows)


def test_edges(spark):
    """Nulls, empty and short texts, repeats, null ids, a very long text, names that clash; kept is the component's own row."""
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (3, "One  TWO"), (9, "one two three"), (10, long), (2, long + " more"), (None, "one two"), (None, "only null"), (11, "one two"), (11, "one two"), (12, "Ä b c d e"), (13, "ä b c d e")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id bigint, text string, s int, label int")
    got = sorted([tuple(x) for x in hm.near_duplicates(df).collect()], key=str)
    sizes = {10: 29_996, 2: 29_997, 5: 0, 6: 0, 7: 0}
    first = {8: 3, 3: 3, 11: 3, 10: 2}
    want = [(d, sizes.get(d, 1), 3 if d is None and t == "one two" else first.get(d, d), d == (3 if d is None and t == "one two" else first.get(d, d))) for d, t in rows]
    assert got == sorted(want, key=str)
    assert hm.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        hm.near_duplicates(df, similarity=0.2)


@pytest.mark.parametrize("n,extra", [(6, 1), (30, 4), (400, 60), (5000, 800)])
def test_registers_agree_as_often_as_sets_are_similar(n, extra):
    r = np.random.default_rng(n)
    sets = [np.sort(r.integers(0, 1 << 64, n + extra, dtype=np.uint64)) for _ in range(300)]
    less = [np.sort(r.permutation(h)[:n]) for h in sets]
    a, b = hm.registers(sets), hm.registers(less)
    share = (a == b).mean(axis=1)
    assert abs(share.mean() - n / (n + extra)) < 0.02
    width = hm.REGISTERS // hm.BANDS
    met = (a.reshape(len(sets), -1, width) == b.reshape(len(sets), -1, width)).all(axis=2).any(axis=1)
    assert met.all()
    got = hm.estimate(np.count_nonzero(a == b, axis=1), np.full(len(a), float(n + extra)), np.full(len(a), float(n)))
    assert (got >= hm.least_estimate(n / (n + extra)) - 1e-9).all() or n < 2 * hm.REGISTERS
    other = hm.registers([np.sort(r.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(300)])
    if n >= 400:  # by chance alone
        assert abs((b == other).mean() - hm.by_chance(np.array([n]), np.array([n]))[0]) < 2e-4


def test_estimate_leaves_out_what_is_far():
    """A bucket of sets with a share in common: those far apart are no candidates, near ones are connected."""
    r = np.random.default_rng(1)
    common = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = [np.sort(np.append(common, r.integers(0, 1 << 64, 700, dtype=np.uint64))) for _ in range(40)]
    sets += [np.sort(np.append(h[:-20], r.integers(0, 1 << 64, 20, dtype=np.uint64))) for h in sets]
    edges = hm.forest(hm.registers(sets), np.array([len(h) for h in sets]), 0.85, hm.least_estimate(0.85))
    assert {tuple(sorted(e)) for e in edges} == {(i, i + 40) for i in range(40)}
