"""LM scoring: exact columns against a brute-force version; the sampler against enumeration and a sampler of single customers."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidyframe.llm import language_model as lm, queries


def brute_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    return [w for w in folded.split(" ") if w] + [None]


@pytest.fixture(scope="module", params=[("sf0.01", 4_000_000), ("sf0.001", 5_000)])
def scored(request, spark):
    """The query, with blocks of a partition's documents, and with many small blocks."""
    before, (sf, lm.BLOCK_TOKENS) = lm.BLOCK_TOKENS, request.param
    sf_dir = f"/root/testdata/{sf}"
    yield sf_dir, {r.doc_id: r for r in queries.op9_lm_scoring(spark, sf_dir).collect()}
    lm.BLOCK_TOKENS = before


def kneser_ney(docs, held):
    """Perplexity of an interpolated word-bigram model with one discount a level."""
    pairs = Counter(p for d, t in docs.items() if d not in held for p in pairwise(["<s>", *brute_words(t)]))
    total, kinds, into = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        total[a] += n
        kinds[a] += 1
        into[b] += 1
    of = lambda c: (lambda n: n[1] / (n[1] + 2 * n[2]))(Counter(c.values()))
    d, d0, every, v = of(pairs), of(into), sum(into.values()), len(into)
    score = n = 0
    for i in held:
        for a, b in pairwise(["<s>", *brute_words(docs[i])]):
            low = (max(into[b] - d0, 0) + d0 * v / (v + 1)) / every
            score += math.log10((max(pairs[a, b] - d, 0) + d * kinds[a] * low) / total[a] if total[a] else low)
            n += 1
    return 10 ** (-score / n)


def test_query(scored, spark):
    sf_dir, got = scored
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = Counter(w for d, t in docs.items() if d not in held for w in brute_words(t))
    n, v = sum(counts.values()), len(counts)
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        r, words = got[d], brute_words(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d in held, len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score <= 0
    perplexity = 10 ** (-sum(got[d].score for d in held) / sum(got[d].n_tokens for d in held))
    assert perplexity <= kneser_ney(docs, held)
    twice = Counter(t for d, t in docs.items() if d not in held)
    known = lambda n: np.median([got[d].perplexity for d, t in docs.items() if d not in held and twice[t] == n and len(t or "") > 200])
    assert known(2) < 0.5 * known(1)


def local(texts, sweeps, seed=0):
    """The jobs without Spark on texts to learn from: the model, its block and what the block knows."""
    block = lm._Gathered()
    for i, t in enumerate(texts):
        block.add(i, t, True)
    rows = [block.row(seed)]

    def grouped(rows, by, run):
        groups = defaultdict(list)
        for r in rows:
            groups[r[by]].append(r)
        return [tuple(r.values()) for g in groups.values() for r in run(pa.Table.from_batches([lm._batch(g)])).to_pylist()]

    each = lambda rows, run: [x for r in rows for x in run(dict(zip(lm._NAMES, r)))]
    of = lambda rows, *kinds: [r for r in rows if r[0] in kinds]
    counted = grouped(each(rows, lm._sent_words(3)), 2, lm._counted_words)
    known = of(counted, lm._WORDS)
    met = grouped(each(rows, lm._sent_pairs(2)), 2, lm._counted_pairs)
    owned = grouped([*rows, *known, *met], 1, lm._owned)
    state = grouped(of(owned, lm._SUMS), 2, lm._seated_words(None, -1))
    sums = lambda rows, n: [sum(r[8][i] for r in rows) for i in range(n)]
    model = lm.Model(*map(int, reversed(sums(of(counted, lm._STATE), 2))), 0.5, 0.5)
    model.sums[-1] = tuple(sums(of(state, lm._STATE), 2))
    for s in range(sweeps):
        sent = grouped([*of(owned, lm._DISHES), *known, *of(state, lm._BACK)], 1, lm._seated_dishes(model, s))
        after = grouped([*sent, *[r for r in of(state, lm._STATE) if r[3] in (-1, s - 1)]], 2, lm._seated_words(model, s))
        model.sums[s] = tuple(sums(of(after, lm._STATE), 2))
        state += after
    block = lm.Block(dict(zip(lm._NAMES, rows[0])))
    back = [dict(zip(lm._NAMES, r)) for r in [*known, *met, *of(state, lm._BACK)]]
    return model, block, lm._Known(back, len(block.words), model), back


TINY = ["a b a b c", "a b b", "c a b", "", "b a c a b", "a a"]


def customers_sampler(texts, sweeps, d=0.5, d0=0.5):
    """Every customer is taken out of a restaurant with tables and seated again; mean tables of contexts and probabilities."""
    r = np.random.default_rng(1)
    pairs = [p for t in texts for p in pairwise(["<s>", *brute_words(t)])]
    words = sorted({b for _, b in pairs}, key=str)
    v = len(words)
    tables, root, at = defaultdict(list), defaultdict(list), []

    def p0(w):
        n, s = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root[w]) - d0 * len(root[w]) + (lm.ROOT_CONCENTRATION + d0 * s) / (v + 1)) / (lm.ROOT_CONCENTRATION + n)

    def join(list_, weight, discount):
        w = np.array([n - discount for n in list_] + [weight])
        i = r.choice(len(w), p=w / w.sum())
        if i == len(list_):
            list_.append(0)
        list_[i] += 1
        return i, list_[i] == 1

    def leave(list_, i=None):
        i = r.choice(len(list_), p=np.array(list_) / sum(list_)) if i is None else i
        list_[i] -= 1
        if not list_[i]:
            list_.pop(i)
            return True
        return False

    def seat(u, w):
        context = sum(len(t) for (a, _), t in tables.items() if a == u)
        if join(tables[u, w], (lm.CONCENTRATION + d * context) * p0(w), d)[1]:
            join(root[w], (lm.ROOT_CONCENTRATION + d0 * sum(map(len, root.values()))) / (v + 1), d0)

    for u, w in pairs:
        seat(u, w)
    for s in range(sweeps):
        for u, w in pairs:
            if leave(tables[u, w]):
                leave(root[w])
            seat(u, w)
        if s >= sweeps // 5:
            contexts = sorted({a for a, _ in pairs})
            mean = {u: sum(len(t) for (a, _), t in tables.items() if a == u) for u in contexts}
            p = {(u, w): (sum(tables[u, w]) - d * len(tables[u, w]) + (lm.CONCENTRATION + d * mean[u]) * p0(w)) / (lm.CONCENTRATION + sum(a == u for a, _ in pairs)) for u in contexts for w in words}
            at.append((mean, p))
    return {u: np.mean([m[u] for m, _ in at]) for u in at[0][0]}, {k: np.mean([p[k] for _, p in at]) for k in at[0][1]}


def test_sampler_agrees_with_single_customers(monkeypatch):
    monkeypatch.setattr(lm, "CONCENTRATION", 1.0)
    want_tables, want = customers_sampler(TINY, 800)
    monkeypatch.setattr(lm, "SWEEPS", 400)
    model, block, known, back = local(TINY, 400)
    named = {"<s>": lm.START, None: lm.END}
    number = {w: i for i, w in enumerate(block.words)}
    place = lambda x: number[named.get(x, str(x).encode())]
    for u, mean in want_tables.items():
        assert abs(np.mean([known.tables[s][place(u)] for s in range(1, 400)]) - mean) < 0.12 * mean + 0.1, u
    pu, pw = (np.array([place(k[i]) for k in want]) for i in (0, 1))
    us, ws, _ = block.pairs()
    c = dict(zip(zip(us.tolist(), ws.tolist()), (lm._pair_values(back, lm._pair_hashes(block.hashes(), us, ws)) >> 1).tolist()))
    got = model.probability(known, pu, pw, np.array([c.get(k, 0) for k in zip(pu.tolist(), pw.tolist())]))
    assert np.abs(got - np.array(list(want.values()))).max() < 0.02


def test_probabilities_sum_to_one():
    """Over all words and the unknown one, after every context and in every kept sweep: scores use the tables that totals hold."""
    model, block, known, back = local(["a b c a b d e a a " * 40] * 5 + ["x y z"], lm.SWEEPS)
    us, ws, _ = block.pairs()
    c = dict(zip(zip(us.tolist(), ws.tolist()), (lm._pair_values(back, lm._pair_hashes(block.hashes(), us, ws)) >> 1).tolist()))
    assert max(c.values()) > 200
    words = np.arange(1, len(block.words))
    for u in range(len(block.words)):
        if block.words[u] == lm.END:
            continue
        counts = np.array([c.get((u, w), 0) for w in words])
        unknown = np.mean([model.parent(s, np.zeros(1), np.zeros(1))[0] * (lm.CONCENTRATION + model.discount * known.tables[s][u]) / (lm.CONCENTRATION + known.n[u]) for s in range(1, lm.SWEEPS)])
        p = model.probability(known, np.full(len(words), u), words, counts)
        assert (p > 0).all() and abs(p.sum() + unknown - 1) < 1e-9
        several = counts > 1
        for s, t in enumerate(model.seat(lm.SWEEPS - 1, np.full(several.sum(), u), words[several], counts[several], known)):
            assert t.sum() + (counts == 1).sum() == known.tables[s][u]


@pytest.mark.parametrize("n,p", [(1, 0.3), (40, 0.02), (500, 0.03), (1000, 0.4), (7, 1.0), (100, 0.0), (10**7, 3e-7)])
def test_binomial_draws_by_hashes(n, p):
    seed = lm._mixed(np.arange(1, 40_001, dtype=np.uint64) * np.uint64(lm._ODD))
    k = lm._binomial(np.full(len(seed), n), np.full(len(seed), p), seed)
    sd = math.sqrt(n * p * (1 - p))
    assert abs(k.mean() - n * p) <= 4 * sd / 200 and abs(k.std() - sd) <= 0.03 * sd + 1e-12 and k.min() >= 0 and k.max() <= n
    assert (k == lm._binomial(np.full(len(seed), n), np.full(len(seed), p), seed)).all()


def partitions(n):
    """Sizes of the blocks of every way to part n things."""
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for i in range(len(p)):
            yield [*p[:i], p[i] + 1, *p[i + 1 :]]
        yield [*p, 1]


@pytest.mark.parametrize("a,b,d", [(0.3, 0.02, 0.6), (4.0, 0.5, 0.3), (0.05, 0.05, 0.9)])
def test_seating_against_all_partitions(a, b, d):
    """Numbers of tables have their conditional distribution; large dishes have its mean and spread, nearly."""
    n = 40_000
    seed = np.random.default_rng(2).integers(0, 2**63, n).astype(np.uint64)
    for c in (2, 3, 6):
        weight = np.zeros(c + 1)
        for sizes in partitions(c):
            weight[len(sizes)] += math.prod(a + b * k for k in range(len(sizes))) * math.prod(j - d for s in sizes for j in range(1, s))
        got = np.bincount(lm.Seating(d).draw(np.full(n, c), np.full(n, a), np.full(n, b), seed).astype(int), minlength=c + 1) / n
        assert np.abs(got - weight / weight.sum()).max() < 0.01
    assert lm.Seating(d).draw(np.array([0, 1]), np.ones(2), np.ones(2), seed[:2]).tolist() == [0, 1]


def test_seating_of_large_dishes(monkeypatch):
    a, d, seed = 2.0, 0.5, np.random.default_rng(3).integers(0, 2**63, 3000).astype(np.uint64)
    draw = lambda c: lm.Seating(d).draw(np.full(3000, c), np.full(3000, a), np.full(3000, d), seed)
    monkeypatch.setattr(lm, "EXACT", 100)
    exact = draw(100)
    monkeypatch.setattr(lm, "EXACT", 32)
    grouped = draw(100)
    assert abs(grouped.mean() - exact.mean()) < 0.04 * exact.mean() and abs(grouped.std() - exact.std()) < 0.12 * exact.std()
    # tables grow as customers ** discount; mean and spread go on together
    big = draw(10**8) / draw(10**6).mean()
    assert 9 < big.mean() < 11 and abs(big.std() / big.mean() - grouped.std() / grouped.mean()) < 0.1


def test_large_dishes_start_from_an_exact_draw(monkeypatch):
    """Their first EXACT customers are one draw instead of a binomial draw for each few, and rare tables are not drawn too often."""
    a, b, d, seed = 0.02, 0.01, 0.7, np.random.default_rng(4).integers(0, 2**63, 40_000).astype(np.uint64)
    draw = lambda c: lm.Seating(d).draw(np.full(40_000, c), np.full(40_000, a), np.full(40_000, b), seed)
    calls, binomial = [], lm._binomial
    monkeypatch.setattr(lm, "_binomial", lambda *x: calls.append(1) or binomial(*x))
    grouped = draw(100)
    assert 0 < len(calls) <= 8
    assert draw(lm.EXACT + 1).mean() - draw(lm.EXACT).mean() < 0.01
    monkeypatch.setattr(lm, "EXACT", 100)
    exact = draw(100)
    assert abs(grouped.mean() - exact.mean()) < 0.05


def test_a_sweep_goes_on_from_the_tables_before(monkeypatch):
    """Each sweep draws a dish once and needs only what the sweep before sent; the sums are those of all sweeps done again."""
    texts = ["a b c a b d e a a " * 40] * 5 + TINY
    model, _, _, back = local(texts, lm.SWEEPS)
    gathered = lm._Gathered()
    for i, t in enumerate(texts):
        gathered.add(i, t, True)
    run = lambda f, rows: f(pa.Table.from_batches([lm._batch([tuple(r.values()) for r in rows])])).to_pylist()
    of = lambda rows, kind: [r for r in rows if r["kind"] == kind]
    block = dict(zip(lm._NAMES, gathered.row(0)))
    first = [*of(run(lm._owned, [block, *of(back, lm._WORDS), *of(back, lm._PAIRS)]), lm._DISHES), *of(back, lm._WORDS)]
    drawn, draw = [], lm.Seating.draw
    monkeypatch.setattr(lm.Seating, "draw", lambda self, c, *x: drawn.append(len(c)) or draw(self, c, *x))
    tables = []
    for s in range(lm.SWEEPS):
        seated = lm._seated_dishes(model, s)
        again = of(run(seated, [*first, *of(back, lm._BACK)]), lm._SUMS)
        drawn.clear()
        sent = run(seated, [*first, *tables, *[r for r in of(back, lm._BACK) if r["sweep"] == s - 1]])
        assert len(drawn) == 1 and of(sent, lm._SUMS) == again
        tables = of(sent, lm._TABLES)
        assert len(tables) == 1 and lm.unpack(tables[0]["a"], "<u4").max() > 1


def test_what_is_sent_back_meets_one_array_a_sweep(monkeypatch):
    """However many partitions send it: the work of a block is not its words times the partitions."""
    at = lambda p: np.arange(p, 60, 20)
    rows = [lm._row(lm._WORDS, 0, p, a=lm.pack(at(p).astype("<u4")), b=lm.pack_sorted(np.arange(3, dtype="<u4")), c=lm.pack(at(p))) for p in range(20)]
    rows += [lm._row(lm._BACK, 0, p, s, *[lm.pack(at(p) + 100 * s + i) for i in range(3)]) for p in range(20) for s in range(3)]
    made, zeros = [], np.zeros
    monkeypatch.setattr(lm.np, "zeros", lambda *x: made.append(x) or zeros(*x))
    model = lm.Model(10, 60, 0.5, 0.5)
    model.sums = {s: (1.0, 1.0) for s in range(-1, 3)}
    known = lm._Known([dict(zip(lm._NAMES, r)) for r in rows], 60, model)
    assert len(made) <= 2 + 2 * 3 and known.n.tolist() == list(range(60))
    for s in range(3):
        assert known.tables[s].tolist() == [100 * s + i for i in range(60)]
        assert np.allclose(known.parents[s], model.parent(s, known.tables[s] + 1, known.tables[s] + 2))


def test_packed_arrays():
    r = np.random.default_rng(0)
    for kind in ("<u4", "<i8", "<u8"):
        for n in (0, 1, 1000):
            x = np.sort(r.integers(0, 2**31, n)).astype(kind)
            assert lm.unpack(lm.pack(x), kind).tolist() == x.tolist() == lm.unpack_sorted(lm.pack_sorted(x), kind).tolist()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "Odd words", "y"), (2, "", None), (3, "word " * 90_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known) for r in lm.score_texts(df, F.lit(True)).collect()))
    assert got == [(0, 3, 3), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 90_001, 90_001)]
    none = lm.score_texts(df, F.lit(None).cast("boolean")).collect()
    assert len(none) == 5 and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in none)
    assert lm.score_texts(df.limit(0), F.lit(True)).count() == 0
