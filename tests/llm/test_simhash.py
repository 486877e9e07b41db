"""SimHash against a brute-force version over all pairs."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidyframe.llm import components, simhash
from tidyframe.llm.components import connected_components


def brute_fingerprint(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("tile", [8192, 20])
def test_whole_table(spark, sf_dir, tile):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fp = {r.doc_id: brute_fingerprint(r.text, 4) for r in docs.collect()}
    want = brute_components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, 4, 64, 4, tile=tile).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == fp
    assert {d: r.component_id for d, r in got.items()} == want


@pytest.mark.parametrize("bits,radius,n", [(64, 4, 700), (256, 51, 500), (64, 4, 1), (64, 0, 100)])
def test_linked(bits, radius, n):
    r = np.random.default_rng(n)
    f = r.integers(0, 256, (n, bits // 8), dtype=np.uint8)
    for i in range(n // 2, n):
        f[i] = f[i - n // 2]
        for b in r.integers(0, bits, r.integers(0, radius + 4)):
            f[i, b // 8] ^= 1 << (b % 8)
    x = np.unpackbits(f, axis=1).astype(int)
    near = (x[:, None, :] != x[None]).sum(2) <= radius
    want = brute_components(range(n), lambda a, b: near[a, b])
    assert simhash.linked(f, radius).tolist() == [want[i] for i in range(n)]


def test_tables_meet_every_pair_within_the_radius():
    r = np.random.default_rng(5)
    for n in (10, 100_000, 10**9):
        tables = simhash.bit_tables(n, 64, 4)
        for _ in range(200):
            off = set(r.choice(64, 4, replace=False).tolist())
            assert any(not off & set(t) for t in tables)
    for radius in (8, 40, 100):
        tables = simhash.bit_tables(10**6, 128, radius)
        off = set(r.choice(128, radius, replace=False).tolist())
        assert len(tables) <= max(simhash.TABLES, radius + 1) and any(not off & set(t) for t in tables)


@pytest.mark.parametrize("n", [1000, 10**5, 10**8])
def test_candidates_meet_sets_of_the_similarity(n):
    """Sets just at 0.8, by fingerprints of 384 bits: the distance and the tables together miss one in five hundred at most."""
    r = np.random.default_rng(11)
    radius, tables = simhash.candidate_radius(384, 0.8), simhash.sampled_tables(n, 384, 0.8)
    met = 0
    for i in range(1000):
        h = r.integers(0, 2**64, 10 * (5 + i % 40), dtype=np.uint64)
        tenth = len(h) // 10
        a, b = (np.unpackbits(np.frombuffer(simhash._fingerprint(x, 6), np.uint8)) for x in (h[:-tenth], h[tenth:]))  # eight of ten tenths are shared
        met += int((a != b).sum()) <= radius and any((a[t] == b[t]).all() for t in tables)
    assert met >= 998


def test_odd_rows(spark):
    words = [f"w{i}" for i in range(300)]
    near = words[:150] + ["other"] + words[151:]
    rows = [(5, None, "a"), (3, "", "b"), (3, "", "b"), (None, " \n", "c"), (7, " ".join(words), "d"), (2, " ".join(near), "e"), (9, "one two", "f"), (8, "ONE  two", "g"), (11, "word " * 200_000, "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df, 4, 64, 4).collect())
    assert got == sorted([("5", 3), ("3", 3), ("3", 3), ("None", 3), ("7", 7), ("2", 2), ("9", 8), ("8", 8), ("11", 11)]) or got == sorted([("5", 3), ("3", 3), ("3", 3), ("None", 3), ("7", 2), ("2", 2), ("9", 8), ("8", 8), ("11", 11)])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "3", "None", "2", "8", "11"])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_clashing_names(spark):
    own = ("_kept", "node", "fp", "label", "s", "least")
    df = spark.createDataFrame([(i, ("same words here " * 9) if i < 3 else f"text {i}", *own) for i in range(5)], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in own))
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == [0, 3, 4] and all(tuple(r)[2:] == own for r in kept)


def test_hot_nodes(spark, monkeypatch):
    """With few and with all nodes met by broadcast: a hub, a chain and pairs."""
    pairs = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(20)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(50)]
    met = {*pairs, *[(b, a) for a, b in pairs]}
    want = brute_components({n for p in pairs for n in p}, lambda a, b: (a, b) in met)
    for hot in (2, 20_000):
        monkeypatch.setattr(components, "HOT", hot)
        assert {x.node: x.label for x in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()} == want


def test_components(spark):
    r = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in r.integers(-40, 160, (150, 2))] + [(1000 + i, 1001 + i) for i in range(30)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    met = defaultdict(set)
    for a, b in pairs:
        met[a].add(b), met[b].add(a)
    want = brute_components(nodes, lambda a, b: b in met[a])
    assert {x.node: x.label for x in connected_components(edges).collect()} == want
    assert connected_components(edges.limit(0)).count() == 0


def test_similarity_against_jaccard(spark):
    """Five-word shingles: pairs of Jaccard similarity 0.8 or more are linked, texts without any near one are left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {}
    for r in docs.orderBy("doc_id").collect():
        texts.setdefault(r.text, r.doc_id)
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for t, d in texts.items()}
    planted = []  # texts with single words changed, far enough apart to break five shingles each
    for d, t in list((d, t) for t, d in texts.items())[:60]:
        words = t.split()
        if len(words) > 120:
            for i in range(0, len(words), 60):
                words[i] = "changed"
            planted.append((10_000 + d, " ".join(words)))
            sets[10_000 + d] = set(simhash.shingle_hashes(planted[-1][1], 5).tolist())
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id bigint, text string"))
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(both).collect()}
    held = defaultdict(list)
    for d, s in sets.items():
        for h in s:
            held[h].append(d)
    shared = defaultdict(int)
    for own in held.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[min(a, b), max(a, b)] += 1
    similar = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    near = [p for p, j in similar.items() if j >= 0.8]
    assert len(near) > 40 and sum(component[a] == component[b] for a, b in near) >= 0.99 * len(near)
    most = defaultdict(float)
    for (a, b), j in similar.items():
        most[a], most[b] = max(most[a], j), max(most[b], j)
    groups = defaultdict(set)
    for d in sets:
        groups[component[d]].add(d)
    assert all(len(g) == 1 or any(most[d] > 0.4 for d in g) for g in groups.values())
    assert all(most[d] > 0.3 for g in groups.values() if len(g) > 1 for d in g)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("shingles", [2_000_000, 6_000])
def test_links_are_those_of_jaccard(spark, monkeypatch, shingles):
    """Pairs on both sides of 0.8, chains and a large group, against a brute-force version; large groups in tiles."""
    monkeypatch.setattr(simhash, "SET_SHINGLES", shingles)
    r = np.random.default_rng(3)
    texts = []
    for i in range(40):
        words = [f"{i}w{j}" for j in r.integers(0, 10**6, 204)]
        texts.append(words)
        changed = i % 10 + 1  # each breaks five shingles of 200 on both sides: Jaccard 0.95 to 0.60
        texts.append([f"new{w}" if j % 20 == 10 and j < 20 * changed else w for j, w in enumerate(words)])
    words = texts[0]
    for i in range(150):
        words = [f"step{i}" if j == i % 200 else w for j, w in enumerate(words)]
        texts.append(words)
    texts += [["same"] * 900 + ["one", "two", "three", "four", "five"], ["same"] * 900 + ["six", "seven", "eight", "nine", "ten"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    sets = [set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for t in texts]
    want = brute_components(range(len(sets)), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert len(set(want.values())) == 40 + 24 + 2
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()} == want
    packed = [np.unique(simhash.shingle_hashes(" ".join(t), 5)).tobytes() for t in texts]
    assert simhash.similar_sets(packed, 0.8).tolist() == [want[i] for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(20))
def test_similar_sets_against_all_pairs(seed):
    draw = np.random.default_rng(seed)
    bases = [draw.integers(0, 5000, draw.integers(1, 60)) for _ in range(4)]
    sets = [frozenset()]
    for _ in range(int(draw.integers(0, 150))):
        base = bases[draw.integers(4)]
        kept = base[draw.random(len(base)) > draw.choice([0.02, 0.1, 0.15])]
        sets.append(frozenset(kept.tolist() + draw.integers(0, 5000, draw.integers(0, 8)).tolist()))
    sets = list(dict.fromkeys(sets))
    packed = [np.sort(np.array(list(s), "<u8")).tobytes() for s in sets]
    for similarity in (0.5, 0.8, 1.0):
        want = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                    low, high = sorted((want[i], want[j]))
                    want = [low if x == high else x for x in want]
        assert simhash.similar_sets(packed, similarity).tolist() == want
