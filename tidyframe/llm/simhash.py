"""SimHash near-duplicates with a bit-sliced search.

Fingerprints are made from hashed word shingles. Candidate buckets come from equal bits: for a
given radius the bits are cut into more blocks than the radius, so that two fingerprints within
it agree on one block or more (exact; the more fingerprints, the more blocks make a key); for a
similarity on long fingerprints, from so many tables of sampled bits that of the pairs just at it
all but MISSED are met, whatever the number of texts. In a bucket fingerprints are stored as vertical bit planes; distances to
64 of them at once are counted by carry-save bitwise counters, and words whose lanes all exceed
the radius are abandoned early. A bucket returns only a spanning forest of its links, never all pairs.

Where a similarity is asked for, these components only hold the candidates: in each of them the
texts' shingle sets are compared, and links are the pairs whose Jaccard similarity reaches it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components, with_least
from .shared import checkpointed, shared_folder, slices, unused

SEED = 42
#: Fingerprints that a bucket should hold, and at which it is cut into tiles; tables of equal blocks at most, unless the radius asks for more.
BUCKET, TILE, TABLES = 512, 8192, 100
#: Share of the pairs just at the similarity that the search for candidates may miss, and standard deviations of their distance that it reaches beyond the mean.
MISSED, DEVIATIONS = 1e-6, 6
#: Pairs of a query and a word of lanes compared at a time, and planes between two looks for words to abandon.
PAIRS, PLANES = 16384, 15
#: Most hashes of candidates' texts that are broadcast, 8 bytes each; above, texts are shuffled to them.
BROADCAST_ROWS = 1_000_000
#: Shingles of the sets that a task compares with each other or with as many more.
SET_SHINGLES = 2_000_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; words are split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[k - 1 :] if len(words) >= k else ends[-1:]
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def _widened(h: np.ndarray, words: int) -> np.ndarray:
    """h and words - 1 further hashes made from it by a multiply-xor mixer."""
    out = [h]
    for i in range(1, words):
        x = h + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(text: str | None, k: int, words: int = 1) -> bytes:
    """8 * words bytes; a bit is 1 if it is set in over half the shingle hashes; no words: zero."""
    return _fingerprint(shingle_hashes(text, k), words)


def _fingerprint(h: np.ndarray, words: int) -> bytes:
    counts = np.zeros(64 * words, np.int64)
    offsets = np.arange(8 * words) * 256
    for start in range(0, len(h), 1 << 16):
        b = _widened(h[start : start + (1 << 16)], words).astype(">u8").view(np.uint8).reshape(-1, 8 * words)
        by_byte = np.bincount((b + offsets).ravel(), minlength=2048 * words).reshape(8 * words, 256)
        counts += (by_byte @ _BITS_OF_BYTE).ravel()
    return np.packbits(2 * counts > len(h)).tobytes()


def fingerprints(docs: DataFrame, shingle_words: int, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp binary) for every row; null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [fingerprint(t, shingle_words, bits // 64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp binary")


def _more_than(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, spread over the counters from the least bit up, is more than radius."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], _FULL)
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            same &= counters[level]
        else:
            more |= same & counters[level]
            same &= ~counters[level]
    return more


def _carry_saved(planes: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Bit counts of planes as lists by weight 1, 2, 4, ...: three of a weight become one of it and one of the next."""
    columns = [planes]
    for column in columns:
        carries = []
        while len(column) >= 3:
            x, y, z = column.pop(), column.pop(), column.pop()
            u = x ^ y
            column.append(u ^ z)
            carries.append((x & y) | (u & z))
        if carries:
            columns.append(carries)
    return columns


def _near(planes: np.ndarray, masks: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, word of 64 lanes) pairs, those left with lanes within radius, and these lanes."""
    levels = max(1, radius.bit_length())
    counters = [np.zeros(len(q), np.uint64) for _ in range(levels)]
    over = np.zeros(len(q), np.uint64)
    for first in range(0, len(planes), PLANES):
        columns = _carry_saved([planes[b][w] ^ masks[b][q] for b in range(first, min(first + PLANES, len(planes)))])
        for weight, column in enumerate(columns):
            for x in column:
                for i in range(weight, levels):
                    counters[i], x = counters[i] ^ x, counters[i] & x
                over |= x
        over |= _more_than(counters, radius)
        alive = over != _FULL
        left = np.count_nonzero(alive)
        if not left:
            return q[:0], w[:0], over[:0]
        if left < 0.7 * len(alive):
            q, w, over = q[alive], w[alive], over[alive]
            counters = [c[alive] for c in counters]
    return q, w, ~over


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For an (n, words) uint8 array of fingerprints: each row's least linked row, directly or through others."""
    n, bits = len(fps), fps.shape[1] * 8
    labels = np.arange(n)
    if n < 2:
        return labels
    flat = np.unpackbits(fps, axis=1)
    lanes = -(-n // 64)
    padded = np.zeros((bits, lanes * 64), np.uint8)
    padded[:, :n] = flat.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8").astype(np.uint64)
    step = max(64, PAIRS // lanes // 64 * 64)
    for at in range(0, n, step):
        rows = np.arange(at, min(at + step, n))
        masks = np.where(flat[rows].T.astype(bool), _FULL, np.uint64(0))
        words = np.arange(at // 64, lanes)
        q, w = np.repeat(np.arange(len(rows)), len(words)), np.tile(words, len(rows))
        later = w >= rows[q] // 64  # a row has met the lanes of earlier words as their queries' lane
        q, w, near = _near(planes, masks, q[later], w[later], radius)
        if not len(q):
            continue
        lit = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, lane = np.nonzero(lit)
        a, b = rows[q[pair]], w[pair] * 64 + lane
        keep = (b < n) & (a != b)
        a, b = a[keep], b[keep]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(np.diff(a)) + 1
        for group in np.split(np.arange(len(a)), cuts) if len(a) else []:
            found = np.unique(np.append(labels[b[group]], labels[a[group[0]]]))
            if len(found) > 1:
                labels[np.isin(labels, found)] = found[0]
    return labels


def bit_tables(n: int, bits: int, radius: int) -> list[list[int]]:
    """Which bits form the bucket key of each table, for n distinct fingerprints: two within ``radius`` always share a bucket.

    Of radius + m blocks such two agree on m or more; m is as large as buckets of BUCKET ask for, up to TABLES tables.
    """
    wanted = max(1, math.ceil(math.log2(max(2, n) / BUCKET)))
    usable = [m for m in range(1, 5) if m == 1 or math.comb(radius + m, m) <= TABLES]
    same = next((m for m in usable if m * (bits // (radius + m)) >= wanted), usable[-1])
    blocks = radius + same
    cut = [bits * i // blocks for i in range(blocks + 1)]
    own = [list(range(a, b)) for a, b in zip(cut, cut[1:])]
    return [sum(chosen, [])[:wanted] for chosen in combinations(own, same)]


def share_of_bits(similarity: float) -> float:
    """The share of bits in which fingerprints of two sets of that Jaccard similarity differ on average, at most.

    A bit is the sign of a random sum over the set, so that it differs with the angle between the sets over pi;
    the cosine is least for sets of one size.
    """
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def candidate_radius(bits: int, similarity: float) -> int:
    """A distance that sets of that similarity keep within, up to DEVIATIONS standard deviations."""
    p = share_of_bits(similarity)
    return min(bits, math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p))))


def sampled_tables(n: int, bits: int, similarity: float, missed: float = MISSED) -> list[list[int]]:
    """Tables of sampled bits, so many that two sets of that similarity share no bucket with probability ``missed`` at most.

    That is the mean over the distances (binomial) that such sets have; more similar ones are missed less.
    Keys grow with n, so that buckets stay at about BUCKET; the tables then grow as a small power of n.
    """
    k = max(1, math.ceil(math.log2(max(2, n) / BUCKET)))
    p = max(share_of_bits(similarity), 1e-9)
    logs = [math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1) + i * math.log(p) + (bits - i) * math.log1p(-p) for i in range(bits + 1)]
    chance = np.exp(logs)
    apart, tables = 1 - (1 - np.arange(bits + 1) / bits) ** k, 1
    while (chance * apart**tables).sum() > missed:
        tables += 1
    draw = np.random.default_rng(SEED)
    return [sorted(draw.choice(bits, k, replace=False).tolist()) for _ in range(tables)]


def _keyed(fps: DataFrame, tables: list[list[int]]) -> DataFrame:
    """(t, k, node, fp): a row for each table."""
    columns = sorted({b for t in tables for b in t})
    place = {b: i for i, b in enumerate(columns)}
    chosen = [[place[b] for b in t] for t in tables]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            bit = np.unpackbits(raw, axis=1)[:, columns].astype(np.int64)
            for t, own in enumerate(chosen):
                key = bit[:, own] @ (1 << np.arange(len(own), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(key), b.column(0), b.column(1)], ["t", "k", "node", "fp"])

    return fps.select("node", "fp").mapInArrow(run, "t int, k bigint, node bigint, fp binary")


def links(fps: DataFrame, tables: list[list[int]], radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest of the links in each bucket of the (node, fp) table.

    Buckets of over ``tile`` fingerprints are dealt in parts to tiles, one for each two parts.
    """
    keyed = _keyed(fps, tables)
    large = keyed.groupBy("t", "k").count().filter(F.col("count") > tile).withColumn("parts", F.ceil(F.col("count") / tile).cast("int")).drop("count")
    tiles = (
        keyed.join(large, ["t", "k"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("t", "k", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "node", "fp")
    )

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        raw = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(len(node), -1)
        root = linked(raw, radius)
        own = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": node[own], "b": node[root[own]]})

    return tiles.groupBy("t", "k", "i", "j").applyInArrow(run, "a bigint, b bigint")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")


def _sets(docs: DataFrame, shingle_words: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, fp, s, n) for every row, from the shared folder.

    s: a hash of the n distinct shingles' hashes in order, which names the set; fp: the fingerprint of these.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle_words)).astype("<u8") for t in b.column(2).to_pylist()]
            fp = [_fingerprint(h, bits // 64) for h in sets]
            s = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.binary()), pa.array(s), pa.array([len(h) for h in sets], pa.int64())], ["doc_id", "text_hash", "fp", "s", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    path = shared_folder(docs.sparkSession, "sets")
    docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp binary, s bigint, n bigint").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def shingles_of(docs: DataFrame, wanted: DataFrame, shingle_words: int, text_col: str) -> DataFrame:
    """(s, shingles) of the texts with a wanted text_hash, each text once: 8 bytes a shingle, in order.

    Candidates' shingles are made again from their texts, so that those of all texts need not be kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            packed = [np.unique(shingle_hashes(t, shingle_words)).astype("<u8").tobytes() for t in b.column(0).to_pylist()]
            s = np.array([xxhash.xxh64_intdigest(x) for x in packed], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(packed, pa.binary())], ["s", "shingles"])

    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(text_hash(text_col), F.col(text_col).alias("text")).join(F.broadcast(wanted) if few else wanted, "text_hash", "left_semi")
    return texts.dropDuplicates(["text_hash"]).select("text").mapInArrow(run, "s bigint, shingles binary")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _packed_rows(owner: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """A matrix of 0 and 1, packed to 64 columns a word, that is 1 at the given places."""
    packed = np.zeros((rows, -(-columns // 64)), np.uint64)
    np.bitwise_or.at(packed, (owner, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return packed


def similar_sets(packed: list[bytes], similarity: float) -> np.ndarray:
    """Of distinct sets of hashes in order: each one's least linked set, directly or through others.

    Two sets are linked if their Jaccard similarity is at least ``similarity``. Such sets share a hash
    among the rarest of each (as many as may differ, and one), so only sets that do are compared, each
    with those before it by size: first with one set of each group, then with what it is not yet linked
    to. Of two sets' shared hashes the common ones (in over a 64th of the sets) are counted on bits, so
    that a word takes 64 of them and all words take no more room than the sets, the others on postings.
    """
    size = np.array([len(x) // 8 for x in packed], np.int64)
    by_size = np.argsort(size, kind="stable")
    size, n = size[by_size], len(packed)
    hashes, value, count = np.unique(np.frombuffer(b"".join(packed[i] for i in by_size), "<u8"), return_inverse=True, return_counts=True)
    rarest = np.argsort(count, kind="stable")
    rank, count = np.empty(len(hashes), np.int64), count[rarest]
    rank[rarest] = np.arange(len(hashes))
    owner = np.repeat(np.arange(n), size)
    key = np.sort(owner * len(hashes) + rank[value])  # by set, then from the rarest hash on
    value = key - owner * len(hashes)
    ends = np.cumsum(size)

    fitting = np.searchsorted(size, similarity * size - 1e-9)  # the first set that is not too small
    least = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0).clip(max=size)
    at = _ranges(ends - size, least)
    meets = np.sort(value[at] * n + owner[at])
    meets_owner = meets % max(n, 1)
    meets_from, meets_to = np.searchsorted(meets, value[at] * n + fitting[owner[at]]), np.searchsorted(meets, value[at] * n + owner[at])
    least_ends = np.cumsum(least)

    common = int(np.searchsorted(count, max(1, n // 64), "right"))  # hashes from here on
    bits = _packed_rows(owner[value >= common], value[value >= common] - common, n, len(hashes) - common)
    shared_rare = np.flatnonzero((value < common) & (count[value] > 1))
    postings = np.sort(value[shared_rare] * n + owner[shared_rare])
    postings_owner = postings % max(n, 1)
    post_from, post_to = np.searchsorted(postings, value[shared_rare] * n), np.searchsorted(postings, value[shared_rare] * n + owner[shared_rare])
    rare_ends = np.searchsorted(owner[shared_rare], np.arange(n), "right")

    labels = np.arange(n)
    met = np.zeros(n, bool)
    for x in range(n):
        own = slice(least_ends[x] - least[x], least_ends[x])
        near = meets_owner[_ranges(meets_from[own], meets_to[own] - meets_from[own])]
        if not len(near):
            continue
        met[near] = True
        near = np.flatnonzero(met[:x])
        met[near] = False
        own = slice(rare_ends[x - 1], rare_ends[x])
        rare = np.bincount(postings_owner[_ranges(post_from[own], post_to[own] - post_from[own])], minlength=x)
        for some in (near[np.unique(labels[near], return_index=True)[1]], near):
            some = some[labels[some] != labels[x]]
            shared = rare[some] + np.bitwise_count(bits[some] & bits[x]).sum(axis=1, dtype=np.int64)
            linked_to = some[shared >= similarity * (size[some] + size[x] - shared) - 1e-9]
            if len(linked_to):
                found = np.unique(np.append(labels[linked_to], labels[x]))
                labels[: x + 1][np.isin(labels[: x + 1], found)] = found[0]
    first = np.full(n, n)
    np.minimum.at(first, labels, by_size)
    out = np.empty(n, np.int64)
    out[by_size] = first[labels]
    return out


def linked_sets(chosen: DataFrame, shingles: DataFrame, key: str, similarity: float) -> DataFrame:
    """(a, b): links between the named sets (label, s, n, key) of one label whose Jaccard similarity is at least ``similarity``.

    ``shingles`` has their hashes by key. The labels' sets are connected as by all links. Small groups
    share a task; those of over SET_SHINGLES shingles are dealt in parts to tiles.
    """
    total = chosen.agg(F.sum("n")).first()[0] or 0
    bundles = max(1, -(-8 * total // SET_SHINGLES))
    size = chosen.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).filter("sets > 1")
    size = size.select("label", F.greatest(F.ceil(F.col("shingles") / SET_SHINGLES), F.ceil(F.col("sets") / TILE)).cast("int").alias("parts"))
    tiles = (
        chosen.join(size, "label")
        .withColumn("g", F.when(F.col("parts") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bundles))))
        .withColumn("large", F.col("parts") > 1)
        .withColumn("p", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
        .select("large", "g", "parts", "p", "s", F.col(key).alias("set_key"))
        .join(shingles.select(F.col(key).alias("set_key"), "shingles"), "set_key")
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("large", "g", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "s", "shingles")
    )

    def run(table: pa.Table) -> pa.Table:
        s, first = np.unique(table.column("s").to_numpy(), return_index=True)
        root = similar_sets(table.column("shingles").take(pa.array(first)).to_pylist(), similarity)
        own = np.flatnonzero(root != np.arange(len(s)))
        return pa.table({"a": s[own], "b": s[root[own]]})

    return tiles.groupBy("large", "g", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _candidates(sets: DataFrame, parts: DataFrame, fps: DataFrame) -> DataFrame:
    """(label, s, n, text_hash): the sets that lie in one component of fingerprints, or share one."""
    label = fps.select("fp", "node").join(parts, "node").select("fp", "label")
    single = sets.groupBy("fp").agg(F.min("s").alias("s"), F.max("s").alias("other")).filter("s <> other").select("fp")  # equal fingerprints of other sets
    label = label.unionByName(single.join(label, "fp", "left_anti").select("fp", F.xxhash64("fp").alias("label")))
    return checkpointed(sets.filter("n > 0").select("fp", "s", "n", "text_hash").join(label, "fp").select("label", "s", "n", "text_hash"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, bits: int = 384, radius: int | None = None, similarity: float = 0.8, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of ``docs``.

    With a ``radius`` two rows are linked if their fingerprints differ in at most that many bits.
    Without one, fingerprints within ``candidate_radius`` give the candidates (those of distinct
    shingles), and two of these are linked if the Jaccard similarity of their sets of shingles is
    at least ``similarity``. component_id is the least id reachable over links.
    Null and empty texts have fingerprint zero and equal sets and are linked like any other. Repeated
    rows stay repeated. Null ids never name a component unless all ids in it are null. Very long texts are
    read whole. An empty table gives no rows; further columns are left out.
    """
    verify = radius is None
    radius = candidate_radius(bits, similarity) if verify else radius
    rows = _sets(docs, shingle_words, bits, id_col, text_col) if verify else checkpointed(fingerprints(docs, shingle_words, bits, id_col, text_col))
    node = F.conv(F.hex("fp"), 16, -10).cast("bigint") if bits == 64 else F.xxhash64("fp")
    if verify:
        sets = checkpointed(rows.groupBy("s").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.min("text_hash").alias("text_hash")))
    fps = checkpointed((sets.select("fp", "least") if verify else rows.select("fp", F.col("doc_id").alias("least"))).groupBy("fp").agg(F.min("least").alias("least")).withColumn("node", node))
    n = fps.count()
    tables = sampled_tables(n, bits, similarity) if verify else bit_tables(n, bits, radius)
    parts = connected_components(links(fps, tables, radius, tile))
    key = "fp"
    if verify:
        chosen = _candidates(sets, parts, fps)
        parts = connected_components(linked_sets(chosen.select("label", "s", "n"), shingles_of(docs, chosen.select("text_hash"), shingle_words, text_col), "s", similarity))
        key, fps = "s", sets.select("s", "least", F.col("s").alias("node"))
    named = checkpointed(fps.select("node", "least").join(parts, "node"))
    component = checkpointed(with_least(named, "label", F.col("least"), "component", named.count())[0].select("node", "component"))
    # a table of its own, so that Spark sees both sides of the join with all rows as they are dealt and splits a key that most rows have
    known = checkpointed(fps.join(component, "node", "left").select(key, F.coalesce("component", "least").alias("component_id")))
    return rows.join(known, key).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its near-duplicate group; all columns stay.

    Rows that repeat the kept id all stay, as do rows without an id, which no group can name. Null
    and empty texts are one group. Very long texts are read whole. An empty table gives no rows; no column's
    name can clash.
    """
    (own,) = unused(docs.columns, "_kept")
    kept = near_duplicates(docs, **options).filter("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(own)), "left_semi")
