"""LM scoring by a hierarchical Pitman-Yor model over whole-word contexts.

Each token is seated in the restaurant of the word before it, or of the start of a text; all these
restaurants share one parent, whose base is uniform over the vocabulary and one unknown word. A
Gibbs step takes all customers of a dish (context, word) out of its restaurant and seats them
again given everybody else's tables: the number of their tables is drawn from its conditional
distribution (Chinese restaurants by generalised Stirling numbers); of over EXACT customers
the first EXACT so, the others one after another, in groups of a quarter of the seated, each a
binomial draw at the chances in the middle of the group. Every table sends a customer to the parent, which is seated likewise. Tables start at one a dish; the first sweep is
left out, and predictive probabilities are averaged over the others. Discounts come from the
numbers of dishes seen once and twice.

How it runs. Documents are gathered into blocks of about BLOCK_TOKENS tokens. A block sends its
distinct words to partitions by word and its distinct pairs to partitions by pair, as packed
arrays, and gets back what the whole corpus knows of them: counts, and which block of several
owns a pair. In each sweep a block seats the dishes it owns, from the tables that the sweep before left, and sends its tables' sums by word; the
word partitions add them up, seat the parent and send back each block's own words. Draws are made
of hashes of the dish, the sweep and the group alone, so that any block repeats them: texts are
scored by the very tables that the restaurants' totals hold, and probabilities sum to one. Nothing but a few sums goes
through the driver, and no task holds more than a block or a partition of words or pairs, whose
number follows the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .shared import shared_folder, shuffle_partitions, slices

#: Pseudo-word that is the context of a text's first token, and the token that ends a text.
START, END = b" ", b""
#: Gibbs sweeps, of which the first is left out; strength of the restaurants and of their parent.
SWEEPS = 4
CONCENTRATION, ROOT_CONCENTRATION = 0.1, 1.0
#: Customers of a dish up to which the number of its tables is drawn at once; mean of a binomial draw from which it is drawn as normal.
EXACT, NORMAL = 32, 32.0
#: Tokens of a block; words and pairs that blocks send to a partition, about.
BLOCK_TOKENS, PARTITION_WORDS, PARTITION_PAIRS = 2_000_000, 1_000_000, 2_000_000
#: Elements of a matrix of weights.
WEIGHTS = 2_000_000
_ODD = 0x9E3779B97F4A7C15

#: Rows of every table and exchange here; a to d hold packed arrays that each kind explains.
ROW = "kind int, block bigint, p int, sweep int, a binary, b binary, c binary, d binary, x array<double>"
_BLOCK, _WORDS, _PAIRS, _DISHES, _SUMS, _STATE, _BACK, _TABLES = range(8)
_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
_NAMES = [c.split(" ")[0] for c in ROW.split(", ")]


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space, then the end."""
    return [*(text or "").encode().lower().split(), END]


# ---- packed arrays


def _row(kind: int, block: int = -1, p: int = -1, sweep: int = -1, a: bytes | None = None, b: bytes | None = None, c: bytes | None = None, d: bytes | None = None, x: list | None = None) -> tuple:
    return kind, block, p, sweep, a, b, c, d, x


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_NAMES), _TYPES)], _NAMES)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def swell(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""


def pack(values: np.ndarray) -> bytes:
    """A number array in few bytes: byte planes, compressed."""
    v = np.ascontiguousarray(values)
    planes = np.empty((v.dtype.itemsize, len(v)), np.uint8)
    for i, plane in enumerate(planes):
        plane[:] = v.view(np.uint8)[i :: len(planes)]
    return squeeze(planes.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(swell(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    v = np.empty(planes.shape[1], kind)
    for i, plane in enumerate(planes):
        v.view(np.uint8)[i :: len(planes)] = plane
    return v


def pack_sorted(values: np.ndarray) -> bytes:
    """For an ascending array of unsigned numbers: its steps are packed."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---- seating


class Seating:
    """Draws of the number of tables that a dish's customers take, at one discount."""

    def __init__(self, discount: float):
        self.discount = discount
        self.ways = np.zeros((EXACT + 1, EXACT + 2))  # generalised Stirling numbers by customers and tables
        self.ways[1, 1] = 1.0
        for c in range(1, EXACT):
            self.ways[c + 1, 1:] = self.ways[c, 1:] * np.maximum(c - discount * np.arange(1, EXACT + 2), 0.0) + self.ways[c, :-1]

    def draw(self, customers: np.ndarray, first: np.ndarray, more: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Tables of each dish, drawn by its ``seed``; a new one weighs ``first``, and ``more`` with each that the dish has by then."""
        tables = np.minimum(customers, 1).astype(np.float64)
        at_once = np.minimum(customers, EXACT).astype(np.uint16)
        order = np.argsort(at_once, kind="stable")
        ends = np.searchsorted(at_once[order], np.arange(EXACT + 1), side="right").tolist()
        for c in range(2, EXACT + 1):
            step = max(1, WEIGHTS // c)
            for i in range(ends[c - 1], ends[c], step):
                own = order[i : min(ends[c], i + step)]
                tables[own] = self._at_once(c, first[own], more[own], seed[own])
        large = np.flatnonzero(customers > EXACT)
        large = large[np.argsort(-customers[large], kind="stable")]
        tables[large] = self._in_groups(customers[large], tables[large], first[large], more[large], seed[large])
        return tables

    def _at_once(self, c: int, first: np.ndarray, more: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Tables of c customers each: one inverse draw over all numbers of tables."""
        weight, upto = first, [first * self.ways[c, 1]]
        for k in range(1, c):
            weight = weight * (first + more * k)
            upto.append(upto[-1] + weight * self.ways[c, k + 1])
        goal, tables = _uniform(_mixed(seed)) * upto[-1], np.ones(len(first))
        for x in upto[:-1]:
            tables += x < goal
        return tables

    def _in_groups(self, customers: np.ndarray, tables: np.ndarray, first: np.ndarray, more: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Tables of dishes, the largest first, whose customers after the first EXACT come in groups of a quarter of those seated."""
        seated, groups = EXACT, 0
        while n := int(np.searchsorted(-customers, -seated)):
            group = np.minimum(max(1, seated // 4), customers[:n] - seated)
            t, half = tables[:n], (group - 1) / 2
            for _ in range(2):  # by the chances at the group's start, then at those in its middle
                weight = first[:n] + more[:n] * t
                p = np.minimum(1.0, weight / (weight + seated + half - self.discount * t))
                t = tables[:n] + p * half
            groups += 1
            tables[:n] += _binomial(group, p, _mixed(seed[:n] + np.uint64(groups * _ODD & 0xFFFFFFFFFFFFFFFF)))
            seated += max(1, seated // 4)
        return tables


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers of [0, 1) from hashes."""
    return (h >> np.uint64(11)).astype(np.float64) / 9007199254740992.0


def _binomial(n: np.ndarray, p: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Binomial draws by hashes: the least k whose distribution reaches a uniform number; of a large mean, a rounded normal number."""
    p = np.minimum(p, 1 - 1e-12)
    u, mean, k = _uniform(seed), n * p, np.zeros(len(n))
    left = np.flatnonzero(mean < NORMAL)
    u_left, m, odds = u[left], n[left], p[left] / (1 - p[left])
    chance = np.exp(m * np.log1p(-p[left]))
    below, at = chance.copy(), 0
    while True:
        more = np.flatnonzero((u_left > below) & (at < m))
        if not len(more):
            break
        left, u_left, m, odds, chance, below = (x[more] for x in (left, u_left, m, odds, chance, below))
        at += 1
        chance = chance * (m - at + 1) / at * odds
        below = below + chance
        k[left] = at
    large = np.flatnonzero(mean >= NORMAL)
    normal = np.sqrt(-2 * np.log1p(-u[large])) * np.cos(2 * np.pi * _uniform(_mixed(seed[large] + np.uint64(_ODD))))
    k[large] = np.clip(np.rint(mean[large] + normal * np.sqrt(mean[large] * (1 - p[large]))), 0, n[large])
    return k


class Model:
    """What all tasks need: sizes, discounts, and of each sweep (the start is -1) the parent's customers and tables."""

    def __init__(self, total: int, vocabulary: int, discount: float, root_discount: float):
        self.total, self.vocabulary = total, vocabulary
        self.discount, self.root_discount = discount, root_discount
        self.base = 1.0 / (vocabulary + 1)
        self.sums: dict[int, tuple[float, float]] = {}

    def parent(self, sweep: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of words with these customers and tables in it; unknown ones have none."""
        every, own = self.sums[sweep]
        return (customers - self.root_discount * tables + (ROOT_CONCENTRATION + self.root_discount * own) * self.base) / (ROOT_CONCENTRATION + every)

    def seat_root(self, seating: Seating, sweep: int, ids: np.ndarray, customers: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The parent's tables of words: each one's customers are seated again beside the others' tables before."""
        first = (ROOT_CONCENTRATION + self.root_discount * np.maximum(self.sums[sweep - 1][1] - before, 0.0)) * self.base
        return seating.draw(customers, first, np.full(len(ids), self.root_discount * self.base), _mixed(ids * np.uint64(_ODD) + np.uint64(sweep + 2)))

    def seat(self, upto: int, u: np.ndarray, w: np.ndarray, c: np.ndarray, known: _Known, start: int = 0, t: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Tables of dishes (u, w) with c customers after sweeps ``start`` to ``upto``, before which they are t (one a dish): the same in every block."""
        ids, tables, parents, seating = known.ids, known.tables, known.parents, Seating(self.discount)
        t = np.minimum(c, 1) if t is None else t
        name = _mixed(ids[u] * np.uint64(_ODD) + ids[w])
        for sweep in range(start, upto + 1):
            p = parents[sweep - 1][w]
            first = (CONCENTRATION + self.discount * np.maximum(tables[sweep - 1][u] - t, 0)) * p
            t = seating.draw(c, first, self.discount * p, _mixed(name + np.uint64(sweep + 1)))
            yield t

    def probability(self, known: _Known, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of words w after u that follow it c times: the mean over the kept sweeps."""
        several, tables = np.flatnonzero(c > 1), np.minimum(c, 1).astype(np.float64)
        kept, p = SWEEPS - 1, np.zeros(len(u))
        for sweep, t in enumerate(self.seat(kept, u[several], w[several], c[several], known)):
            if sweep:
                tables[several] = t
                p += c - self.discount * tables + (CONCENTRATION + self.discount * known.tables[sweep][u]) * known.parents[sweep][w]
        return p / kept / (CONCENTRATION + known.n[u])


# ---- blocks


class _Gathered:
    """Tokens of some documents as numbers of their distinct words."""

    def __init__(self):
        self.words: dict[bytes, int] = defaultdict(None, {START: 0})
        self.words.default_factory = self.words.__len__  # a new word's number
        self.ids: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.learn: list[bool] = []
        self.size = 0

    def add(self, doc: int | None, text: str | None, learn: bool) -> None:
        split = tokens(text)
        self.ids.append(np.fromiter(map(self.words.__getitem__, split), np.int32, len(split)))
        self.docs.append(doc)
        self.learn.append(learn)
        self.size += len(split)

    def row(self, name: int) -> tuple:
        """a: words; b: tokens; c: (id, whether it has one, tokens, whether it is learned from) of each document."""
        docs = np.array([(d or 0, d is not None, len(i), x) for d, i, x in zip(self.docs, self.ids, self.learn)], np.int64).reshape(-1, 4)
        return _row(_BLOCK, name, a=squeeze(b"\n".join(self.words)), b=pack(np.concatenate(self.ids)), c=pack(docs.ravel()), x=[float(self.size), float(len(self.words))])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, block = TaskContext.get().partitionId(), 0, _Gathered()
    for b in slices(batches):
        for doc, text, learn in zip(*(b.column(i).to_pylist() for i in range(3))):
            block.add(doc, text, learn)
            if block.size >= BLOCK_TOKENS:
                yield _batch([block.row(part << 32 | number)])
                number, block = number + 1, _Gathered()
    if block.docs:
        yield _batch([block.row(part << 32 | number)])


class Block:
    """A block's documents, and its distinct pairs of (context, word) in order of their numbers."""

    def __init__(self, row: dict):
        self.words = swell(row["a"]).split(b"\n")
        self.ids = unpack(row["b"], "<i4")
        self.docs = unpack(row["c"], "<i8").reshape(-1, 4)
        self.keys = np.zeros(len(self.ids), np.int64)
        self.keys[1:] = self.ids[:-1]
        self.keys[np.cumsum(self.docs[:, 2]) - self.docs[:, 2]] = 0  # the start's number
        self.keys <<= 32
        self.keys |= self.ids

    def counts(self) -> np.ndarray:
        """How often each word is learned from; of the start: documents that are."""
        n = np.bincount(self.ids[self.learned()], minlength=len(self.words)).astype(np.int64)
        n[0] = self.docs[:, 3].sum()
        return n

    def learned(self) -> np.ndarray:
        """Whether each token is learned from."""
        return np.repeat(self.docs[:, 3] > 0, self.docs[:, 2])

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter(map(digest, self.words), np.uint64, len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts and words of the distinct pairs, and their keys in order."""
        key = np.sort(self.keys)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        return key >> 32, key & 0xFFFFFFFF, key

    def pair_of_token(self) -> np.ndarray:
        """Each token's place among the distinct pairs in order of their keys."""
        order = np.argsort(self.keys)
        key = self.keys[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        return place

    def pair_counts(self) -> np.ndarray:
        key = self.keys << 1
        key |= self.learned()  # learned ones come last in a pair
        key.sort()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] >> 1 != key[:-1] >> 1)))
        return np.add.reduceat(key & 1, starts)


def _pair_hashes(h: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(h[u] * np.uint64(_ODD) + h[w])


def _parts(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each hash: equal ranges."""
    return (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _cut(p: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of the runs of a sorted array."""
    starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, int)
    yield from zip(p[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(p)])


def _each(run: Callable[[dict], list[tuple]]) -> Callable:
    """A function of Arrow batches from one of rows."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield _batch(run(b.slice(i, 1).to_pylist()[0]))

    return go


def _sent_words(parts: int) -> Callable[[dict], list[tuple]]:
    """a: words; b: their numbers in the block; c: their counts."""
    def run(row: dict) -> list[tuple]:
        block = Block(row)
        p, n = _parts(block.hashes(), parts), block.counts()
        order = np.argsort(p, kind="stable")
        return [_row(_WORDS, row["block"], q, a=squeeze(b"\n".join([block.words[i] for i in order[s:e].tolist()])), b=pack(order[s:e].astype("<u4")), c=pack(n[order[s:e]])) for q, s, e in _cut(p[order])]

    return run


def _sent_pairs(parts: int) -> Callable[[dict], list[tuple]]:
    """a: hashes in order; b: counts."""
    def run(row: dict) -> list[tuple]:
        block = Block(row)
        u, w, _ = block.pairs()
        h = _pair_hashes(block.hashes(), u, w)
        order = np.argsort(h, kind="stable")
        h, n = h[order], block.pair_counts()[order]
        return [_row(_PAIRS, row["block"], q, a=pack_sorted(h[s:e]), b=pack(n[s:e])) for q, s, e in _cut(_parts(h, parts))]

    return run


def _joined_rows(rows: list[dict], column: str, kind: str, unpacked: Callable = unpack) -> tuple[np.ndarray, np.ndarray]:
    """A packed column's values of all rows one after another, and where each row's end."""
    found = [unpacked(r[column], kind) for r in rows]
    return (np.concatenate(found) if found else np.zeros(0, kind)), np.cumsum([len(f) for f in found])


def _by_block(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["block"], r["p"], r["sweep"]))


def _counted_words(table: pa.Table) -> pa.Table:
    """For each block its words that are learned from: a: numbers in the block; b: places in the partition, in order; c: counts.

    One more row: x: words and tokens of the partition.
    """
    rows = _by_block(table)
    every = pa.chunked_array([pa.array(swell(r["a"]).split(b"\n"), pa.binary()) for r in rows]).combine_chunks()
    local, ends = _joined_rows(rows, "b", "<u4")
    counts, _ = _joined_rows(rows, "c", "<i8")
    codes = every.dictionary_encode()
    n = np.bincount(codes.indices.to_numpy(), counts, len(codes.dictionary)).astype(np.int64)
    order = pc.array_sort_indices(codes.dictionary).to_numpy()
    place = np.full(len(order), -1)
    place[order[n[order] > 0]] = np.arange((n > 0).sum())  # learned ones are numbered in order of their bytes
    out, at = [], codes.indices.to_numpy()
    for r, s, e in zip(rows, [0, *ends[:-1].tolist()], ends.tolist()):
        own = np.argsort(place[at[s:e]], kind="stable") + s
        own = own[place[at[own]] >= 0]
        out.append(_row(_WORDS, r["block"], r["p"], a=pack(local[own]), b=pack_sorted(place[at[own]].astype("<u4")), c=pack(n[at[own]])))
    real = pc.not_equal(codes.dictionary, pa.scalar(START, pa.binary())).to_numpy(zero_copy_only=False)
    return pa.Table.from_batches([_batch([*out, _row(_STATE, p=rows[0]["p"], x=[float(((n > 0) & real).sum()), float(n[real].sum())])])])


def _counted_pairs(table: pa.Table) -> pa.Table:
    """For each block its pairs' counts in the whole corpus, doubled, and one more where the block owns the pair."""
    rows = _by_block(table)
    h, ends = _joined_rows(rows, "a", "<u8", unpack_sorted)
    n, _ = _joined_rows(rows, "b", "<i8")
    order = np.argsort(h, kind="stable")
    fresh = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    starts, pair = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    total = np.add.reduceat(n[order], starts)[pair]
    some = np.flatnonzero(n[order] > 0)
    owner = some[np.concatenate(([True], pair[some][1:] != pair[some][:-1]))] if len(some) else some
    v = np.empty(len(h), np.int64)
    v[order] = total << 1
    v[order[owner]] += 1
    return pa.Table.from_batches([_batch([_row(_PAIRS, r["block"], r["p"], a=pack(v[s:e])) for r, s, e in zip(rows, [0, *ends[:-1].tolist()], ends.tolist())])])


class _Known:
    """What a block has been sent back: of its words the count, id, and by sweep tables, parent's customers and tables."""

    def __init__(self, rows: list[dict], words: int, model: Model | None = None):
        self.parts = [r for r in rows if r["kind"] == _WORDS]
        self.at = {r["p"]: unpack(r["a"], "<u4").astype(np.int64) for r in self.parts}
        self.n, self.ids = np.zeros(words, np.int64), np.zeros(words, np.uint64)
        self.tables: dict[int, np.ndarray] = {}
        self.parents: dict[int, np.ndarray] = {}
        for r in self.parts:
            at = self.at[r["p"]]
            self.n[at] = unpack(r["c"], "<i8")
            self.ids[at] = np.uint64(r["p"]) << np.uint64(32) | unpack_sorted(r["b"], "<u4").astype(np.uint64)
        root: dict[int, np.ndarray] = {}
        for r in rows:
            if r["kind"] == _BACK:
                at, sweep = self.at[r["p"]], r["sweep"]
                if sweep not in root:
                    self.tables[sweep], root[sweep] = np.zeros(words, np.int64), np.zeros((2, words), np.int64)
                self.tables[sweep][at], root[sweep][0, at], root[sweep][1, at] = (unpack(r[x], "<i8") for x in "abc")
        for sweep in root if model else ():
            self.parents[sweep] = model.parent(sweep, *root[sweep])

    def sums(self, block: int, sweep: int, of_context: np.ndarray, of_word: np.ndarray) -> list[tuple]:
        """a: places in the partition; b, c: sums of its words as contexts and as words."""
        return [_row(_SUMS, block, r["p"], sweep, a=r["b"], b=pack(of_context[self.at[r["p"]]]), c=pack(of_word[self.at[r["p"]]])) for r in self.parts]


def _pair_values(rows: list[dict], h: np.ndarray) -> np.ndarray:
    """The values sent back for pairs, in the order of their numbers."""
    v, _ = _joined_rows(sorted((r for r in rows if r["kind"] == _PAIRS), key=lambda r: r["p"]), "a", "<i8")
    out = np.empty(len(h), np.int64)
    out[np.argsort(h, kind="stable")] = v
    return out


def _owned(table: pa.Table) -> pa.Table:
    """Of a block: its dishes of several customers (a: contexts; b: words; c: customers; x: those of one and of two), and sums of dishes."""
    rows = table.to_pylist()
    row = next(r for r in rows if r["kind"] == _BLOCK)
    block = Block(row)
    known = _Known(rows, len(block.words))
    u, w, _ = block.pairs()
    v = _pair_values(rows, _pair_hashes(block.hashes(), u, w))
    own = np.flatnonzero((v & 1) > 0)
    u, w, c = u[own], w[own], v[own] >> 1
    several = c > 1
    dishes = _row(_DISHES, row["block"], a=pack(u[several].astype("<u4")), b=pack(w[several].astype("<u4")), c=pack(c[several]), x=[float((c == 1).sum()), float((c == 2).sum()), float(len(block.words))])
    of = lambda x: np.bincount(x, minlength=len(block.words)).astype(np.int64)
    return pa.Table.from_batches([_batch([dishes, *known.sums(row["block"], -1, of(u), of(w))])])


def _seated_dishes(model: Model, sweep: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block: by word the tables beyond one of each dish it owns, after the sweep; and the dishes' tables (a), from which the next one goes on.

    Without tables of the sweep before, all sweeps are done again.
    """
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(r for r in rows if r["kind"] == _DISHES)
        words = int(row["x"][2])
        known = _Known(rows, words, model)
        u, w, c = unpack(row["a"], "<u4").astype(np.int64), unpack(row["b"], "<u4").astype(np.int64), unpack(row["c"], "<i8")
        before = {r["sweep"]: unpack(r["a"], "<u4").astype(np.float64) for r in rows if r["kind"] == _TABLES}.get(sweep - 1)
        *_, t = model.seat(sweep, u, w, c, known, 0 if before is None else sweep, before)
        of = lambda x: np.bincount(x, t - 1, words).astype(np.int64)
        kept = _row(_TABLES, row["block"], known.parts[row["block"] % len(known.parts)]["p"], sweep, a=pack(t.astype("<u4")))
        return pa.Table.from_batches([_batch([kept, *known.sums(row["block"], sweep, of(u), of(w))])])

    return run


def _seated_words(model: Model | None, sweep: int) -> Callable[[pa.Table], pa.Table]:
    """Of a word partition: its state (a: tables as context, b: customers and c: tables in the parent), x: the parent's customers, tables, words of one and of two customers; and each block's words of it. Blocks' tables pass unchanged."""
    def run(table: pa.Table) -> pa.Table:
        rows = _by_block(table)
        sent, states = [r for r in rows if r["kind"] == _SUMS], {r["sweep"]: r for r in rows if r["kind"] == _STATE}
        places = [unpack_sorted(r["a"], "<u4").astype(np.int64) for r in sent]
        size = len(unpack(states[-1]["a"], "<i8")) if states else 1 + max((int(x[-1]) for x in places if len(x)), default=-1)
        context, customers = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r, at in zip(sent, places):
            context[at] += unpack(r["b"], "<i8")
            customers[at] += unpack(r["c"], "<i8")
        if sweep < 0:
            tables = np.minimum(customers, 1)
        else:
            context += unpack(states[-1]["a"], "<i8")
            customers += unpack(states[-1]["b"], "<i8")
            ids = np.uint64(rows[0]["p"]) << np.uint64(32) | np.arange(size, dtype=np.uint64)
            tables = model.seat_root(Seating(model.root_discount), sweep, ids, customers, unpack(states[sweep - 1]["c"], "<i8")).astype(np.int64)
        sums = [float(x) for x in (customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum())]
        state = _row(_STATE, p=rows[0]["p"], sweep=sweep, a=pack(context), b=pack(customers), c=pack(tables), x=sums)
        back = [_row(_BACK, r["block"], r["p"], sweep, a=pack(context[at]), b=pack(customers[at]), c=pack(tables[at])) for r, at in zip(sent, places)]
        return pa.Table.from_batches([_batch([state, *back, *[tuple(r.values()) for r in rows if r["kind"] == _TABLES]])])

    return run


def _scored(model: Model) -> tuple[Callable[[pa.Table], pa.Table], str]:
    """Of a block: a row for each document."""
    schema = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = Block(next(r for r in rows if r["kind"] == _BLOCK))
        known = _Known(rows, len(block.words), model)
        u, w, _ = block.pairs()
        c = _pair_values(rows, _pair_hashes(block.hashes(), u, w)) >> 1
        p = np.log10(model.probability(known, u, w, c))[block.pair_of_token()]
        base = np.log10((known.n + 1) / (model.total + model.vocabulary + 1))
        starts = np.cumsum(block.docs[:, 2]) - block.docs[:, 2]
        of_doc = lambda x: pa.array(np.add.reduceat(x, starts))  # noqa: E731  each document has a token, its end
        ids = pa.array(block.docs[:, 0], mask=block.docs[:, 1] == 0)
        return pa.table([ids, pa.array(block.docs[:, 2]), of_doc((known.n > 0).astype(np.int64)[block.ids]), of_doc(base[block.ids]), of_doc(p)], [x.split(" ")[0] for x in schema.split(", ")])

    return run, schema


# ---- the jobs


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "none").parquet(path)  # what it holds is compressed
    return df.sparkSession.read.parquet(path)


def _together(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _sums(rows: DataFrame, n: int) -> list[float]:
    """The first n numbers of x, added up."""
    found = rows.agg(*[F.sum(F.get("x", F.lit(i))) for i in range(n)]).first()
    return [v or 0.0 for v in found]


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.1, 0.95))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the tables of blocks with all that was sent back to them, in the shared folder.

    The model learns from the rows where ``learn`` is true. Null texts count as empty; an empty
    table, or none to learn from, gives a model that knows no word.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    n = 2 * shuffle_partitions(docs.sparkSession)
    blocks = _written(rows.mapInArrow(_gathered, ROW), "blocks")
    size, words = _sums(blocks, 2)
    words, pairs = max(n, int(words // PARTITION_WORDS)), max(n, int(size // PARTITION_PAIRS))
    counted = _written(blocks.mapInArrow(_each(_sent_words(words)), ROW).groupBy("p").applyInArrow(_counted_words, ROW), "words")
    vocabulary, total = _sums(counted.filter(F.col("kind") == _STATE), 2)
    known = counted.filter(F.col("kind") == _WORDS)
    met = _written(blocks.mapInArrow(_each(_sent_pairs(pairs)), ROW).groupBy("p").applyInArrow(_counted_pairs, ROW), "pairs")
    owned = _written(_together(blocks, known, met).groupBy("block").applyInArrow(_owned, ROW), "dishes")
    dishes = owned.filter(F.col("kind") == _DISHES)
    state = _written(owned.filter(F.col("kind") == _SUMS).groupBy("p").applyInArrow(_seated_words(None, -1), ROW), "start")
    own = _sums(state.filter(F.col("kind") == _STATE), 4)
    model = Model(int(total), int(vocabulary), _discount(*_sums(dishes, 2)), _discount(own[2], own[3]))
    model.sums[-1] = own[0], own[1]
    after = state
    for sweep in range(SWEEPS):
        of_blocks = _together(dishes, known, after.filter(F.col("kind").isin(_BACK, _TABLES))).groupBy("block").applyInArrow(_seated_dishes(model, sweep), ROW)
        held = state.filter((F.col("kind") == _STATE) & F.col("sweep").isin(-1, sweep - 1))
        after = _written(_together(of_blocks, held).groupBy("p").applyInArrow(_seated_words(model, sweep), ROW), f"sweep{sweep}")
        own = _sums(after.filter(F.col("kind") == _STATE), 2)
        model.sums[sweep] = own[0], own[1]
        state = _together(state, after)
    return model, _together(blocks, known, met, state.filter(F.col("kind") == _BACK))


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of ``docs``.

    The model learns from the rows where ``learn`` is true. Null counts as empty: one token, the end.
    Without any row to learn from all words are unknown. Repeated rows stay repeated; an empty
    table gives no rows; further columns are left out. Ids are integers, or null. A very long text is
    one block of its own: it must fit in a task's memory.
    """
    model, rows = train(docs, learn, id_col, text_col)
    run, schema = _scored(model)
    scored = rows.groupBy("block").applyInArrow(run, schema)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
