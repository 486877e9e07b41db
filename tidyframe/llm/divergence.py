"""Source divergence audit: how far the words of each source differ from those of the other sources and of its language.

Terms of a language are counted by source, kept if enough documents hold them, and dealt in order of
their counts to blocks. In a block each source has a segment tree over the terms: a leaf is the term's
count, a node its two children. Nodes are hash-consed over all sources, so that equal subtrees, such as
the many without any occurrence, are one node. Two sources are compared by walking both trees at once
from the roots down; on each level a pair of nodes that occurs several times is followed once and
remembers how often. What comes down to the leaves are the pairs of counts, and each is priced once.

Probabilities are whole numbers in billionths, and all arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .shared import checkpointed, shared_folder, slices

SCALE = 1_000_000_000
#: Characters of a term: ASCII letters and all beyond ASCII. Only A-Z change case.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
#: Tokens and distinct terms that a task counts before it hands them on.
TOKENS, VOCABULARY = 4_000_000, 500_000
#: Terms of a block; cells (terms by sources) that trees are built of at once; pairs of sources walked at once.
BLOCK_BITS, CELLS, PAIRS = 15, 4_000_000, 64
#: Most rows of the table of groups that are broadcast; above, joins shuffle.
BROADCAST_ROWS = 100_000


class _Vocabulary(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Counter:
    """Counts of a task by language, term and source, and the documents of each term."""

    def __init__(self):
        self.vocabularies: dict[int, _Vocabulary] = {}
        self.clear()

    def clear(self) -> None:
        self.vocabularies.clear()
        self.kept: dict[int, list] = {}
        self.tokens = 0

    def add(self, langs: np.ndarray, sources: np.ndarray, texts: list[str | None]) -> None:
        for lang in np.unique(langs).tolist():
            terms = self.vocabularies.setdefault(lang, _Vocabulary())
            rows = np.flatnonzero(langs == lang)
            found = [np.fromiter(map(terms.__getitem__, words), np.int64, len(words)) for words in ((texts[i] or "").encode().translate(_BYTES).split() for i in rows)]
            sizes = np.array([len(f) for f in found], np.int64)
            ids = np.concatenate(found) if found else np.zeros(0, np.int64)
            # once for each document and term, then for each source and term
            cell, count = np.unique(np.repeat(np.arange(len(rows)), sizes) << 32 | ids, return_counts=True)
            key = sources[rows][cell >> 32].astype(np.int64) << 32 | cell & 0xFFFFFFFF
            self.kept.setdefault(lang, []).append(_summed(key, count, np.ones(len(key), np.int64)))
            self.tokens += len(ids)

    def full(self) -> bool:
        return self.tokens >= TOKENS or sum(map(len, self.vocabularies.values())) >= VOCABULARY

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(lang_no, term, docs, sources, counts), one for each term of a language."""
        for lang, kept in self.kept.items():
            key, count, docs = _summed(*(np.concatenate(x) for x in zip(*kept)))
            term, source = key & 0xFFFFFFFF, key >> 32
            order = np.lexsort((source, term))
            term, source, count, docs = term[order], source[order], count[order], docs[order]
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            words = pa.array(list(self.vocabularies[lang]), pa.binary()).cast(pa.string())
            offsets = np.append(starts, len(term)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(source.astype(np.int32)), pa.array(count))]
            docs = np.add.reduceat(docs, starts) if len(starts) else docs
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), lang, np.int64)), words.take(pa.array(term[starts])), pa.array(docs), *lists], ["lang_no", "term", "docs", "sources", "counts"])


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums by key, in its order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values)


_COUNTED = "lang_no bigint, term string, docs bigint, sources array<int>, counts array<bigint>"


def _counted(texts: DataFrame) -> DataFrame:
    """Partial counts of (lang_no, source_no, text); a task hands on what it has whenever it holds much."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for b in slices(batches):
            counter.add(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist())
            if counter.full():
                yield from counter.rows()
                counter.clear()
        yield from counter.rows()

    return texts.mapInArrow(run, _COUNTED)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbouring rows of one language and term; rows come in that order, and only the last term is held over."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lang, term = t.column("lang_no").to_numpy(), t.column("term").combine_chunks()
        new = np.append(True, (lang[1:] != lang[:-1]) | ~np.asarray(pc.equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False), bool))
        starts = np.flatnonzero(new)
        lists, counts = t.column("sources").combine_chunks(), t.column("counts").combine_chunks()
        row = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy())
        key, count = _summed(row << 32 | lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy())
        offsets = np.searchsorted(key >> 32, np.arange(len(starts) + 1)).astype(np.int32)
        made = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(count))]
        docs = np.add.reduceat(t.column("docs").to_numpy(), starts)
        return pa.RecordBatch.from_arrays([pa.array(lang[starts]), term.take(pa.array(starts)), pa.array(docs), *made], ["lang_no", "term", "docs", "sources", "counts"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        done = flush()
        yield done.slice(0, done.num_rows - 1)
        held[:] = [done.slice(done.num_rows - 1)]
    if held:
        yield held[0]


def trees(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hash-consed segment trees over the rows of counts (sources by terms).

    Gives each source's root; for each level from the roots down the children of its nodes; and the counts
    that the leaves stand for. Places beyond the last term have the leaf -1.
    """
    width = 1 << max(0, counts.shape[1] - 1).bit_length()
    padded = np.full((len(counts), width), -1, np.int64)
    padded[:, : counts.shape[1]] = counts
    leaves, nodes = np.unique(padded, return_inverse=True)
    nodes = nodes.reshape(padded.shape).astype(np.int64)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    while nodes.shape[1] > 1:
        made, inverse = np.unique(nodes[:, 0::2] << 32 | nodes[:, 1::2], return_inverse=True)
        levels.insert(0, (made >> 32, made & 0xFFFFFFFF))
        nodes = inverse.reshape(len(counts), -1).astype(np.int64)
    return nodes[:, 0], levels, leaves


def leaf_pairs(roots: np.ndarray, levels: list, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, leaf of the first, leaf of the second, how often) for pairs of sources: both trees are walked at once.

    Of the pairs of nodes on a level each that occurs is followed once.
    """
    pair, a, b, times = np.arange(len(first)), roots[first], roots[second], np.ones(len(first), np.int64)
    for left, right in levels:
        pair, a, b, times = np.tile(pair, 2), np.concatenate((left[a], right[a])), np.concatenate((left[b], right[b])), np.tile(times, 2)
        order = np.lexsort((b, a, pair))
        pair, a, b, times = pair[order], a[order], b[order], times[order]
        starts = np.flatnonzero(np.append(True, (np.diff(pair) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)))
        pair, a, b, times = pair[starts], a[starts], b[starts], np.add.reduceat(times, starts)
    return pair, a, b, times


def probability(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly: three decimal digits at a time."""
    rest, by = count.astype(np.int64) + 1, np.asarray(total, np.int64) + terms
    out = rest // by
    rest = rest - out * by
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // by, rest % by
    return 1 + out


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compared(block: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """The pairs of sources' values over a block's terms, and each source's first terms of the block.

    block: (term, sources, counts); groups: (source_no, total, terms, lang_total) of all the language's sources.
    """
    groups = groups.sort_by("source_no")
    total = groups.column("total").to_numpy()
    n, terms, lang_total = len(total), groups.column("terms")[0].as_py() or 0, groups.column("lang_total")[0].as_py() or 0
    out_a, out_b, out_value, out_term = [], [], [], []
    step = max(1, CELLS // n)
    for at in range(0, block.num_rows, step):
        part = block.slice(at, step).combine_chunks()
        lists = part.column("sources").combine_chunks()
        column = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
        source, count = lists.flatten().to_numpy(), part.column("counts").combine_chunks().flatten().to_numpy()
        counts = np.zeros((n, part.num_rows), np.int64)
        counts[source, column] = count
        roots, levels, leaves = trees(counts)
        first, second = np.triu_indices(n, 1)
        for some in range(0, len(first), PAIRS):
            x, y = first[some : some + PAIRS], second[some : some + PAIRS]
            pair, a, b, times = leaf_pairs(roots, levels, x, y)
            keep = leaves[a] >= 0
            pair, a, b, times = pair[keep], a[keep], b[keep], times[keep]
            p, q = probability(leaves[a], total[x[pair]], terms), probability(leaves[b], total[y[pair]], terms)
            for one, other, value in ((x, y, price(p, q)), (y, x, price(q, p))):
                out_a.append(one), out_b.append(other)
                sums = np.zeros(len(one), np.int64)
                np.add.at(sums, pair, value * times)
                out_value.append(sums), out_term.append(pa.nulls(len(one), pa.string()))
        term = part.column("term").combine_chunks()
        alphabetical = np.empty(len(term), np.int64)
        alphabetical[pc.sort_indices(term.cast(pa.binary())).to_numpy()] = np.arange(len(term))
        q = probability(counts.sum(axis=0), lang_total, terms)[column]
        p = probability(count, total[source], terms)
        own = np.flatnonzero(p > q)
        value = price(p[own], q[own])
        order = np.lexsort((alphabetical[column[own]], -value, source[own]))
        own, value = own[order], value[order]
        place = np.arange(len(own)) - np.searchsorted(source[own], source[own])
        own, value = own[place < top], value[place < top]
        out_a.append(source[own]), out_b.append(np.full(len(own), -1)), out_value.append(value), out_term.append(term.take(pa.array(column[own])))
    made = [pa.array(np.concatenate(x).astype(np.int64)) for x in (out_a, out_b, out_value)]
    return pa.table([*made, pa.concat_arrays(out_term)], ["source_no", "other", "value", "term"])


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs``.

    A term of a language is kept if at least ``least_docs`` of its documents hold it. Part ``pair`` has a row for each
    other source of the language: the sum over all kept terms of (p - q) ** 2 / q, rounded down for each term,
    with p the group's and q the other's smoothed probability of the term in billionths (0 without kept terms).
    Part ``term`` has the ``top`` kept terms that the group holds and uses more than the language does, by the same
    price against the language's probability. Equal values are ranked by item, in the order of UTF-8.

    Null text, lang and source count as empty. Texts without terms, and very long ones, are read whole like
    others; repeated rows count again. An empty table gives no rows; further columns are left out. A language
    of s sources gives s * (s - 1) pairs. Sums stay exact while a term occurs in fewer than 9e15 places.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), F.col(text_col).alias("text"))
    groups = texts.select("lang", "source").distinct()
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = checkpointed(groups.withColumn("source_no", number).withColumn("lang_no", F.xxhash64("lang")))
    small = groups.count() <= BROADCAST_ROWS
    fit = lambda df: F.broadcast(df) if small else df
    numbered = texts.join(fit(groups), ["lang", "source"]).select("lang_no", "source_no", "text")
    partial = _counted(numbered)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = partial.repartition(n, "lang_no", "term").sortWithinPartitions("lang_no", "term").mapInArrow(_merged, _COUNTED)
    path = shared_folder(docs.sparkSession, "terms")
    merged.filter(F.col("docs") >= least_docs).write.parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    cells = kept.select("lang_no", F.explode(F.map_from_arrays("sources", "counts")).alias("source_no", "count"))
    totals = cells.groupBy("lang_no", "source_no").agg(F.sum("count").alias("total"))
    terms = kept.groupBy("lang_no").agg(F.count("*").alias("terms"))
    by_lang = Window.partitionBy("lang_no")
    groups = groups.join(totals, ["lang_no", "source_no"], "left").fillna(0, ["total"]).join(terms, "lang_no", "left").fillna(0, ["terms"])
    groups = checkpointed(groups.withColumn("lang_total", F.sum("total").over(by_lang)))
    # terms of alike counts become neighbours: that makes equal subtrees
    by = [F.col("lang_no"), F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c).desc(), F.col("sources"), F.col("counts"), F.col("term")]
    dealt = kept.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id())
    path = shared_folder(docs.sparkSession, "blocks")
    dealt.select("lang_no", "m", "term", "sources", "counts").write.parquet(path)
    dealt = docs.sparkSession.read.parquet(path).withColumn("part", F.shiftright("m", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")
    dealt = dealt.join(F.broadcast(offsets), "part").select("lang_no", F.shiftright(place, BLOCK_BITS).alias("block"), "term", "sources", "counts")
    facts = dealt.select("lang_no", "block").distinct().join(fit(groups.select("lang_no", "source_no", "total", "terms", "lang_total")), "lang_no")
    facts = facts.select(F.col("lang_no").alias("of_lang"), F.col("block").alias("of_block"), "source_no", "total", "terms", "lang_total")

    def run(key: tuple, block: pa.Table, facts: pa.Table) -> pa.Table:
        found = _compared(block, facts, top)
        return found.append_column("lang_no", pa.array(np.full(found.num_rows, key[0].as_py(), np.int64)))

    found = dealt.groupBy("lang_no", "block").cogroup(facts.groupBy("of_lang", "of_block")).applyInArrow(run, "source_no bigint, other bigint, value bigint, term string, lang_no bigint")
    path = shared_folder(docs.sparkSession, "compared")
    found.write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    named = groups.select("lang_no", "source_no", "lang", "source")
    others = named.select("lang_no", F.col("source_no").alias("other"), F.col("source").alias("item"))
    sums = found.filter("other >= 0").groupBy("lang_no", "source_no", "other").agg(F.sum("value").alias("value"))
    pairs = named.join(fit(others), "lang_no").filter("source_no <> other").join(sums, ["lang_no", "source_no", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    own = found.filter("other < 0").select("lang_no", "source_no", F.col("term").alias("item"), "value")
    first = own.withColumn("rank", rank("lang_no", "source_no")).filter(F.col("rank") <= top).join(fit(named), ["lang_no", "source_no"])
    first = first.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", rank("lang", "source")).unionByName(first).select("lang", "source", "part", "item", "value", "rank")
