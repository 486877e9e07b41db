"""Ranked lexical search: the best documents for each item of a query set, by a dual-tree search.

A block of items and a batch of documents each become a hierarchy whose nodes hold the largest
value of every term among their members. The product of two nodes' maxima is no less than the
score of any of their pairs. A pair of nodes goes when its bound is below the weakest kth score
that the node's items already have, and with it all its pairs; leaves that stay are scored exactly.
Bounds and scores are sums of whole numbers, so that nothing is lost to rounding.

The scores are those of BM25 in whole numbers (k1 1.2, b 0.25).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import checkpointed, shared_folder, slices

#: Terms of the items of a block (repeats by item), which every task holds as vectors.
BLOCK_TERMS = 30_000
#: Documents, and their terms, that a task puts into one tree; members of a leaf of either tree.
TREE_DOCS, TREE_TERMS, DOC_LEAF, ITEM_LEAF = 8192, 2_000_000, 64, 8
#: Leaves of documents scored together before bounds are looked at again.
LEAVES = 4
#: Characters of a term: ASCII letters and digits, and all beyond ASCII. Only A-Z change case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(_BYTES).split()


class Tree:
    """A complete binary tree over sparse rows of whole numbers.

    ``order`` lists the rows leaf by leaf; node i of a level holds the rows between ``cuts[level][i]``
    and the next cut, and ``most[level][i]`` their largest value of each column.
    """

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, leaf: int, kind: type):
        n = len(starts) - 1
        self.depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
        self.cuts = [np.arange(2**d + 1) * n // 2**d for d in range(self.depth + 1)]
        rows = np.repeat(np.arange(n), np.diff(starts))
        order = np.arange(n)
        for d in range(self.depth):
            at = np.empty(n, np.int64)
            at[order] = np.arange(n)
            node = np.searchsorted(self.cuts[d], at, "right") - 1  # of each row
            like = self._likeness(rows, columns, values, node, n, 2**d, width)
            order = order[np.lexsort((like[order], node[order]))]
        self.order, sizes = order, np.diff(starts)[order]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        take = np.arange(sizes.sum()) + np.repeat(starts[:-1][order] - self.starts[:-1], sizes)
        self.columns, self.values = columns[take], values[take].astype(kind)
        leaf_of = np.repeat(np.searchsorted(self.cuts[-1], np.arange(n), "right") - 1, sizes)
        most = np.zeros(2**self.depth * width, kind)
        np.maximum.at(most, leaf_of * width + self.columns, self.values)
        self.most = [most.reshape(-1, width)]
        for _ in range(self.depth):
            self.most.insert(0, self.most[0].reshape(-1, 2, width).max(axis=1))

    @staticmethod
    def _likeness(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, node: np.ndarray, n: int, nodes: int, width: int) -> np.ndarray:
        """How far a row has the terms of the heaviest row of its node."""
        heavy = np.bincount(rows, values, n)
        by_node = np.lexsort((-heavy, node))
        is_pivot = np.zeros(n, bool)
        is_pivot[by_node[np.searchsorted(node[by_node], np.arange(nodes))]] = True
        cell, own = node[rows] * width + columns, is_pivot[rows]
        mark = np.zeros(nodes * width)
        mark[cell[own]] = values[own]
        return np.bincount(rows, np.minimum(mark[cell], values), n) / np.maximum(heavy, 1)

    def is_leaf(self, level: int) -> bool:
        return level == self.depth


class Search:
    """Looks for the best documents of one tree for the items of another; ``weakest`` is each item's kth score so far."""

    def __init__(self, items: Tree, k: int, width: int, kind: type):
        self.items, self.k, self.kind = items, k, kind
        n = len(items.order)
        self.best = np.zeros((n, k), kind)  # in the order of the items' tree
        self.local = np.full(width, -1, np.int64)
        self.columns = [[np.flatnonzero(most) for most in level] for level in items.most]
        self.most = [[most[c] for most, c in zip(level, own)] for level, own in zip(items.most, self.columns)]
        self.leaves = [self._dense(items, np.array([i]), c)[0].T for i, c in enumerate(self.columns[-1])]
        self.scored = 0

    @property
    def weakest(self) -> np.ndarray:
        """A score of zero is none, so that at least one is asked for."""
        return np.maximum(self.best.min(axis=1), 1)

    def _dense(self, tree: Tree, leaves: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of some leaves over some columns, and their places in the tree's order."""
        cuts = tree.cuts[-1]
        rows = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in leaves])
        at = np.concatenate([np.arange(tree.starts[cuts[i]], tree.starts[cuts[i + 1]]) for i in leaves])
        self.local[columns] = np.arange(len(columns))
        local = self.local[tree.columns[at]]
        self.local[columns] = -1
        row = np.repeat(np.arange(len(rows)), tree.starts[rows + 1] - tree.starts[rows])
        dense = np.zeros((len(rows), len(columns)), self.kind)
        dense[row[local >= 0], local[local >= 0]] = tree.values[at][local >= 0]
        return dense, rows

    def run(self, docs: Tree, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) that may be among the k best: places in the trees' orders. least: a rank of each document by its id."""
        self.docs, self.found = docs, []
        self._visit(0, 0, 0, np.zeros(1, np.int64))
        if not self.found:
            return (np.zeros(0, np.int64),) * 3
        item, doc, score = (np.concatenate(x) for x in zip(*self.found))
        keep = score >= self.weakest[item]
        item, doc, score = item[keep], doc[keep], score[keep].astype(np.int64)
        order = np.lexsort((least[docs.order[doc]], -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.searchsorted(item, item)
        keep = np.arange(len(item)) - first < self.k
        return item[keep], doc[keep], score[keep]

    def _visit(self, level: int, node: int, depth: int, nodes: np.ndarray) -> None:
        """Items below one node against documents below some nodes of one level."""
        own = slice(*self.items.cuts[level][node : node + 2])
        bound = self.docs.most[depth][nodes][:, self.columns[level][node]] @ self.most[level][node]
        alive = bound >= self.weakest[own].min(initial=np.iinfo(np.int64).max)
        nodes, bound = nodes[alive], bound[alive]
        if not len(nodes):
            return
        if self.items.is_leaf(level) and self.docs.is_leaf(depth):
            self._score(node, own, nodes, bound)
        elif self.docs.is_leaf(depth) or level < depth and not self.items.is_leaf(level):
            for child in (2 * node, 2 * node + 1):
                self._visit(level + 1, child, depth, nodes)
        else:
            self._visit(level, node, depth + 1, np.concatenate((2 * nodes, 2 * nodes + 1)))

    def _score(self, leaf: int, own: slice, nodes: np.ndarray, bound: np.ndarray) -> None:
        """The leaves of documents from the highest bound on, until the rest cannot matter."""
        order = np.argsort(-bound, kind="stable")
        nodes, bound = nodes[order], bound[order]
        for at in range(0, len(nodes), LEAVES):
            some = nodes[at : at + LEAVES][bound[at : at + LEAVES] >= self.weakest[own].min()]
            if not len(some):
                return
            dense, rows = self._dense(self.docs, some, self.columns[-1][leaf])
            scores = (dense @ self.leaves[leaf]).T
            self.scored += scores.size
            self.best[own] = np.partition(np.hstack((self.best[own], scores)), -self.k, axis=1)[:, -self.k :]
            item, doc = np.nonzero(scores >= self.weakest[own][:, None])
            self.found.append((item + own.start, rows[doc], scores[item, doc]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Record batches gathered to tables of at most TREE_DOCS rows and about TREE_TERMS terms."""
    kept, rows, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, DOC_LEAF):
            b = batch.slice(at, DOC_LEAF)
            more = pc.sum(pc.list_value_length(b.column("columns"))).as_py() or 0
            if rows and (rows + b.num_rows > TREE_DOCS or size + more > TREE_TERMS):
                yield pa.Table.from_batches(kept)
                kept, rows, size = [], 0, 0
            kept.append(b)
            rows, size = rows + b.num_rows, size + more
    if rows:
        yield pa.Table.from_batches(kept)


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, total, n, columns, counts) for every document with a term: n terms, and which of the vocabulary how often.

    One more row a task, with its number of documents as ``total``, tells the sum of n and the documents of each term.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = vocabulary.value
        held, docs_seen, all_terms = np.zeros(len(column), np.int64), 0, 0
        names, kinds = ["doc_id", "total", "n", "columns", "counts"], [None, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]

        def out(ids: pa.Array, total: list, n: list, columns: list, counts: list) -> pa.RecordBatch:
            ends = np.concatenate(([0], np.cumsum([len(c) for c in columns]))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], k.value_type)) for x, k in ((columns, kinds[3]), (counts, kinds[4]))]
            return pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(n, pa.int64()), *lists], names)

        for b in slices(batches):
            keep, ns, columns, counts = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = terms(text)
                if not words:
                    continue
                known, count = np.unique(np.array([c for c in map(column.get, words) if c is not None], np.int32), return_counts=True)
                held[known] += 1
                docs_seen, all_terms = docs_seen + 1, all_terms + len(words)
                keep.append(i), ns.append(len(words)), columns.append(known), counts.append(count)
            yield out(b.column(0).take(pa.array(keep, pa.int64())), [None] * len(keep), ns, columns, counts)
            ids = b.column(0)
        if docs_seen:
            known = np.flatnonzero(held)
            yield out(pa.nulls(1, ids.type), [docs_seen], [all_terms], [known], [held[known]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, total bigint, n bigint, columns array<int>, counts array<bigint>")


def _contributions(n: np.ndarray, counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each term of each document brings, before its weight."""
    lengths, of = np.unique(n, return_inverse=True)
    m = np.array([75 + 25 * x * n_docs // n_terms for x in lengths.tolist()], np.int64)[of]
    return 1_000_000_000 * counts // (1000 * counts + 12 * np.repeat(m, sizes))


def _block(docs: DataFrame, rows: list, item_kind, k: int) -> DataFrame:
    """(item_id, doc_id, score): for each item in ``rows`` (item_id, term, n) the k best documents of each task, or more than the best."""
    spark = docs.sparkSession
    ids = list(dict.fromkeys(r.item_id for r in rows))
    place = {x: i for i, x in enumerate(ids)}
    column = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in rows))}
    path = shared_folder(spark, "terms")
    vocabulary = spark.sparkContext.broadcast({t.encode(): i for t, i in column.items()})
    _counted(docs, vocabulary).write.parquet(path)
    made = spark.read.parquet(path)
    totals = made.filter("total is not null")
    n_docs, n_terms = totals.agg(F.sum("total"), F.sum("n")).first()
    held = totals.select(F.explode(F.map_from_arrays("columns", "counts")).alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n"))
    weight = np.zeros(len(column), np.int64)
    for c, df in held.collect():  # as many as the block has terms
        weight[c] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    owner = np.array([place[r.item_id] for r in rows])
    order = np.argsort(owner, kind="stable")
    columns = np.array([column[r.term] for r in rows])[order]
    values = np.array([r.n for r in rows], np.int64)[order] * weight[columns]
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(ids)))))
    # scores below 2 ** 53 are whole numbers as doubles too
    kind = np.float64 if np.bincount(owner[order], values).max() < 2**53 // 1_000_000 else np.int64
    query = spark.sparkContext.broadcast((starts, columns, values, len(column), pa.array(ids, item_kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, columns, values, width, names = query.value
        search = None
        for t in _batches(batches):
            search = search or Search(Tree(starts, columns, values, width, ITEM_LEAF, kind), k, width, kind)
            lists = t.column("columns").combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy()
            counts = t.column("counts").combine_chunks().flatten().to_numpy()
            value = _contributions(t.column("n").to_numpy(), counts, sizes, n_docs, n_terms)
            tree = Tree(np.concatenate(([0], np.cumsum(sizes))), lists.flatten().to_numpy().astype(np.int64), value, width, DOC_LEAF, kind)
            doc_id = t.column("doc_id").combine_chunks()
            least = np.empty(len(doc_id), np.int64)
            least[pc.sort_indices(doc_id, null_placement="at_end").to_numpy()] = np.arange(len(doc_id))
            item, doc, score = search.run(tree, least)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(search.items.order[item])), doc_id.take(pa.array(tree.order[doc])), pa.array(score)], ["item_id", "doc_id", "score"])

    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    items_kind = "item_id " + rows[0].kind
    return made.filter("total is null").select("doc_id", "n", "columns", "counts").mapInArrow(run, f"{items_kind}, doc_id {doc_kind}, score bigint")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above zero for each item, fewer where there are fewer.

    Equal scores are ranked by ascending id, null last. Null and empty texts have no term: such items
    get no row, such documents are in no count. Rows that repeat an item's id are one item with all their
    terms; rows that repeat a document's id are documents of their own. Very long texts are read
    whole. Empty tables give no rows; further columns are left out. Items are taken in blocks of about
    BLOCK_TERMS terms, each of which is one pass over the documents, and only a block is held by the driver.
    """
    spark = docs.sparkSession
    lowered = F.translate(F.coalesce(F.col(item_text_col), F.lit("")), _UPPER, _LOWER)
    found = items.select(F.col(item_col).alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), 0)).alias("term"))
    found = checkpointed(found.groupBy("item_id", "term").agg(F.count("*").alias("n")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}, score bigint")
    blocks = -(-found.count() // BLOCK_TERMS)
    for b in range(blocks):
        own = found.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).withColumn("kind", F.lit(kind.simpleString())).orderBy("item_id", "term").collect()
        if own:
            out = out.unionByName(_block(texts, own, to_arrow_type(kind), k))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
