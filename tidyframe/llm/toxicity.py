"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words and their stems, word pairs and pairs with one word between,
hashed to ``2 ** BITS`` places, each distinct one once. The regression has a learning rate for each coordinate and L1 sparsity, so
that few weights are left; these are broadcast (never more than 2 ** BITS of them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from .shared import slices, unused

BITS = 20
#: Labelled rows that the model is fitted on, at most: those with the least hashed ids.
SAMPLE_ROWS = 8000
ALPHA, BETA, L1, L2, EPOCHS, TOXIC_WEIGHT, THRESHOLD = 3.0, 1.0, 12.0, 0.03, 4, 5.0, 0.7
#: Lengths of the stems that stand beside a word; words remembered by a worker.
STEMS = (4, 5, 6)
_WORDS = 300_000
_odd = re.compile(r"[\W_]+")


class Words(dict):
    """Row of each word in ``hashes``: of its letters and digits, lower-cased, and of its stems (first characters)."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((1024, 1 + len(STEMS)), np.uint64)
        self.used = 0

    def __missing__(self, word: str) -> int:
        plain = _odd.sub("", word.lower())
        if self.used == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        forms = [plain, *[f"{plain[:n]}~" if len(plain) > n else "" for n in STEMS]]
        self.hashes[self.used] = [xxhash.xxh64_intdigest(f.encode()) if f else 0 for f in forms]
        self[word] = self.used
        self.used += 1
        return self.used - 1


def places(text: str | None, words: Words) -> np.ndarray:
    """Places of the text's features, repeats included; place 2 ** BITS is the intercept's."""
    if len(words) > _WORDS:
        words.clear()
        words.used = 0
    split = (text or "").split()
    rows = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
    h = words.hashes[rows]
    w = h[:, 0][h[:, 0] != 0]
    pair = lambda a, b, odd: (a * np.uint64(odd) + b) * np.uint64(0x9E3779B97F4A7C15)
    every = np.concatenate([h[h != 0], pair(w[:-1], w[1:], 0xC2B2AE3D27D4EB4F), pair(w[:-2], w[2:], 0x165667B19E3779F9)])
    return np.append((every >> np.uint64(64 - BITS)).astype(np.int32), np.int32(1 << BITS))


def probability(dense: np.ndarray, text: str | None, words: Words) -> float:
    """The score of a text: each of its distinct features counts once."""
    at = places(text, words)
    return _sigmoid(dense[np.unique(at[dense[at] != 0])].sum())


def fit(examples: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights after EPOCHS passes over (features, label), in the order given."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for at, label in examples:
            w = weights(at)
            g = (_sigmoid(w.sum()) - label) * (TOXIC_WEIGHT if label else 1.0)
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None))


def _sigmoid(x: float) -> float:
    return 1 / (1 + float(np.exp(-np.clip(x, -500, 500))))


def examples(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, label, text): at most ``sample_rows`` labelled ids, each once, by its least text; null counts as empty.

    ``learn`` is a condition on the id. Rows without an id or label are left out; an id with both labels is toxic.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(learn) if learn is not None else known
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, **options) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not zero, from the ``examples``.

    Without any there are no weights. One task fits the bounded sample; the rest of the work is spread.
    """
    rows = examples(docs, labels, learn, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), []
        for b in slices(batches):
            known += [(np.unique(places(t, words)), y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if known:
            w = fit(known)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([w[at].tobytes()])], ["at", "w"])

    model = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label").mapInArrow(run, "at binary, w binary").first()
    return (np.frombuffer(model["at"], "<i4"), np.frombuffer(model["w"])) if model else (np.zeros(0, np.int32), np.zeros(0))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with a last column of the scores of whole texts, by an unused name; null and empty ones have the intercept's."""
    (into,) = unused(docs.columns, "_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, dense = Words(), np.zeros((1 << BITS) + 1)
        at, w = shared.value
        dense[at] = w
        for b in slices(batches):
            found = [probability(dense, t, words) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield b.append_column(into, pa.array(found, pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(into, DoubleType()))


def judge(docs: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``; predicted is 1 from ``threshold`` on.

    Null and empty texts have the intercept's score, without labels 0.5. Very long texts are read whole. Repeated
    rows stay repeated; an empty table gives no rows; further columns are left out.
    """
    model = train(docs, labels, learn, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(rows, model).select("doc_id", F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or above; all columns stay.

    Null and empty texts have the intercept's score; very long texts are read whole; repeated rows share their
    fate; an empty table gives no rows; no column's name can clash.
    """
    model = train(docs, labels, learn, id_col=id_col, text_col=text_col, **options)
    scored = score(docs, model, text_col=text_col)
    return scored.filter(F.col(scored.columns[-1]) < threshold).drop(scored.columns[-1])
