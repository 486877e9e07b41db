"""Token counts of a byte-level BPE vocabulary, by rank-synchronous merging of ragged numpy arrays.

All distinct pre-tokens of a batch lie in one flat array of symbols. In each round every
sequence applies its own lowest-rank pair at all places at once; sequences without a pair left
drop out. What survives is counted. Counts of pre-tokens are kept in a bounded table per worker.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import slices

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest chunk that is remembered, in characters, and how many are, per worker.
CHUNK_CHARS, CHUNKS = 64, 400_000
_NONE = np.int64(1) << 60


class Ranks:
    """Merge ranks of a tokenizer file, as sorted arrays to look pairs up in."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} is no plain byte-level vocabulary: its texts would be cut in another way")
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # a printable byte stands for itself, the others for the characters from 256 up
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.of_byte = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.known: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each non-empty byte string has after all merges."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        row = np.repeat(np.arange(len(words)), counts)
        while len(sym) > 1:
            rank = self._rank(sym[:-1], sym[1:])
            rank[row[:-1] != row[1:]] = _NONE
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            least = np.minimum.reduceat(np.append(rank, _NONE), starts)
            size = np.diff(np.append(starts, len(row)))
            on = least < _NONE
            if not on.any():
                break
            hit = (rank == np.repeat(least, size)[:-1]) & (rank < _NONE)
            at = np.flatnonzero(hit)
            # where places touch (a pair of equal symbols), every other one counts, from the left
            fresh = np.concatenate(([True], np.diff(at) > 1))
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.repeat(on, size)
            stay[at + 1] = False
            counts -= np.bincount(row[at], minlength=len(counts))
            sym, row = sym[stay], row[stay]
        return counts

    def learn(self, chunks: set[str]) -> dict[str, int]:
        """Token counts of chunks of text, each pre-tokenised on its own; distinct pre-tokens are merged once."""
        split = {c: _pretokens(c) for c in chunks}
        words = list({w for ws in split.values() for w in ws})
        count = dict(zip(words, self.symbols([w.encode() for w in words]).tolist())) if words else {}
        return {c: sum(map(count.__getitem__, ws)) for c, ws in split.items()}

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; strings of added tokens count as one token each."""
        split = [self._chunks(t or "") for t in texts]
        seen = {c for chunks, _ in split for c in chunks}
        if len(self.known) > CHUNKS:
            self.known.clear()
        new = self.learn(seen - self.known.keys())
        short = {c: n for c, n in new.items() if len(c) <= CHUNK_CHARS}
        self.known.update(short)
        table = self.known if len(short) == len(new) else _Both(new, self.known)
        return [sum(map(table.__getitem__, chunks)) + special for chunks, special in split]

    def _chunks(self, text: str) -> tuple[list[str], int]:
        special = 0
        parts = [text]
        if any(s in text for s in self.special):
            pieces = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
            parts, special = pieces[::2], len(pieces) // 2
        return [c for p in parts if p for c in cut(p)], special


class _Both(dict):
    def __init__(self, new: dict[str, int], known: dict[str, int]):
        super().__init__(new)
        self.more = known

    def __missing__(self, key: str) -> int:
        return self.more[key]


_pretokens = regex.compile(PRETOKEN).findall
_cut = re.compile(r"(?<=\S)(?= \S)").split
_uneven = re.compile(r" \s|\s |^ | $").search


def cut(text: str) -> list[str]:
    """Chunks that pre-tokens never cross: a cut before each single space between other characters."""
    if _uneven(text):
        return _cut(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


@functools.lru_cache(maxsize=2)
def _ranks(path: str) -> Ranks:
    return Ranks(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``, whole texts.

    ``tokenizer_path`` must exist on the executors, as installed vocabularies do. Null counts as
    empty: no bytes, no tokens. Repeated rows stay repeated; an empty table gives no rows;
    further columns are left out. Very long texts are counted whole. Files with a normaliser, other
    pre-tokenisation or added tokens that take in what stands beside them are refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(tokenizer_path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ranks.count(b.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
