"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of the model has the white-space marker after another character, merges never
cross the start of a run of markers. So a text is cut there, each distinct chunk is segmented
once, and ids and decoded text are joined back by position. Models whose pieces do cross the
marker are refused.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .shared import slices

#: Fixed value: the character that stands for a space in pieces.
MARK = "▁"
#: Longest chunk that is remembered, in characters, and how many are, per worker.
CHUNK_CHARS, CHUNKS = 64, 300_000
_cut = re.compile(r"(?<=[^ ])(?= )").split


class Chunks:
    """Segments texts by chunks that begin with a run of spaces."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path} has pieces across white-space markers")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        self.known: dict[str, tuple[bytes, str]] = {}

    def _segment(self, chunks: list[str]) -> Iterator[tuple[bytes, str]]:
        # the library puts a marker of its own in front, which stands for the chunk's first space
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        ids = [x if c != " " else [self.model.piece_to_id(MARK)] for c, x in zip(chunks, ids)]
        for x, text in zip(ids, self.model.decode(ids)):
            yield np.array(x, "<u4").tobytes(), " " + text

    def texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Of each text the ids, begin and end included, as little-endian 32-bit integers, and these decoded."""
        split = [_chunks(t or "") for t in texts]
        if len(self.known) > CHUNKS:
            self.known.clear()
        new = list({c for chunks in split for c in chunks} - self.known.keys())
        table = dict(zip(new, self._segment(new))) if new else {}
        self.known.update((c, x) for c, x in table.items() if len(c) <= CHUNK_CHARS)
        out = []
        for chunks in split:
            found = [self.known.get(c) or table[c] for c in chunks]
            out.append((self.begin + b"".join([x for x, _ in found]) + self.end, "".join([x for _, x in found])[1:]))
        return out


def _chunks(text: str) -> list[str]:
    """The text with one more space in front, cut before each run of spaces."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    words = text.split(" ")
    return _cut(" " + text) if "" in words else [" " + w for w in words]


@functools.lru_cache(maxsize=2)
def _model(path: str) -> Chunks:
    return Chunks(path)


def _mapped(docs: DataFrame, path: str, columns: str, make: Callable[[bytes, str], tuple], id_col: str, text_col: str) -> DataFrame:
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for b in slices(batches):
            made = [make(*x) for x in model.texts(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*made))], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {columns}")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<bigint>, decoded) for every row: ids with begin and end, and decode(ids).

    Null counts as empty, whose ids are begin and end. Repeated rows stay repeated; an empty
    table gives no rows; further columns are left out.
    """
    return _mapped(docs, model_path, "ids array<bigint>, decoded string", lambda ids, text: (np.frombuffer(ids, "<u4").astype(np.int64), text), id_col, text_col)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode`` gives, as digests."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, model_path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids) // 4, sha(ids), sha(text.encode())), id_col, text_col)
