"""Token counts and pieces against the tokenizer libraries on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidyframe.llm import pieces, token_count

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a ", " a", "a  b", "a\n b \n\nc", "\t x", "x<|endoftext|>y <|endoftext|>", "it's we'll 'S", "aaaaaaaaaaaaaaaa" * 9, "日本語 テスト é é  x   y", "▁a ▁ b", "🙂" * 40 + " 🙂", "12 345²½ Ⅷ", "\x00 \x1c \x85 z", "=" * 300, "word " * 3000, "x" * 5000]


def fuzz(n: int, seed: int) -> list:
    r = random.Random(seed)
    alphabet = "  \n\t'aebtsThé日ß1२.,!<|>▁ 🙂-"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return ODD + fuzz(800, 3) + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_counts_equal_library(texts):
    library = Tokenizer.from_file(BPE)
    got = token_count.Ranks(BPE).count(texts)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [(t, a, b) for t, a, b in zip(texts, got, want) if a != b] == []


def test_pieces_equal_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = pieces.Chunks(PIECES)
    for t, (ids, decoded) in zip(texts, model.texts(texts)):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert decoded == library.decode(want), t


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_count.Ranks(public_tokenizers.path("word_bpe_49k.json"))


def test_tables_do_not_change_results(texts, monkeypatch):
    monkeypatch.setattr(token_count, "CHUNKS", 3)
    monkeypatch.setattr(pieces, "CHUNKS", 3)
    some = ODD + fuzz(60, 4)
    a, b = token_count.Ranks(BPE), pieces.Chunks(PIECES)
    for t in some:
        assert a.count([t, t]) == a.count([t]) * 2
        assert b.texts([t, t])[0] == b.texts([t])[0]


def test_frames(spark):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "a b", "y", 2), (3, "w " * 600, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids int")
    got = sorted(map(tuple, token_count.count_tokens(df, BPE).collect()), key=str)
    assert (1, 0, 0, False) in got and len(got) == 4 and (None, 3, 2, False) in got and any(r[3] for r in got)
    enc = {r.doc_id: r for r in pieces.encode(df, PIECES).collect()}
    assert enc[1].ids == [1, 2] and enc[1].decoded == "" and enc[None].decoded == "a b"
    dig = {r.doc_id: r for r in pieces.encode_digests(df, PIECES).collect()}
    assert dig[None].decoded_sha256 == hashlib.sha256(b"a b").hexdigest() and dig[1].n_tokens == 2
    assert token_count.count_tokens(df.limit(0), BPE).count() == pieces.encode(df.limit(0), PIECES).count() == 0
