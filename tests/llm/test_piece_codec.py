"""Operator 8 against the library itself."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm.piece_codec import PieceModel, encode_digests, encode_documents

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = PieceModel(PATH)
PARTS = ["a", "b", "e", "t", "the", "ing", " ", "  ", "    ", "\n", "\t", "é", "中", "𝄞", "\x00", "▁", ".", "=", "tion", "http://", "　"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_same_as_library(text):
    ids = LIB.encode(text)
    assert OWN.encode(text) == (",".join(map(str, ids)), LIB.decode(ids))


def test_memo_starting_anew(monkeypatch):
    monkeypatch.setattr("sessionlake.llm.piece_codec.MEMO_BYTES", 900)
    m = PieceModel(PATH)
    text = "one two three four five\nsix seven one two  nine\n ten"
    ids = LIB.encode(text)
    assert m.encode(text) == (",".join(map(str, ids)), LIB.decode(ids))


ROWS = [(1, "the end.", 7), (2, None, 7), (3, "", 8), (3, "the end.", 9), (None, "x\n\ny " * 20000, None)]


def test_digests(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens long")
    got = encode_digests(df, PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for key, text, _ in ROWS:
        ids = LIB.encode(text or "")
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_documents_keep_columns(spark):
    df = spark.createDataFrame([(1, "a b", [5])], "doc_id long, text string, ids array<int>")
    row = encode_documents(df, PATH).first()
    assert (row.ids, row.decoded) == (LIB.encode("a b"), "a b")


@pytest.mark.parametrize("op", [encode_digests, encode_documents])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_known_word_is_not_decoded_from_its_ids(monkeypatch):
    m = PieceModel(PATH)
    monkeypatch.setattr(m, "decode_ids", lambda ids: 1 / 0)  # its pieces are its text
    assert m.encode("plain words and lines")[1] == "plain words and lines"
    monkeypatch.undo()
    assert m.encode("a\x07b \u4e00\U0001f9ff c")[1] == "a\x07b \u4e00\U0001f9ff c"
