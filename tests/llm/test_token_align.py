"""Operator 13 against union-find over byte ranges and counting by dictionary."""

import functools
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import token_align
from sessionlake.llm.queries import tokenizer_path
from sessionlake.llm.token_align import align, align_documents, alignment_digests, components, groups_text, pack, tokenizers, unpack

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path()
TEXTS = [
    "hello world", "  two  spaces ", "über naïve 中文字 🎉🎉", "<|endoftext|> <s> </s> <unk> <0x0A>", "\n\n\ttabs\r\n", "▁ is a space", "x", " ",
    "a" * 300, "don't we'll I'd", "1234567890 3.14159", "nul\x00byte", "​ zero", "hello world", "the the the the the", "ﬁ ligature ½ Å",
]


@functools.cache
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, a, b):
    """(id, start, end) of each token of both, or nothing."""
    if not text:
        return [], []
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    e = a.encode(" " + text, add_special_tokens=False)
    sides = [(i, bytes(byte[c] for c in s)) for i, s in zip(e.ids, e.tokens, strict=True)]
    pieces = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    out = []
    for side in (sides, pieces):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, rows = 0, []
        for i, x in side:
            rows.append((i, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return out


def brute(rows):
    a, b = encoders()
    docs, held = [], Counter()
    for key, text in rows:
        left, right = tokens(text, a, b)
        links = [(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]]
        held.update(set(links))
        ends = sorted({x[2] for x in left} & {y[2] for y in right})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= end) for side in (left, right)))
            low = end
        docs.append((key, left, right, groups, links))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return sorted(
        ((k, len(x), len(y), len(g), len(z), sum(held[p] == top[p[0]] for p in z), sum(held[p] for p in z), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for k, x, y, g, z in docs),
        key=str,
    )


def rows_of():
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (50, None), (51, ""), (3, "hello world"), (60, "word " * 3000 + "zé" * 2000)]
    rng = np.random.default_rng(5)
    words = ["the", "of", "Zürich", "transformer", "tokenization", "ing", "été", "alpha-beta", "中文"]
    return rows + [(100 + i, " ".join(rng.choice(words, 30))) for i in range(40)]


@pytest.mark.parametrize("heavy", [1 << 20, 40, 0])
def test_same_as_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(token_align, "HEAVY", heavy)
    monkeypatch.setattr(token_align, "RUN_BYTES", 400)
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, row int, links string").repartition(4)
    got = sorted(map(tuple, alignment_digests(df, A, B).collect()), key=str)
    assert got == brute(rows)
    plain = {(r.doc_id, r.n_links): r.groups for r in align_documents(df, A, B).collect()}
    assert plain[None, 2] is not None and plain[51, 0] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment_digests(df, A, B).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_alignment_of_any_text(texts):
    a, b = encoders()
    good, x = align(tokenizers(A, B), texts)
    out, at = groups_text(tokenizers(A, B), x)
    found = iter(zip(at[:-1], at[1:], strict=True))
    for text, ok in zip(texts, good, strict=True):
        left, right = tokens(text, a, b)
        assert ok == bool(left)
        if ok:
            i, j = next(found)
            assert out[i:j].tobytes().decode().count("|") == len({t[2] for t in left} & {t[2] for t in right})


@settings(deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1), st.lists(st.integers(1, 40), min_size=1))
def test_chains_are_halved_to_their_terminal(left, right):
    a, b = np.unique([*left, 41]), np.unique([*right, 41])
    groups = components(a, b)
    both = sorted(set(a.tolist()) & set(b.tolist()))
    for ends, group in zip((a, b), groups, strict=True):
        assert group.tolist() == np.searchsorted(both, ends).tolist()


@settings(deadline=None)
@given(st.lists(st.integers(0, 50_257 * 32_000)))
def test_packed_links(pairs):
    data, n = pack(np.array(pairs, np.int64))
    values, times = unpack(data, n)
    assert dict(zip(values.tolist(), times.tolist(), strict=True)) == dict(Counter(pairs))
