"""Operator 6 against brute force, and its index against plain counting."""

import hashlib
import random
import re

import numpy as np
import pytest

from sessionlake.llm import substring_dedup as sd
from sessionlake.llm.fm_index import FMIndex, WaveletMatrix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = {k: WORD.findall(t or "") for k, t in rows if k is not None}
    least = {}
    for k, w in texts.items():
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            least[x] = min(least.get(x, k), k)
    out = []
    for k, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        if k is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < k:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(500)]
    prose = lambda n: rng.choices(words, k=n)
    passages = [prose(rng.randint(window - 5, 3 * window)) for _ in range(5)]
    texts = []
    for _ in range(120):
        t = prose(rng.randint(0, window))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randint(0, 10)])
            t += p[a:] + prose(rng.randint(0, 30))
        texts.append(t)
    texts += [texts[3], texts[3], texts[4] + texts[5], ["the"] * (4 * window), ["the"] * (5 * window) + ["end"], passages[0] * 3]
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "\n", " \t"]).join(t)) for i, t in enumerate(texts)]


def digest(spark, rows):
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_words int")
    return sorted((tuple(r) for r in sd.without_repeats(df, digest=True).collect()), key=str)


@pytest.mark.parametrize("hot", [250_000, 300])
def test_same_as_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_WORDS", hot)
    monkeypatch.setattr(sd, "SHARD_WORDS", 2000)
    rows = corpus(1, sd.WINDOW)
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[0][1] + rows[1][1]), (903, "x y z " * 30_000), (904, "z x y " * 20)]
    assert digest(spark, rows) == brute(rows, sd.WINDOW)


def test_kept_text_repeated_rows_and_empty_table(spark):
    t = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (2, "a " + t + " b"), (3, t + "!")], "doc_id long, text string")
    got = sorted(tuple(r) for r in sd.without_repeats(df).collect())
    assert got == [(1, 60, 0, t), (1, 60, 0, t), (2, 62, 60, "a b"), (3, 60, 59, "v59!")]
    assert sd.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_repeated_id_with_another_text_is_cut_by_its_own_windows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, b), (5, a), (5, b), (5, b), (7, a + " end"), (7, c), (9, c + " " + c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in sd.without_repeats(df).collect())
    assert got == [(1, 100, 0), (5, 100, 0), (5, 100, 100), (5, 100, 100), (7, 100, 0), (7, 101, 100), (9, 200, 200)]


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    for symbols in (1, 2, 5, 300):
        v = rng.integers(0, symbols, 1000)
        m = WaveletMatrix(v, symbols)
        c, e = rng.integers(0, symbols, 400), rng.integers(0, 1001, 400)
        present = np.isin(c, v)
        want = np.array([(v[:j] == x).sum() for x, j in zip(c, e, strict=True)])
        assert np.array_equal(m.rank(c, e)[present], want[present])


@pytest.mark.parametrize("window", [2, 3, 8, 50])
def test_index_finds_least_owner(window):
    rng = np.random.default_rng(window)
    texts = [rng.integers(1, 4, rng.integers(window, 3 * window + 2)) for _ in range(40)]
    owner = rng.permutation(40)
    index = FMIndex(np.concatenate([np.append(t, 0) for t in texts]), np.repeat(owner, [len(t) + 1 for t in texts]), window)
    least = {}
    for o, t in zip(owner, texts, strict=True):
        for i in range(len(t) - window + 1):
            x = tuple(t[i : i + window])
            least[x] = min(least.get(x, 99), o)
    for t, got in zip(texts, index.least_owners(texts), strict=True):
        assert got.tolist() == [least[tuple(t[i : i + window])] for i in range(len(t) - window + 1)]
    with pytest.raises(ValueError):
        index.least_owners([np.full(window, 0), np.array([3] * 200)])
