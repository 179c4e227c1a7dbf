"""Operator 2 against the recursion itself, and its probabilities' sums."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionlake.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


class Recursion:
    """The model by dictionaries; None is the end, and the context of the first token is "<s>"."""

    def __init__(self, texts):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for t in texts:
            toks = tokens(t)
            uni.update(toks)
            pairs = list(zip(["<s> "] + toks[:-1], toks, strict=True))
            bi.update(pairs)
            ctx.update(c for c, _ in pairs)
        self.uni, self.n = uni, sum(uni.values())
        times = lambda c: Counter(v for v in c.values() if v <= katz.GT + 1)
        d1, d2 = katz.discounts(times(uni)), katz.discounts(times(bi))
        cut = lambda c, d: c * (d[c] if c <= katz.GT else 1.0)
        self.p1 = {w: cut(c, d1) / (self.n + 1) for w, c in uni.items()}
        self.unknown = 1 - sum(self.p1.values())
        mass = Counter()
        for (c, _), n in bi.items():
            mass[c] += cut(n, d2)
        of = {c: n + (mass[c] >= n * (1 - 1e-9)) for c, n in ctx.items()}  # a context without mass gets one count more
        self.p2 = {k: cut(c, d2) / of[k[0]] for k, c in bi.items() if c >= katz.MIN_BIGRAM}
        seen, lower = Counter(), Counter()
        for (c, w), p in self.p2.items():
            seen[c] += p
            lower[c] += self.p1[w]
        self.alpha = {c: (1 - seen[c]) / (1 - lower[c]) for c in seen}

    def p(self, w, c):
        if (c, w) in self.p2:
            return self.p2[c, w]
        return self.alpha.get(c, 1.0) * self.p1.get(w, self.unknown)

    def row(self, key, text):
        toks = tokens(text)
        known = [w for w in toks if w in self.uni]
        base = sum(math.log10((self.uni[w] + 1) / (self.n + len(self.uni) + 1)) for w in toks)
        score = sum(math.log10(self.p(w, c)) for c, w in zip(["<s> "] + toks[:-1], toks, strict=True))
        return key, len(toks), len(known), self.n, base, score


OFTEN = [(2000 + i, "qq zz") for i in range(60)] + [(2100 + i, "ww vv yy uu") for i in range(20)]


def held(key):
    return key is None or zlib.crc32(str(key).encode()) % 7 == 2


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60))) + rng.choice(["", "\n", f" once{i}"])) for i in range(n)]


@pytest.mark.parametrize(("heavy", "gather"), [(1 << 16, 4_000_000), (8, 300)])
def test_same_as_recursion(spark, monkeypatch, heavy, gather):
    monkeypatch.setattr(katz, "HEAVY", heavy)
    monkeypatch.setattr(katz, "GATHER", gather)
    monkeypatch.setattr(katz, "PART_ROWS", 500 if gather == 300 else 4_000_000)
    rows = corpus(1, 200) + [(900, None), (901, ""), (None, "w1 w2 new"), (5, "w1 w1 w1"), (902, "w3 w4 " * 40_000)] + OFTEN + [(3000 + i, "qq vv") for i in range(9)]
    model = Recursion([t for k, t in rows if not held(k)])
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = sorted((tuple(r) for r in katz.score(df).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted((model.row(*r) for r in rows), key=lambda r: (str(r[0]), r[1], r[4]))
    assert [r[0] for r in got] == [r[0] for r in want] and all(g[1] == held(g[0]) for g in got)
    assert [g[2:5] for g in got] == [w[1:4] for w in want]
    assert np.allclose([g[5:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-7)


def test_probabilities_sum_to_one():
    model = Recursion([t for _, t in corpus(2, 150) + OFTEN])
    for c in [*list(model.alpha)[:40], "<s> ", "never", "qq", "ww", "vv"]:
        assert abs(sum(model.p(w, c) for w in model.uni) + model.p("not there", c) - 1) < 1e-9
    assert model.unknown > 0 and model.p("vv", "qq") > 1e-6


def test_better_than_base_on_held_out_text(spark):
    rng = random.Random(3)
    word = [f"w{i}" for i in range(200)]
    follow = {w: rng.choices(word, k=3) for w in word}

    def chain():
        out = [rng.choice(word)]
        for _ in range(rng.randint(5, 40)):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, chain()) for i in range(600)], "doc_id long, text string")
    out = [r for r in katz.score(df).collect() if r.held_out]
    assert out and sum(r.score for r in out) > 0.6 * sum(r.base_score for r in out)


def test_no_training_rows(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = katz.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_packed_columns():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64) * np.uint64(3)
    for x in (a, np.sort(a), a[:0]):
        for rising in (True, False):
            assert np.array_equal(katz.unpack(katz.pack(x, rising), rising), x)


def test_bigrams_seen_once_or_twice_count(spark, monkeypatch):
    rows = corpus(4, 150)
    got = {r.doc_id: r.score for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(katz, "MIN_BIGRAM", 1)  # of the recursion, whatever the operator keeps
    model = Recursion([t for k, t in rows if not held(k)])
    want = {k: model.row(k, t)[-1] for k, t in rows}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-9, atol=1e-7)


def test_bigrams_are_kept_packed_and_once(spark, monkeypatch):
    """What is written for the model: 11 bytes a bigram here, 24 when three tables held rows of all of them."""
    import os
    from urllib.parse import urlparse

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 30_000, 400))) for i in range(300)]
    written = []

    def stored(df, name, keep=katz.stored):
        out = keep(df, name)
        written.extend(os.path.getsize(urlparse(f).path) for f in out.inputFiles())
        return out

    monkeypatch.setattr(katz, "stored", stored)
    katz.Model(spark.createDataFrame([(i, True, t, i) for i, t in rows], "uid long, train boolean, text string, key long"))
    pairs = {p for _, t in rows for p in zip(["<s> ", *t.split()], [*t.split(), None], strict=True)}
    assert sum(written) < 16 * len(pairs)
