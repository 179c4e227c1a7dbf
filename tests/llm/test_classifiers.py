"""Operators 4 and 7: held-out accuracy, exact neighbours, and the edges of their input."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sessionlake.llm import toxic_neighbours as tox
from sessionlake.llm.lang_centroids import identify

VOCAB = {"en": "the of and house water there with this from".split(), "de": "der und das nicht wasser schön für über auch".split(), "ru": "дом вода это как для что меня".split()}


def held(key, modulus, rest):
    return zlib.crc32(str(key).encode()) % modulus == rest


def docs(n, seed):
    rng = random.Random(seed)
    langs = sorted(VOCAB)
    return [(i, " ".join(rng.choices(VOCAB[langs[i % 3]], k=rng.randint(5, 60))), langs[i % 3]) for i in range(n)]


EDGES = [(900, None, "en"), (901, "", "en"), (902, "12 !! 3", "de"), (903, "the house and water", None), (None, "der und das", "de"), (904, "the of " * 100000, None), (904, "the of " * 100000, None)]


def test_languages(spark):
    rows = docs(600, 1) + EDGES
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {r[0]: r[2] for r in rows[:600]}
    out = [k for k in truth if by[k].held_out]
    assert all(by[k].held_out == held(k, 4, 2) for k in truth) and len(out) > 100
    assert np.mean([by[k].lang_pred == truth[k] for k in out]) > 0.99
    assert {by[k].lang_pred for k in (900, 901, 902)} == {"und"} and by[903].lang_pred == "en" and by[904].lang_pred == "en"
    assert by[None].lang_pred == "de" and by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)


def test_language_rejects_strangers(spark):
    df = spark.createDataFrame([*docs(600, 2), (2000, "xyzzy qqq zzz xxyx qxq zqz", None)], "doc_id long, text string, lang string")
    by = {r.doc_id: r for r in identify(df).collect()}
    assert by[2000].rejected and sum(by[k].rejected for k in range(600)) < 30


@pytest.mark.parametrize("rows", [[], [(1, "x y", None)]])
def test_language_nothing_to_learn(spark, rows):
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [r.lang_pred for r in got] == ["und"] * len(rows)


def toxic_rows(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(10, 50))] + bad * rng.choices(["zorg!", "Blast.", "flumox"], k=rng.randint(1, 4))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows(1500, 3)
    edges = [(5000, None), (5001, ""), (None, "zorg blast"), (5002, "w1 " * 200000 + "zorg flumox zorg"), (5002, "w1 " * 200000 + "zorg flumox zorg")]
    known = [*labels, (0, None), (None, 1), (labels[0][0], labels[0][1])]
    d = spark.createDataFrame([(*r, "toxic") for r in rows + edges], "doc_id long, text string, source string")
    y = spark.createDataFrame([(*r, 1) for r in known], "doc_id long, toxic int, quality int")
    got = tox.score(d, y).collect()
    assert len(got) == len(rows) + len(edges)
    by = {r.doc_id: r for r in got}
    truth = dict(labels)
    out = [k for k in truth if by[k].held_out]
    assert all(by[k].held_out == held(k, 3, 1) for k in truth)
    assert np.mean([by[k].predicted == truth[k] for k in out]) > 0.98
    assert by[5000].score == by[5001].score < 0.1 and by[5002].predicted == 1 and by[5002].evidence
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tox.score(d, empty).collect()] == [0.0]
    assert tox.score(d.limit(0), empty).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    n, m = 700, 30
    dense = np.where(rng.random((n, m)) < 0.15, rng.integers(1, 4, (n, m)), 0).astype(float)
    dense = dense[dense.any(axis=1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    index = tox.Index(np.arange(m, dtype=np.uint64), np.ones(m), n, 0.1)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense]
    index.build(list(range(len(rows))), [0] * len(rows), rows)
    for i in range(0, len(rows), 7):
        sims = dense @ dense[i]
        want = [j for j in np.lexsort((np.arange(len(sims)), -np.round(sims, 12))) if sims[j] > 0][: tox.NEIGHBOURS]
        docs_, got = index.nearest(*rows[i])
        assert docs_.tolist() == want and np.allclose(got, sims[want])


@pytest.mark.parametrize(("frequent", "matrix_rows", "dense"), [(0.05, 1 << 9, 0.0), (0.2, 8, 1.0), (1.0, 8, 0.5)])
def test_clusters_change_nothing(monkeypatch, frequent, matrix_rows, dense):
    """The examples in clusters, in parts, with levels: the same neighbours as brute force, for many texts at once."""
    monkeypatch.setattr(tox, "FREQUENT", frequent)
    monkeypatch.setattr(tox, "MATRIX_ROWS", matrix_rows)
    monkeypatch.setattr(tox, "DENSE", dense)
    monkeypatch.setattr(tox, "SHORT", 6)
    rng = np.random.default_rng(6)
    n, m = 600, 240
    tongue = rng.integers(0, 3, n)  # terms of three languages, some in all
    tf = np.where(rng.random((n, m)) < np.where((np.arange(m) % 4 == tongue[:, None]) | (np.arange(m) % 4 == 3), 0.25, 0.01), rng.integers(1, 5, (n, m)), 0)
    tf[:5] = tf[5:10]  # equal cosines
    tf = tf[tf.any(axis=1)]
    n = len(tf)
    index = tox.Index(np.arange(m, dtype=np.uint64), (tf > 0).sum(axis=0).astype(float), n, 0.1)
    weights = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * index.idf
    lengths = np.linalg.norm(weights, axis=1)
    dense_rows = weights / lengths[:, None]
    order = np.arange(n)

    def parts(start, end):
        for a in range(start, end, 70):
            rows = [tf[i] for i in order[a : min(a + 70, end)]]
            term = [np.flatnonzero(r) for r in rows]
            count = np.concatenate([r[t] for r, t in zip(rows, term, strict=True)])
            more = np.flatnonzero(count > 1)
            yield np.array([len(t) for t in term]), np.concatenate(term), more, count[more] - 2

    cluster = index.alike((tf > 0).sum(axis=0).astype(float), n, parts)
    assert len(cluster) == n and len(set(cluster.tolist())) > 1
    order = np.argsort(cluster, kind="stable")
    bounds = np.unique(np.append(0, np.cumsum(np.bincount(cluster))))
    index.fill(order, np.zeros(n), lengths[order], 1 + np.log(np.arange(2, 5)), bounds, parts)
    texts = [(np.flatnonzero(r), r[np.flatnonzero(r)], i if i % 2 else None) for i, r in enumerate(dense_rows)]
    for (i, sims), (found, got) in zip(enumerate(dense_rows @ dense_rows.T), index.nearest_of(texts), strict=True):
        want = [j for j in np.lexsort((np.arange(n), -np.round(sims, 12))) if sims[j] > 0 and not (i % 2 and j == i)][: tox.NEIGHBOURS]
        assert index.key[found].tolist() == want and np.allclose(got, sims[want])


def test_index_is_made_within_little_memory():
    """The lists are filled part by part: nothing as long as all the examples' terms is held beside them."""
    rng = np.random.default_rng(7)
    n, m, size = 6000, 50_000, 300
    rows = [np.sort(rng.choice(m, size, replace=False)).astype(np.int32) for _ in range(50)]
    none = np.zeros(0, np.int64)

    def parts(start, end):
        for a in range(start, end, tox.TAKEN):
            some = [rows[i % 50] for i in range(a, min(a + tox.TAKEN, end))]
            yield np.full(len(some), size), np.concatenate(some), none, none

    index = tox.Index(np.arange(m, dtype=np.uint64), np.full(m, 9.0), n, 0.1)
    tracemalloc.start()
    index.fill(np.arange(n), np.zeros(n), np.ones(n), np.zeros(0), np.array([0, n]), parts)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(index.entry) + len(index.own_term) == n * size
    assert most < held + 8 * n * size, (held, most)


def test_lists_hold_repeated_terms_apart():
    """Most of a list has the level 1, so it is read without levels; before, each entry held its level."""
    rng = np.random.default_rng(4)
    n, m = 300, 2000
    tf = np.where(rng.random((n, m)) < 0.02, rng.integers(1, 4, (n, m)), 0)
    tf[:, 0] = 2  # in the matrix
    vocab = np.sort(rng.integers(0, 1 << 63, m)).astype(np.uint64) * np.uint64(2)
    index = tox.Index(vocab, np.full(m, 5.0), n, 0.1)
    assert (index.place(vocab) == np.arange(m)).all() and not np.isin(vocab[index.place(vocab + np.uint64(1))], vocab + np.uint64(1)).any()

    def parts(start, end):
        term = [np.flatnonzero(r) for r in tf[start:end]]
        count = np.concatenate([r[r > 0] for r in tf[start:end]])
        yield np.array([len(t) for t in term]), np.concatenate(term), np.flatnonzero(count > 1), count[count > 1] - 2

    index.fill(np.arange(n), np.zeros(n), np.ones(n), 1 + np.log(np.arange(2, 4)), np.array([0, n]), parts)
    assert len(index.entry) == (tf[:, 1:] == 1).sum() and len(index.more_entry) == (tf[:, 1:] > 1).sum()
    some, times = np.arange(0, m, 3), rng.random(len(range(0, m, 3)))
    level = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0)
    level[:, 0] = 0
    assert np.allclose(index.read(some, times), level[:, some] @ times)


def test_terms_see_beginnings():
    (_, _, h, d), = tox.terms(pa.array(["Loweix", None, "loweiyy"]))
    assert len(set(h[d == 0]) & set(h[d == 2])) == 2


def brute_terms(text):
    found = Counter()
    for word in re.findall(r"[0-9a-z\x80-\xff]+", (text or "").lower().encode().decode("latin1")):
        found[word] += 1
        for n in tox.BEGINNINGS:
            if len(word) > n:
                found[word[:n], n] += 1
    return found


def brute_toxicity(rows, labels):
    """Scores and evidence by dictionaries: cosines with every example, best pooled shares by all ranges."""
    y = {k: v for k, v in labels if not held(k, 3, 1)}
    examples = sorted((k, brute_terms(t)) for k, t in rows if k in y)
    n, base = len(examples), sum(y[k] for k, _ in examples) / len(examples)
    df, pos = Counter(), Counter()
    for k, terms in examples:
        df.update(terms.keys())
        pos.update(dict.fromkeys(terms, y[k]))

    def weight(term):
        p, z2 = pos[term] / df[term], tox.Z**2
        low = (p + z2 / (2 * df[term]) - tox.Z * math.sqrt(p * (1 - p) / df[term] + z2 / (4 * df[term] ** 2))) / (1 + z2 / df[term])
        return math.log((1 + n) / (0.5 + df[term])) * (1 + tox.LIFT * max(0, low - base))

    def vector(terms):
        v = {t: (1 + math.log(c)) * weight(t) for t, c in terms.items() if df[t]}
        length = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / length for t, w in v.items()}

    vectors = {k: vector(terms) for k, terms in examples}

    def nearest(v, but=None):
        sims = ((sum(w * e.get(t, 0) for t, w in v.items()), k) for k, e in vectors.items() if k != but)
        return sorted(((-round(s, 12), k) for s, k in sims if s > 0))[: tox.NEIGHBOURS]

    def raw(found):
        votes = [(min(-s, tox.NEAR_ENOUGH) ** tox.NEAR_POWER, y[k]) for s, k in found]
        return (sum(v * b for v, b in votes) + tox.PRIOR * base) / (sum(v for v, _ in votes) + tox.PRIOR)

    others = sorted((raw(nearest(v, k)), y[k]) for k, v in vectors.items() if v)
    sums = np.cumsum([0] + [b for _, b in others])
    share = lambda a, b: (sums[b] - sums[a]) / (b - a)
    fitted = [round(max(min(share(a, b) for b in range(i + 1, len(others) + 1)) for a in range(i + 1)), 9) for i in range(len(others))]
    xs, ys = [], []
    for value in sorted(set(fitted)):
        at = [i for i, f in enumerate(fitted) if f == value]
        xs += [others[at[0]][0], others[at[-1]][0]]
        ys += [(sums[at[-1] + 1] - sums[at[0]] + 0.1 * base) / (len(at) + 0.1)] * 2
    bare = [y[k] for k, v in vectors.items() if not v]
    out = []
    for k, text in rows:
        found = nearest(vector(brute_terms(text)))
        empty = (sum(bare) + 0.5 * np.interp(0, xs, ys)) / (len(bare) + 0.5)
        out.append((k, float(np.interp(raw(found), xs, ys)) if found else empty, [key for _, key in found]))
    return out


@pytest.mark.parametrize("frequent", [0.0, 0.1, 1.0])
def test_toxicity_same_as_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(tox, "FREQUENT", frequent)
    rows, labels = toxic_rows(220, 8)
    rows += [(1000, "Éblast zorg été " * 3), (1001, ""), (1002, "qqq"), (1003, None), (1004, ""), (1005, rows[3][1]), (1006, rows[3][1])]
    labels += [(1001, 0), (1004, 0), (1005, 1), (1006, 0)]
    df = spark.createDataFrame([(t, k, 0.5, "x") for k, t in rows], "text string, doc_id long, score double, key string")
    got = tox.score(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = {k: (s, e) for k, s, e in brute_toxicity(rows, labels)}
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "evidence"]
    found = {r.doc_id: r for r in got.collect()}
    assert found.keys() == want.keys()
    for k, (s, e) in want.items():
        assert found[k].score == pytest.approx(s, abs=1e-6) and found[k].evidence == e, k


def test_every_text_with_a_known_word_has_neighbours(spark):
    rows, labels = toxic_rows(150, 4)
    got = tox.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(r.evidence for r in got.collect())
