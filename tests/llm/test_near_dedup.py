"""Operator 5 against brute force, and the linking parts it stands on."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import linking
from sessionlake.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    sets = {}
    for key, text, *_ in rows:
        if key is not None:
            w = WORD.findall(lower(text or ""))
            sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((k, len(sets[k]), root(k), root(k) == k) for k in keys)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: rng.choices(words, k=n)
    texts = [make(rng.randint(1, 80)) for _ in range(80)]
    for size, edits in ((200, 2), (70, 6), (30, 3), (12, 1), (5, 4)):  # groups of near copies
        base = make(100)
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(t)
    passage = make(30)
    texts += [make(40) + passage + make(40) for _ in range(70)]  # a passage that many share
    texts += [texts[0]] * 60 + [[]] * 3 + [["The", "end"], ["the", "END"]]
    rng.shuffle(texts)
    return [(i * 3 + 1, " ".join(t), "src") for i, t in enumerate(texts)]


def test_same_as_brute_force(spark):
    rows = corpus(1) + [(100_000, None, None), (100_001, " \t\n", "x"), (None, "a b c", "x"), (100_002, "The end", "x"), (100_003, "long text here " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows)


@pytest.mark.parametrize("levels", [1, 3])
def test_branching_and_blocks(spark, monkeypatch, levels):
    """Tiny limits send the groups through every level and the last exhaustive one."""
    monkeypatch.setattr(linking, "SMALL", 4)
    monkeypatch.setattr(linking, "PIVOTS", 1)
    monkeypatch.setattr(linking, "SALT_ROWS", 30)
    monkeypatch.setattr(linking, "LEVELS", levels)
    rows = corpus(2)
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    assert got == brute(rows)


def test_repeated_key_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("part", [20, 500_000])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(linking, "PART_EDGES", part)
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5), (2000, 2001), (2000, 2001)]
    parent = {}
    for a, b in edges:
        if a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: root(x) for x in parent}


def test_runs_stay_whole():
    key = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 7])], names=["k"]) for i in range(0, 500, 7)]
    tables = [np.asarray(t.column("k").combine_chunks()) for t in linking.runs_of(iter(batches), "k")]
    assert np.array_equal(np.concatenate(tables), key)
    assert all(x[-1] != y[0] for x, y in zip(tables, tables[1:], strict=False))


def test_shared_nodes(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 300), i) for i in range(400)] + [(7, 1000 + i) for i in range(100)]
    got = sorted(tuple(r) for r in linking.shared_nodes(spark.createDataFrame(rows + rows[:150] + rows[-3:], "node long, id long")).collect())
    n = {}
    for k, _ in rows:
        n[k] = n.get(k, 0) + 1
    assert got == sorted(r for r in rows if n[r[0]] > 1)


def test_equal_large_nodes_branch_each(spark, monkeypatch):
    monkeypatch.setattr(linking, "SMALL", 2)
    monkeypatch.setattr(linking, "PIVOTS", 1)
    nodes = spark.createDataFrame([(n, i) for n in (1, 2) for i in range(6)], "node long, id long")
    rows = spark.createDataFrame([(i, np.full(4, i, np.uint32).tobytes()) for i in range(6)], "id long, sig binary")
    read = lambda col: np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, 4)
    sets = lambda few, n: rows.select("id", F.col("sig").alias("data")).join(few, "id", "left_semi")
    seen = []

    def branch(open_rows, level):
        seen.append(sorted((r.node, r.id) for r in open_rows.collect()))
        return open_rows.select("node", "id").limit(0)

    linking.resolve(nodes, linking.Items(rows, sets, read, lambda b: np.frombuffer(b, np.uint32), 3, 75), branch)
    assert seen == [[(n, i) for n in (1, 2) for i in range(6)]]
