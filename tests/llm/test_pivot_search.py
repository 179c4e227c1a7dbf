"""Operator 3 against brute force and its SQL."""

import math
import os
import sys

import duckdb
import numpy as np
import pytest
from conftest import SF_CHECK

from sessionlake.llm import pivot_search as ps
from sessionlake.llm.queries import OP3_SQL, op3_pivot_search

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from check_oracle import table_digest  # noqa: E402


def test_same_as_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{SF_CHECK}/embeddings.parquet')")
    got, want = table_digest(op3_pivot_search(spark, SF_CHECK).toPandas()), table_digest(duckdb.sql(OP3_SQL).df())
    assert got[:3] == want[:3] and got[1] > 0


def brute(rows, k, every):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, x in ok:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in ok if i != q)[:k]
            out |= {(q, r, i, -t) for r, (t, i) in enumerate(s, 1)}
    return sorted(out)


@pytest.mark.parametrize("block", [16, 1024])
def test_same_as_brute_force(spark, monkeypatch, block):
    for name, value in (("BLOCK", block), ("STEP", 4), ("PIVOTS", 6), ("QUERIES", 5), ("FIRST", 1)):
        monkeypatch.setattr(ps, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 6))
    vectors = [list(map(float, centres[rng.integers(5)] + rng.normal(scale=0.2, size=6))) for _ in range(300)]
    vectors += [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0]] * 40 + [[0.0] * 6, [0.5, -0.5]]  # ties, a null vector, a short one
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1010, [], 1), (1020, [None] + [1.0] * 5, 1), (1030, [float("nan")] * 6, 1), (1040, [float("inf")] * 6, 1), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in ps.top_k(df, F.col("vec_id") % 10 == 0, k=7).collect())
    assert got == brute(rows, 7, 10)


def test_few_and_no_vectors(spark):
    from pyspark.sql import functions as F

    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = F.col("vec_id") % 100 == 0
    assert ps.top_k(make([]), q).count() == 0
    assert ps.top_k(make([(100, [1.0])]), q).count() == 0
    assert [tuple(r) for r in ps.top_k(make([(100, [1.0]), (7, [2.0])]), q).collect()] == [(100, 1, 7, 1024 * 2048)]
    assert ps.top_k(make([(1, [1.0]), (7, [2.0])]), q).count() == 0
