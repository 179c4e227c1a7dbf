"""Operator 3: exact top-k search by inner product over a pivot-distance index.

Inner products become distances by one more component, sqrt(M - |x|^2) with M the largest squared
length: |q' - x'|^2 = |q|^2 + M - 2 q.x. Each vector is keyed by its nearest pivot and its
distance to it; the keys are sorted and cut into blocks, each an annulus around a pivot. A query
first looks into the blocks next to its own distances and so gets a radius that holds k vectors.
By the triangle inequality no vector nearer than that can lie in an annulus that is further
than the radius from the query's own distance to the pivot: only the other blocks are opened, and
inside them the search expands from the query's distance outwards and stops at the radius.

Pivots come from k-means over a bounded sample (`SAMPLE` vectors); every vector is indexed.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part.
Shorter vectors count as filled up with zeros. Equal scores go to the smaller id. With fewer than k
others, all are returned. Rows with a null id are left out; a query never returns rows of its own
id, and a query id that repeats is asked once. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.linking import small_side, stored

SCALE = 1024
PIVOTS, SAMPLE, ROUNDS = 64, 4096, 8
BLOCK, STEP, QUERIES = 1024, 128, 512
#: Blocks that a query opens first.
FIRST = 3
#: Distances are doubles; bounds are widened by this share.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): components floor(SCALE * x) as array<bigint>, of the vectors that take part."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ints = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return rows.filter(F.col(key).isNotNull() & (F.size(vector) > 0) & ~wrong).select(F.col(key).cast("bigint").alias("vec_id"), ints.alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles, filled up with zeros."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    n = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(n), dim))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def augmented(v: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(0.0, most - (v * v).sum(axis=1, keepdims=True)))])


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to all pivots."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(vectors: DataFrame, n: int, dim: int, most: float) -> np.ndarray:
    share = int(min(1.0, SAMPLE / n) * (1 << 20))
    few = vectors.filter(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20)) < max(1, share)).orderBy("vec_id").limit(2 * SAMPLE).toArrow()  # a bounded sample
    x = augmented(matrix(few.column("v").combine_chunks(), dim), most) if few.num_rows else np.zeros((1, dim + 1))
    rng = np.random.default_rng(3)
    pivots = x[np.sort(rng.permutation(len(x))[:PIVOTS])]
    for _ in range(ROUNDS):
        own = to_pivots(x, pivots).argmin(axis=1)
        pivots = np.stack([x[own == j].mean(axis=0) if (own == j).any() else pivots[j] for j in range(len(pivots))])
    return pivots


def build_index(vectors: DataFrame, n: int, dim: int, pivots: np.ndarray, most: float) -> DataFrame:
    """Blocks (block, pivot, low, high, ids, dist, v) of the vectors in order of pivot and distance."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = to_pivots(augmented(matrix(batch.column(1), dim), most), pivots)
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], names=["vec_id", "v", "pivot", "dist"])

    keyed = stored(vectors.mapInArrow(key, "vec_id bigint, v array<bigint>, pivot int, dist double"), "vector-keys")
    parts = max(1, math.ceil(n / (8 * BLOCK)))
    ordered = keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            pivot, dist, ids = (table.column(c).to_numpy() for c in ("pivot", "dist", "vec_id"))
            i = 0
            while i < len(pivot):
                j = min(int(np.searchsorted(pivot, pivot[i], side="right")), i + BLOCK)
                if j == len(pivot) and not last and j - i < BLOCK:
                    break
                v = matrix(table.column("v").slice(i, j - i).combine_chunks(), dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[i])]), pa.array([int(pivot[i])], pa.int32()), pa.array([dist[i]]), pa.array([dist[j - 1]]), pa.array([ids[i:j].tobytes()]), pa.array([dist[i:j].tobytes()]), pa.array([v.tobytes()])],
                    names=["block", "pivot", "low", "high", "ids", "dist", "v"],
                )
                i = j
            held[:] = table.slice(i).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * BLOCK:
                yield from blocks(pa.Table.from_batches(held), False)
        if held:
            yield from blocks(pa.Table.from_batches(held), True)

    return ordered.mapInArrow(cut, "block bigint, pivot int, low double, high double, ids binary, dist binary, v binary")


def open_blocks(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, chunks: int, dim: int, most: float, k: int) -> DataFrame:
    """The k best of each query in each of its blocks: (query_id, vec_id, score).

    ``pairs`` (query_id, block, to_pivot, radius). Queries of a block come in chunks of bounded size.
    """
    asked = pairs.join(queries, "query_id").groupBy("block", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk"))
    asked = asked.agg(F.collect_list(F.struct("query_id", "to_pivot", "radius", "q")).alias("asked"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, dist = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("ids", np.int64), ("dist", np.float64)))
                v = np.frombuffer(batch.column("v")[r].as_py(), np.float64).reshape(len(ids), dim)
                exact = float(np.abs(v).max(initial=0)) ** 2 * dim < 2**53
                whole = None if exact else v.astype(np.int64).astype(object)
                asks = batch.column("asked")[r].values
                qs = matrix(asks.field("q"), dim)
                out: list[list] = [[], [], []]
                for x, qid, to_pivot, radius in zip(qs, *(asks.field(c).to_pylist() for c in ("query_id", "to_pivot", "radius")), strict=True):
                    square = float(x @ x) + most
                    best_id, best = np.zeros(0, np.int64), np.zeros(0)
                    lo = hi = int(np.searchsorted(dist, to_pivot))
                    while True:
                        near = radius * (1 + SLACK) + SLACK
                        down = lo > 0 and to_pivot - dist[lo - 1] <= near
                        up = hi < len(dist) and dist[hi] - to_pivot <= near
                        if not (down or up):
                            break
                        a, b = (max(0, lo - STEP) if down else lo), (min(len(dist), hi + STEP) if up else hi)
                        at = np.concatenate([np.arange(a, lo), np.arange(hi, b)])
                        at = at[ids[at] != qid]
                        lo, hi = a, b
                        s = v[at] @ x if exact else whole[at] @ x.astype(np.int64).astype(object)
                        best_id, best = np.append(best_id, ids[at]), np.append(best, s)
                        top = np.lexsort((best_id, -best))[:k]
                        best_id, best = best_id[top], best[top]
                        if len(best) == k:
                            radius = min(radius, math.sqrt(max(0.0, square - 2 * float(best[-1]))))
                    out[0] += [qid] * len(best)
                    out[1] += best_id.tolist()
                    out[2] += [int(s) for s in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return asked.join(blocks.select("block", "ids", "dist", "v"), "block").mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")


def top_k(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """The k rows of largest inner product for each query row: query_id, rank, vec_id, score."""
    vectors = stored(integer_vectors(rows, key, vector), "vectors")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("most")).first()
    spark = rows.sparkSession
    if not size.n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    n, dim, most = size.n, size.dim, float(size.most)
    pivots = choose_pivots(vectors, n, dim, most)
    blocks = stored(build_index(vectors, n, dim, pivots, most), "vector-blocks")

    queries = stored(rows.filter(is_query).select(F.col(key).cast("bigint").alias("vec_id")).join(vectors, "vec_id").groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id"), "queries")
    asked = queries.count()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(1), dim)
            d = to_pivots(np.hstack([q, np.zeros((len(q), 1))]), pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(d), pa.list_(pa.float64())), pa.array((q * q).sum(axis=1))], names=["query_id", "d", "square"])

    around = queries.mapInArrow(spread, "query_id bigint, d array<double>, square double").select("query_id", "square", F.posexplode("d").alias("pivot", "to_pivot"))
    shape = small_side(blocks.select("block", "pivot", "low", "high"), math.ceil(n / BLOCK) + PIVOTS)
    gap = F.greatest(F.lit(0.0), F.col("to_pivot") - F.col("high"), F.col("low") - F.col("to_pivot"))
    nearest = Window.partitionBy("query_id").orderBy(gap, "to_pivot", "block")
    first = around.join(shape, "pivot").withColumn("turn", F.row_number().over(nearest)).filter(F.col("turn") <= FIRST)
    first = stored(first.select("query_id", "block", "to_pivot", F.lit(float("inf")).alias("radius")), "first-blocks")
    chunks = max(1, math.ceil(asked / QUERIES))
    found = stored(open_blocks(first, queries, blocks, chunks, dim, most, k), "first-found")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    radius = F.when(F.col("kth").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("square") + F.lit(most) - 2 * F.col("kth"))))
    bound = around.join(small_side(kth, asked), "query_id", "left").withColumn("radius", radius)
    more = bound.join(shape, "pivot").filter(gap <= F.col("radius") * (1 + SLACK) + SLACK)
    more = more.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").select("query_id", "block", "to_pivot", "radius")
    rest = open_blocks(more, queries, blocks, chunks, dim, most, k)
    ranked = found.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
