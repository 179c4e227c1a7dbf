"""Operator 5: near-duplicate documents by a chosen-path set similarity join.

A document is the set of its 5-word shingles. Documents with the same set are one class; the
classes are joined. In each of `TREES` independent trees a class walks down: at a node it
branches to the children named by two chosen minwise tokens, so similar sets share a child with
a probability of at least their similarity for each choice. Small nodes are compared
exhaustively, larger ones branch again (see `linking.resolve`), and every candidate is
confirmed on the full sets.

Recall: with two choices a pair of similarity J shares a path of any length in a tree with
probability (2J - 1) / J^2 at least: 0.889 at 0.75, so five trees miss fewer than 2 pairs
in 100,000 at the threshold. A candidate needs 34 of 64 equal minwise values, which a pair at the
threshold misses with probability 2e-5. Both fall quickly above the threshold.

Defined results: without words (empty or null text) a document has an empty set, is linked with
nothing and is its own component. Fewer than five words: the whole sequence is one shingle.
Rows with a null key are left out: they name no document. Rows that repeat a key count as the
same document: they come out once each, with one component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import linking
from sessionlake.llm.text import U64, minhash, mix, shingle_set, word_runs

SHINGLE, PERCENT = 5, 75
VALUES, CUT, TREES, CHOICES = 64, 34, 5, 2
SEED = 5


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig): size, 128-bit fingerprint and minwise values of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in word_runs(batch.column(1), lower=True):
                h = w.hashes()
                sets = [shingle_set(h[w.first[i] : w.first[i + 1]], SHINGLE) for i in range(b - a)]
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                f1, f2, sig = np.zeros(b - a, U64), np.zeros(b - a, U64), np.zeros((b - a, VALUES), np.uint32)
                if len(full):
                    flat, first = np.concatenate([sets[i] for i in full]), np.append(0, np.cumsum(size[full]))[:-1]
                    f1[full] = np.add.reduceat(mix(flat ^ U64(1)), first)
                    f2[full] = np.add.reduceat(mix(flat ^ U64(2)), first)
                    sig[full] = minhash(flat, first, VALUES, SEED)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "f1", "f2", "sig"],
                )

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), text)
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig binary")


def read_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def chosen_paths(rows: DataFrame, level: int) -> DataFrame:
    """(node, id): the children of each row (node, id, sig); at the root a row stands for all trees."""
    trees = TREES if level == 0 else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids, sig = np.asarray(batch.column(0)), np.asarray(batch.column(1)), read_signatures(batch.column(2))
            at = np.arange(len(ids))
            for t in range(trees):
                # each node chooses its own tokens: from the tree at the root, from its path below
                own = linking.fold(np.full(len(ids), level), np.full(len(ids), t), node).view(U64)
                one = (own % U64(VALUES)).astype(np.int64)
                two = (one + 1 + ((own >> U64(32)) % U64(VALUES - 1)).astype(np.int64)) % VALUES
                for c in (one, two):
                    child = linking.fold(node, np.full(len(ids), t), c, sig[at, c])
                    yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(ids)], names=["node", "id"])

    return rows.select("node", "id", "sig").mapInArrow(run, "node bigint, id bigint")


def set_rows(docs: DataFrame, key: str, text: str):
    """(id, data): the shingle sets of given documents, as sorted 64-bit hashes."""

    def of(ids: DataFrame, n: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, w in word_runs(batch.column(1), lower=True):
                    h = w.hashes()
                    data = [shingle_set(h[w.first[i] : w.first[i + 1]], SHINGLE).tobytes() for i in range(b - a)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(data, pa.large_binary()).cast(pa.binary())], names=["id", "data"])

        rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("_text"))
        return rows.join(linking.small_side(ids, n), "id", "left_semi").mapInArrow(run, "id bigint, data binary").dropDuplicates(["id"])

    return of


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    made = linking.stored(signatures(docs, key, text), "signatures")
    rows = made.filter("n_shingles > 0")
    classes = rows.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"))
    classes = linking.stored(classes, "classes")
    reps = classes.groupBy("id").agg(F.first("sig").alias("sig"))
    nodes = linking.shared_nodes(chosen_paths(classes.select(F.lit(0).cast("bigint").alias("node"), "id", "sig"), 0))
    items = linking.Items(reps, set_rows(docs, key, text), read_signatures, lambda data: np.frombuffer(data, U64), CUT, PERCENT)
    _, comp = linking.resolve(nodes, items, chosen_paths)
    found = classes.join(comp, "id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    linked = rows.select("doc_id", "n_shingles", "f1", "f2").join(found, ["f1", "f2", "n_shingles"])
    alone = made.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
