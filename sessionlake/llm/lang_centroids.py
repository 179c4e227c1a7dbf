"""Operator 4: language identification by nearest centroid.

A text becomes a TF-IDF vector of its hashed byte n-grams (one to three bytes, A-Z lowered,
everything that is no letter one space), scaled to length 1. Each language has several
centroids: spherical k-means over a bounded sample of its labelled rows. A text takes the
language of the centroid with the largest cosine; if it is further from it than nearly all
sample rows of that centroid were, it is marked ``rejected`` (its language is still given).

The document frequencies cover every labelled row; only the k-means is fitted on a sample,
of about `SAMPLE_PER_LANG` rows a language, picked by a hash of the key.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all
texts when there is nothing to learn from. Equal cosines go to the first language by name.
A null key counts as held out. Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.text import LOWER, utf8

#: Hash buckets of the n-grams of each length.
BUCKETS = (256, 1024, 4096)
DIM = sum(BUCKETS)
SAMPLE_PER_LANG = 1000
CENTROIDS = 3
ROUNDS = 12
#: Share of a centroid's sample rows that may lie outside its radius.
OUTSIDE = 0.005
#: Documents vectorised together, and bytes.
ROWS, BYTES = 256, 1 << 20

#: ASCII letters lowered, bytes of other letters as they are, anything else a space.
LETTERS = LOWER.copy()
LETTERS[:128][~np.isin(np.arange(128), [*range(65, 91), *range(97, 123)])] = 32


def held_out(key: str, modulus: int, rest: int) -> Column:
    """True for rows that nothing is learnt from: crc32 of the key as text leaves ``rest``; null keys too."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == rest, F.lit(True))


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + BYTES, side="right")) - 1
        b = min(max(b, a + 1), n, a + ROWS)
        yield a, b
        a = b


def counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """n-gram counts of documents [a, b), a row each."""
    data, offsets = utf8(texts)
    for a, b in groups(offsets):
        part = LETTERS[data[offsets[a] : offsets[b]]]
        doc = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        keep = np.ones(len(part), bool)  # of a run of spaces, the first
        keep[1:] = (part[1:] != 32) | (part[:-1] != 32) | (doc[1:] != doc[:-1])
        part, doc = part[keep].astype(np.uint32), doc[keep]
        out = np.zeros((b - a) * DIM, np.float32)
        code, base = np.zeros(len(part), np.uint32), 0
        for n, size in enumerate(BUCKETS, 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            code = (code[:m] << np.uint32(8)) | part[n - 1 :]
            whole = (doc[:m] == doc[n - 1 :]) & (code != 32 if n == 1 else True)
            bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (size.bit_length() - 1))).astype(np.int64)
            out += np.bincount((doc[:m] * DIM + base + bucket)[whole], minlength=len(out)).astype(np.float32)
            base += size
        yield a, b, out.reshape(b - a, DIM)


def unit(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows (with the logarithm of counts) of length 1; rows without n-grams stay zero."""
    rows = np.log1p(rows) * idf
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and (not t.isascii() or not t.isdigit()) and any(map(str.isalpha, t)) for t in texts], bool)


def kmeans(rows: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length 1, and for each the smallest cosine inside its radius."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(rows)))]
    near = rows @ rows[picked[0]]
    while len(picked) < min(k, len(rows)):  # the row furthest from all picked ones
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[picked[-1]])
    centres = rows[picked]
    for _ in range(ROUNDS):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cos = rows @ centres.T
    own = np.argmax(cos, axis=1)
    radius = [np.quantile(cos[own == j, j], OUTSIDE) if (own == j).any() else 1.0 for j in range(len(centres))]
    return centres.astype(np.float32), np.array(radius, np.float32)


def fit(labelled: DataFrame, key: str, text: str, lang: str) -> dict:
    """Learn from rows with a language: inverse document frequencies, centroids, radii."""
    labelled = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for a, b, c in counts(batch.column(0)):
                total += (c > 0).sum(axis=0)
                n += b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["feature", "df"])

    df = np.zeros(DIM)
    n = 0
    for r in labelled.select(text).mapInArrow(frequencies, "feature int, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).collect():  # DIM + 1 rows at most
        if r.feature < 0:
            n = r.df
        else:
            df[r.feature] = r.df
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    sizes = labelled.groupBy(lang).agg(F.count("*").alias("rows"))
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_PER_LANG)) / F.col("rows"))
    sample = (
        labelled.join(F.broadcast(sizes), lang)  # a row for each language
        .filter(F.pmod(F.xxhash64(F.lit(4), key), F.lit(1 << 20)) < share * (1 << 20))
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    )

    def centroids(group: pa.Table) -> pa.Table:
        texts = group.column("text").combine_chunks()
        rows = np.concatenate([unit(c, idf) for _, _, c in counts(texts)])
        rows = rows[(rows != 0).any(axis=1)]
        if not len(rows):
            return pa.table({"lang": pa.array([], pa.string()), "centre": pa.array([], pa.binary()), "radius": pa.array([], pa.float32())})
        rows = rows[np.lexsort(rows[:, :16].T)]  # in an order of their own, so that a rerun gives the same
        centres, radius = kmeans(rows, CENTROIDS, 4)
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(centres), "centre": [c.tobytes() for c in centres], "radius": pa.array(radius, pa.float32())})

    found = sorted(sample.groupBy("lang").applyInArrow(centroids, "lang string, centre binary, radius float").collect())  # CENTROIDS rows a language
    return {
        "idf": idf,
        "langs": [r.lang for r in found],
        "centres": np.stack([np.frombuffer(r.centre, np.float32) for r in found]) if found else np.zeros((0, DIM), np.float32),
        "radius": np.array([r.radius for r in found], np.float32),
    }


def predict(docs: DataFrame, model: dict, key: str, text: str, *more: str) -> DataFrame:
    """Per document: key, the columns ``more``, lang_pred, score (the cosine), rejected."""
    rows = docs.select(key, *more, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats a centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        centres, langs = m["centres"], np.array([*m["langs"], "und"], object)
        for batch in batches:
            n, texts = batch.num_rows, batch.column(batch.num_columns - 1)
            best, score = np.full(n, len(langs) - 1), np.zeros(n)
            if len(centres):
                for a, b, c in counts(texts):
                    cos = unit(c, m["idf"]) @ centres.T
                    best[a:b] = np.argmax(cos, axis=1)
                    score[a:b] = np.clip(cos.max(axis=1), 0, 1)
                none = ~has_letter(texts.to_pylist())
                best[none], score[none] = len(langs) - 1, 0.0
            radius = np.append(m["radius"], -1)[best]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(langs[best], pa.string()), pa.array(score, pa.float64()), pa.array(score < radius)],
                names=[*(f.name for f in batch.schema)][:-1] + ["lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(run, f"{head}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 4, rest: int = 2) -> DataFrame:
    """Learn from the rows that aren't held out, predict all: key, held_out, lang_pred, score, rejected."""
    rows = docs.select(key, text, lang).withColumn("held_out", held_out(key, modulus, rest))
    return predict(rows, fit(rows.filter(~F.col("held_out")), key, text, lang), key, text, "held_out")
