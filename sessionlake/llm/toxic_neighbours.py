"""Operator 7: toxicity by the nearest labelled examples.

Examples and texts are TF-IDF vectors over all words and word beginnings of the examples. A term's
inverse document frequency is raised by how surely its texts have the label: by the lower end of a
Wilson interval of their share, as far as it is over the base rate. No term is left out. The nearest examples by
exact cosine come from an inverted index. Like examples lie together in clusters (of one language, say); each has a
matrix of single precision of the terms that are frequent in it, which many texts are multiplied with at once, and lists of
the other terms are read whole. The sums are wrong by a known share at most, so the examples that may be among the nearest
get their cosines once more in double precision. Clusters decide on the time, not on what is found. Votes weighted
by nearness give a raw score, which scores of the examples without their own votes calibrate
(isotonic). The nearest examples are given as evidence.

The examples are a bounded sample, of about `FIT_ROWS` labelled rows picked by a hash of the key;
all texts are scored whole.

Defined results: a text without any term of the examples (empty and null texts too) has no
neighbour; it scores as examples without a term do, and without those like a text without votes
for the label. Without labelled rows every score is 0. Several labels of a key count as the largest.
A null key is held out. Equal cosines go to the earlier example by key. Repeated rows are scored as
often as they come. Very long texts are read in runs and are one vector; empty tables give no rows; columns of other names are not
read by `score` and pass through `without_toxic`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.config import storage_root
from sessionlake.llm.lang_centroids import held_out
from sessionlake.llm.text import LOWER, U64, give_back, keep_room, prefix_hash, range_hash, runs, utf8, words

keep_room()

FIT_ROWS = 20_000
#: How much a sure share of the label raises a term's weight, and the width of the share's interval.
LIFT, Z = 4.0, 2.0
#: Clusters of the examples, the most frequent terms by which they are made and about how many examples they are made from.
CLUSTERS, SEEN, MADE_FROM, ROUNDS = 8, 512, 2000, 8
#: Terms in more than this share of a cluster are frequent there, and rows of its matrix: the most frequent ones, if there are more than it holds.
FREQUENT, MATRIX_ROWS = 1 / 12, 3 << 9
#: Lists of fewer examples are read together.
SHORT = 192
#: A text with fewer than this share of a matrix's terms reads only their rows.
DENSE = 1 / 24
#: Texts that the matrix is multiplied with at once, and examples that are put into lists at once.
TOGETHER, TAKEN = 128, 512
#: Byte lengths of the word beginnings that are terms beside the words themselves.
BEGINNINGS = (4, 5)
NEIGHBOURS = 30
#: A score from which a text is predicted to have the label.
THRESHOLD = 0.7
#: Weight of the base rate among the votes, of nearness in a vote, and the nearness from which votes grow no more
#: (a copy of an example is one witness among others, its label may be wrong).
PRIOR, NEAR_POWER, NEAR_ENOUGH = 0.25, 2.0, 0.5

#: ASCII letters lowered, digits and bytes of other letters as they are, anything else a separator.
TOKENS = LOWER.copy()
TOKENS[:128][~np.isin(np.arange(128), [*range(48, 58), *range(65, 91), *range(97, 123)])] = 32


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents [a, b): term hashes and the document (from a) that each stands in."""
    data, offsets = utf8(texts)
    for a, b in runs(offsets):
        w = words(TOKENS[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
        sums = prefix_hash(w.data)
        doc = np.repeat(np.arange(b - a), np.diff(w.first))
        found, at = [range_hash(sums, w.start, w.end)], [doc]
        for n in BEGINNINGS:
            longer = w.end - w.start > n
            start = w.start[longer]
            found.append(range_hash(sums, start, start + n) ^ U64(n))
            at.append(doc[longer])
        yield a, b, np.concatenate(found), np.concatenate(at)


def vocabulary(examples: DataFrame, text: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Term hashes in order, their document frequencies and labelled ones, examples, labelled examples."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = pos = 0
        for batch in batches:
            y = np.asarray(batch.column(1)).astype(np.int64)
            n, pos = n + len(y), pos + int(y.sum())
            for a, _, h, d in terms(batch.column(0)):
                if len(h):
                    h, back = np.unique(h, return_inverse=True)
                    doc, col = np.divmod(np.unique(d.astype(np.int64) * len(h) + back), len(h))
                    hits, held = (np.bincount(col, x, len(h)).astype(np.int64) for x in (y[a + doc], None))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(hits), pa.array(held), pa.array(np.zeros(len(h), bool))], names=["term", "pos", "n", "total"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([pos], pa.int64()), pa.array([n], pa.int64()), pa.array([True])], names=["term", "pos", "n", "total"])

    counted = examples.select(text, label).mapInArrow(count, "term bigint, pos bigint, n bigint, total boolean").groupBy("total", "term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    rows = counted.toArrow()  # a row a term of the bounded sample
    total, term, pos, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("total", "term", "pos", "n"))
    total = total.astype(bool)
    order = np.argsort(term[~total].view(U64))
    return term[~total].view(U64)[order], n[~total][order].astype(float), pos[~total][order].astype(float), int(n[total].sum()), int(pos[total].sum())


def lift(df: np.ndarray, pos: np.ndarray, base: float) -> np.ndarray:
    """The factor of each term's weight: from 1 up, the more surely its texts have the label."""
    p, z2 = pos / df, Z * Z
    low = (p + z2 / (2 * df) - Z * np.sqrt(p * (1 - p) / df + z2 / (4 * df * df))) / (1 + z2 / df)
    return 1 + LIFT * np.maximum(0, low - base)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of ranges one after another."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def groups(items: Iterator, size: int) -> Iterator[list]:
    """Lists of ``size`` items, and the rest."""
    while some := list(islice(items, size)):
        yield some


#: Run after run of the examples of a range: how many terms each has, these end to end, where in them the level isn't 1, and which level it is there.
Parts = Callable[[int, int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


class Index:
    """An inverted index over the examples' unit vectors, with a matrix of each cluster's frequent terms."""

    def __init__(self, vocab: np.ndarray, df: np.ndarray, n_examples: int, base: float, factor: np.ndarray | float = 1.0):
        self.vocab, self.base = vocab, base
        bits = len(vocab).bit_length()
        self.cut = U64(64 - max(1, bits))
        self.begin = np.minimum(np.searchsorted(vocab, np.arange(1 << max(1, bits), dtype=U64) << self.cut), max(0, len(vocab) - 1)).astype(np.int32)
        self.idf = np.log((1 + n_examples) / (0.5 + df)) * factor  # over 0 for every term
        self.n, self.label, self.key = 0, np.zeros(0), np.zeros(0, np.int64)
        self.matrices: list[np.ndarray] = []  # made where they are used

    def place(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is in the vocabulary, if it is there: from where its first bits begin, on past the smaller ones."""
        at = self.begin.take((h >> self.cut).astype(np.int64)).astype(np.int64)
        late = np.flatnonzero(self.vocab.take(at) < h)
        while len(late):
            at[late] += 1
            late = late[at[late] < len(self.vocab)]
            late = late[self.vocab.take(at[late]) < h[late]]
        return np.minimum(at, len(self.vocab) - 1)

    def counts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, terms, their counts) of the documents that have a term."""
        if not len(self.vocab):
            return
        for a, _, h, d in terms(texts):
            at = self.place(h)
            sure = np.flatnonzero(self.vocab.take(at) == h)
            cell, tf = np.unique(d[sure].astype(np.int64) * len(self.vocab) + at[sure], return_counts=True)
            doc, term = np.divmod(cell, len(self.vocab))
            edge = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                yield a + int(doc[i]), term[i:j], tf[i:j]

    def weigh(self, t: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, float]:
        """The weights of a document's terms, of length 1, and the length before."""
        w = (1 + np.log(tf)) * self.idf[t]
        length = float(np.sqrt((w * w).sum()))
        return w / length, length

    def vectors(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, terms, weights) of the documents that have a term; weights have length 1."""
        for i, t, tf in self.counts(texts):
            yield i, t, self.weigh(t, tf)[0]

    def build(self, keys: list[int], labels: list[int], rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Take the examples' vectors."""
        term = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in rows)], dtype=np.int32)
        level = np.concatenate([np.zeros(0), *(w for _, w in rows)]) / self.idf[term]
        at, bounds = np.arange(len(term)), np.array([0, len(rows)])
        self.fill(keys, labels, np.ones(len(rows)), level, bounds, lambda a, b: iter([(np.array([len(t) for t, _ in rows], np.int64), term, at, at)]))

    def alike(self, df: np.ndarray, n: int, parts: Parts) -> np.ndarray:
        """A cluster for each of ``n`` examples, by cosine with the centres of some of them."""
        seen = np.argsort(-df, kind="stable")[:SEEN]
        column = np.full(len(self.vocab), -1, np.int16)
        column[seen] = np.arange(len(seen))

        def vectors(size: np.ndarray, term: np.ndarray) -> np.ndarray:
            out, at = np.zeros((len(size), len(seen)), np.float32), column[term]
            out[np.repeat(np.arange(len(size)), size)[at >= 0], at[at >= 0]] = self.idf[term[at >= 0]]
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        step = -(-n // MADE_FROM)
        some = np.concatenate([vectors(size, term)[::step] for size, term, _, _ in parts(0, n)])
        centres = some[:1]
        for _ in range(CLUSTERS - 1):  # the next one is far from those there, but no stray
            centres = np.concatenate([centres, some[[np.argsort((some @ centres.T).max(axis=1), kind="stable")[len(some) // 20]]]])
        for _ in range(ROUNDS):
            own = (some @ centres.T).argmax(axis=1)
            centres = np.stack([some[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(CLUSTERS)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        return np.concatenate([(vectors(size, term) @ centres.T).argmax(axis=1) for size, term, _, _ in parts(0, n)])

    def fill(self, keys: np.ndarray, labels: np.ndarray, lengths: np.ndarray, levels: np.ndarray, bounds: np.ndarray, parts: Parts) -> None:
        """`build` with a weight as the term's idf, over the vector's length, times one of the ``levels``, and clusters of the examples
        from one of the ``bounds`` to the next. A term has two lists: the examples where its level is 1, and the others with theirs. Only one
        part's terms are held beside the lists."""
        self.key, self.label, self.n, self.times = np.array(keys, np.int64), np.array(labels, float), len(lengths), 1 / lengths
        self.rank = np.empty(self.n, np.int64)
        self.rank[np.argsort(self.key, kind="stable")] = np.arange(self.n)
        self.levels = np.append(1.0, levels)
        # a cluster's frequent terms: lists by example; its other terms: lists by term
        self.bounds, self.rows = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), [0]
        slot = np.full((len(self.bounds), len(self.vocab)), -1, np.int16)
        held, n_own = np.zeros((2, len(self.vocab)), np.int64), 0
        for slots, (lo, hi) in zip(slot, self.bounds, strict=True):
            here = np.zeros_like(held)
            for _, term, more, _ in parts(lo, hi):
                there = np.bincount(term[more], minlength=here.shape[1])
                here += np.stack([np.bincount(term, minlength=here.shape[1]) - there, there])
            both = here.sum(axis=0)
            often = np.flatnonzero(both > FREQUENT * (hi - lo))
            often = np.sort(often[np.argsort(-both[often], kind="stable")[:MATRIX_ROWS]])
            slots[often] = self.rows[-1] + np.arange(len(often))
            self.rows.append(self.rows[-1] + len(often))
            n_own += int(both[often].sum())
            here[:, often] = 0
            held += here
        level_type, doc_type = np.min_scalar_type(len(levels)), np.min_scalar_type(max(1, self.n))
        self.slot_held = (slot >= 0).sum(axis=0, dtype=np.int32)
        self.slot_first, self.slot_of = np.cumsum(self.slot_held, dtype=np.int32) - self.slot_held, slot.T[slot.T >= 0]
        self.first, self.more_first = (np.append(0, np.cumsum(x)) for x in held)
        self.held, self.more_held = held.astype(np.int32)
        self.entry, self.more_entry = (np.empty(x[-1], doc_type) for x in (self.first, self.more_first))
        self.more_level = np.empty(len(self.more_entry), level_type)
        self.own_term, self.own_level = np.empty(n_own, np.int16), np.empty(n_own, level_type)
        to, more_to, own, sizes = self.first[:-1].copy(), self.more_first[:-1].copy(), 0, [np.zeros(0, np.int64)]
        for slots, (lo, hi) in zip(slot, self.bounds, strict=True):
            for size, term, more, level in parts(lo, hi):
                doc, row, levels_ = np.repeat(np.arange(lo, lo + len(size)), size), slots[term], np.zeros(len(term), np.int64)
                levels_[more] = level + 1
                at = np.flatnonzero((row < 0) & (levels_ == 0))
                order, where = self.places(to, term[at])
                self.entry[where] = doc[at][order]
                at = np.flatnonzero((row < 0) & (levels_ > 0))
                order, where = self.places(more_to, term[at])
                self.more_entry[where], self.more_level[where] = doc[at][order], levels_[at][order]
                at = np.flatnonzero(row >= 0)
                self.own_term[own : own + len(at)], self.own_level[own : own + len(at)] = row[at], levels_[at]
                sizes.append(np.bincount(doc[at] - lo, minlength=len(size)))
                lo, own = lo + len(size), own + len(at)
        self.own_first = np.append(0, np.cumsum(np.concatenate(sizes)))

    @staticmethod
    def places(to: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of entries by term and their places, from ``to`` of the term on, which moves behind them."""
        order = np.argsort(term, kind="stable")
        term = term[order]
        start = np.flatnonzero(np.diff(term, prepend=-1))
        size = np.diff(np.append(start, len(term)))
        where = to[term] + np.arange(len(term)) - np.repeat(start, size)
        to[term[start]] += size
        return order, where

    def exact(self, which: np.ndarray, part: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Cosines of some examples: what the rare terms gave, and the frequent ones."""
        start, end = self.own_first[which], self.own_first[which + 1]
        own = [slice(i, j) for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        some = np.flatnonzero(end > start)
        sums = np.zeros(len(which))
        if len(some):
            each = query.take(np.concatenate([self.own_term[x] for x in own], dtype=np.int64))
            each *= self.levels.take(np.concatenate([self.own_level[x] for x in own], dtype=np.int64))
            sums[some] = np.add.reduceat(each, (np.cumsum(end - start) - (end - start))[some])
        return self.times[which] * (part[which] + sums)

    def read(self, rare: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For each example the sum of ``times``, by its levels, over the terms in whose lists it is."""
        start, size, more = self.first.take(rare), self.held.take(rare), self.more_held.take(rare)
        short, long, more_ = np.flatnonzero((size > 0) & (size < SHORT)), np.flatnonzero(size >= SHORT), np.flatnonzero(more)
        at, more_at = ranges(start[short], size[short]), ranges(self.more_first.take(rare[more_]), more[more_])
        starts, sizes = start[long], size[long]
        docs = [self.entry.take(at), *(self.entry[i:j] for i, j in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)), self.more_entry.take(more_at)]
        by = np.repeat(times[np.concatenate([short, long, more_])], np.concatenate([size[short], sizes, more[more_]]))
        by[len(by) - len(more_at) :] *= self.levels.take(self.more_level.take(more_at))
        return np.bincount(np.concatenate(docs, dtype=np.int64), by, minlength=self.n)

    def nearest(self, t: np.ndarray, w: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples and their cosines, all that share a term if there are fewer; none of key ``without``."""
        return self.nearest_of([(t, w, without)])[0]

    def nearest_of(self, texts: list[tuple[np.ndarray, np.ndarray, int | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` of each text."""
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in texts]
        if not self.matrices:
            for lo, hi, low, high in zip(*zip(*self.bounds, strict=True), self.rows, self.rows[1:], strict=False):
                self.matrices.append(np.zeros((high - low, hi - lo), np.float32))
                for i in range(lo, hi, TAKEN):
                    j = min(i + TAKEN, hi)
                    own = slice(self.own_first[i], self.own_first[j])
                    doc = np.repeat(np.arange(i, j), np.diff(self.own_first[i : j + 1]))
                    self.matrices[-1][self.own_term[own] - low, doc - lo] = self.levels[self.own_level[own]] * self.times[doc]
        queries, rares = np.zeros((len(texts), self.rows[-1])), []
        for query, (t, w, _) in zip(queries, texts, strict=True):
            by = w * self.idf[t]
            many = self.slot_held.take(t)
            often = np.flatnonzero(many)
            query[self.slot_of.take(ranges(self.slot_first.take(t[often]), many[often]))] = np.repeat(by[often], many[often])
            rares.append((t, by))
        sums, single = np.zeros((len(texts), self.n), np.float32), queries.astype(np.float32)
        for matrix, (lo, hi), low, high in zip(self.matrices, self.bounds, self.rows, self.rows[1:], strict=False):
            part = single[:, low:high]
            many = np.count_nonzero(part, axis=1) > DENSE * (high - low)
            sums[many, lo:hi] = part[many] @ matrix
            for i in np.flatnonzero(~many & part.any(axis=1)).tolist():
                at = np.flatnonzero(part[i])
                sums[i, lo:hi] = part[i, at] @ matrix[at]
        wrong = (max(len(m) for m in self.matrices) + 8) * 2.0**-23  # at most this share of a sum, as nothing is under 0
        out = []
        for near, query, rare, (_, _, without) in zip(sums, queries, rares, texts, strict=True):
            part = self.read(*rare)
            near += part * self.times  # also in single precision
            if without is not None:
                near[self.key == without] = 0
            kth = float(np.partition(near, -NEIGHBOURS)[-NEIGHBOURS]) if self.n > NEIGHBOURS else 0.0
            docs = np.flatnonzero(near >= max(kth * (1 - 2 * wrong) - 1e-9, 1e-30))
            sims = self.exact(docs, part, query)
            best = np.lexsort((self.rank[docs], -np.round(sims, 12)))[:NEIGHBOURS]
            out.append((docs[best], sims[best]))
        return out

    def raw(self, docs: np.ndarray, sims: np.ndarray) -> float:
        v = np.minimum(sims, NEAR_ENOUGH) ** NEAR_POWER
        return float((v @ self.label[docs] + PRIOR * self.base) / (v.sum() + PRIOR))


@dataclass
class Scores:
    """From votes to scores: the curve (raw scores, shares of the label) and the score of texts without a term."""

    curve: tuple[np.ndarray, np.ndarray] | None
    no_term: float

    def of(self, raw: float) -> float:
        return raw if self.curve is None else float(np.interp(raw, *self.curve))


def calibrate(scores: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Isotonic regression by pooling neighbours, smoothed towards the middle of few rows."""
    pools: list[list[float]] = []
    order = np.argsort(scores, kind="stable")
    for s, v in zip(scores[order], y[order], strict=True):
        pools.append([v, 1, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, n2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + v2, pools[-1][1] + n2, pools[-1][2], last]
    ends = np.array([p[2:] for p in pools]).reshape(-1)  # a pool holds from its first score to its last
    return (ends, np.repeat([(p[0] + 0.1 * base) / (p[1] + 0.1) for p in pools], 2)) if pools else None


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[Broadcast, Scores]:
    """Learn from labelled documents that aren't held out (``labels`` has one row a key at most)."""
    spark, n = docs.sparkSession, labels.count()
    few = labels.filter(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 20)) < int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 20)))
    path = storage_root(spark, "toxic-examples")
    docs.select(key, text).join(F.broadcast(few), key).write.parquet(path)  # about FIT_ROWS pairs of numbers
    examples = spark.read.parquet(path)
    vocab, df, pos, total, positive = vocabulary(examples, text, label)
    base = positive / total if total else 0.0
    if not positive or not len(vocab):
        return spark.sparkContext.broadcast(Index(np.zeros(0, U64), np.zeros(0), total, base)), Scores(None, base)
    index = Index(vocab, df, total, base, lift(df, pos, base))
    del vocab, pos
    words_only = spark.sparkContext.broadcast(index)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = words_only.value
        for batch in batches:
            rows = dict.fromkeys(range(batch.num_rows), (-1, 0.0, b"", b"", b""))
            for i, t, tf in near.counts(batch.column(1)):
                w, length = near.weigh(t, tf)
                more = np.flatnonzero(tf > 1)
                rows[i] = (int(t[np.argmax(w)]), length, t.astype(np.int32).tobytes(), more.astype(np.int32).tobytes(), tf[more].astype(np.int32).tobytes())
            cells = [pa.array([r[i] for r in rows.values()], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int64()), *cells], names=["key", "label", "top", "length", "terms", "more", "tf"])

    path = storage_root(spark, "toxic-vectors")
    examples.select(key, text, label).mapInArrow(vectors, "key bigint, label bigint, top bigint, length double, terms binary, more binary, tf binary").write.parquet(path)
    words_only.destroy()
    made = spark.read.parquet(path)
    plain = made.filter("top < 0").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    made = made.filter("top >= 0")
    rows = made.toArrow()  # the bounded sample's vectors
    key_, label_, top, lengths = (np.asarray(rows.column(c).combine_chunks()) for c in ("key", "label", "top", "length"))
    order = np.lexsort((key_, top))  # like examples lie together
    cells = [[x.as_buffer() for x in rows.column(c)] for c in ("terms", "more", "tf")]
    known = np.unique(np.concatenate([np.zeros(0, np.int32), *(np.unique(np.frombuffer(x, np.int32)) for x in cells[2])]))

    def parts(start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(start, end, TAKEN):
            t, more, tf = ([np.frombuffer(column[i], np.int32) for i in order[a : min(a + TAKEN, end)]] for column in cells)
            size = np.array([len(x) for x in t], np.int64)
            shift = np.repeat(np.cumsum(size) - size, [len(x) for x in more])
            yield size, np.concatenate(t), np.concatenate(more) + shift, np.searchsorted(known, np.concatenate(tf))

    if len(order):
        cluster = index.alike(df, len(order), parts)
        order = order[np.argsort(cluster, kind="stable")]
        bounds = np.append(0, np.cumsum(np.bincount(cluster)))
        index.fill(key_[order], label_[order], lengths[order], 1 + np.log(known), bounds[np.append(True, np.diff(bounds) > 0)], parts)
    del rows, cells
    shared = spark.sparkContext.broadcast(index)  # about FIT_ROWS vectors

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        for batch in batches:
            raws = []
            for rows in groups(zip(batch.column(0).to_pylist(), *(batch.column(c) for c in ("terms", "more", "tf")), strict=True), TOGETHER):
                texts = []
                for k, *cells in rows:
                    t, more, tf = (np.frombuffer(c.as_buffer(), np.int32) for c in cells)
                    counts = np.ones(len(t))
                    counts[more] = tf
                    texts.append((t, near.weigh(t, counts)[0], k))
                raws += [near.raw(*found) for found in near.nearest_of(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(raws, pa.float64()), batch.column(1)], names=["raw", "label"])
        near.matrices.clear()  # a worker outlives its tasks
        give_back()

    loo = made.select("key", "label", "terms", "more", "tf").mapInArrow(others, "raw double, label bigint").toArrow()
    raw, y = (np.asarray(loo.column(c).combine_chunks()) for c in ("raw", "label"))
    order = np.lexsort((y, raw))
    scores = Scores(calibrate(raw[order], y[order], base), base)
    scores.no_term = ((plain.pos or 0) + 0.5 * scores.of(0.0)) / (plain.n + 0.5)
    return shared, scores


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, modulus: int, rest: int) -> tuple[Broadcast, Scores]:
    """The index and scores of the labelled documents that aren't held out."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias(label))
    return fit(docs, known.filter(~held_out(key, modulus, rest)), key, text, label)


def score_batch(index: Index, scores: Scores, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
    """Scores from 0 to 1, and the keys of the nearest examples."""
    s, why = np.full(len(texts), scores.no_term), [[]] * len(texts)
    for some in groups(index.vectors(texts), TOGETHER):
        for (i, _, _), (found, sims) in zip(some, index.nearest_of([(t, w, None) for _, t, w in some]), strict=True):
            if len(found):
                s[i], why[i] = scores.of(index.raw(found, sims)), index.key[found].tolist()
    return np.clip(s, 0, 1), why


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 3, rest: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: key, held_out, score, predicted, evidence (keys of the nearest examples)."""
    shared, scores = learn(docs, labels, key, text, label, modulus, rest)
    rows = docs.select(key, held_out(key, modulus, rest).alias("held_out"), text)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, why = score_batch(shared.value, scores, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(why, pa.list_(pa.int64()))], names=[key, "held_out", "score", "predicted", "evidence"])
        shared.value.matrices.clear()
        give_back()

    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int, evidence array<bigint>")


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 3, rest: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold."""
    shared, scores = learn(docs, labels, key, text, label, modulus, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_batch(shared.value, scores, batch.column(text))[0] < threshold))
        shared.value.matrices.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)
