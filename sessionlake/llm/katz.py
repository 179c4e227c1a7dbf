"""Operator 2: a Katz backoff bigram model, trained on a part of the documents and applied to all.

Counts are discounted by Good-Turing (Katz's renormalised form up to count `GT`). Every bigram seen in
training has its discounted relative frequency; for any other the recursion backs off:
its probability is the unigram's, times the context's weight, which makes the context's
probabilities sum to exactly 1 over the vocabulary and one unknown word. The mass that discounting takes
from unigrams is the unknown word's. A context whose counts are all too high for a discount gets one
count more than it has, for what else may follow, as the unigrams do.

The recursion is evaluated as sums over a document: log P(w) of each token and log alpha of
each token's context, and for tokens whose bigram is kept what its count and its word give more,
log mass - log P(w), and what its context gives more, - log of - log alpha (`off`). Each of these needs one row:

- the `HEAVY` most frequent words (a fixed number) and the beginning of a text are known to all tasks, and of
  their bigrams the `HEAVY` most frequent ones. They are looked up where the text is read; that also
  takes the hot keys out of every exchange;
- other words lie in partitions by hash, and their bigrams are counted and looked up where they do, so
  no bigram is joined with its words. One of two such words lies with both, and each gives its own part. Bigrams of
  frequent words lie in partitions by their own hash.

Tasks send compressed columns of sorted, pre-aggregated rows to each partition (`pack`); bigrams are kept in that
form too, and documents get one row of sums back from each.

Defined results: null and empty texts have one token, the end; very long ones are read run by run. Without training tokens the unknown
word has probability 1. Null keys count as held out. Rows are scored as often as they come; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.lang_centroids import held_out
from sessionlake.llm.linking import stored
from sessionlake.llm.text import U64, mix, word_runs

#: Counts up to this are discounted; bigrams seen fewer times are backed off (none are at 1).
GT, MIN_BIGRAM = 5, 1
#: A context with less than this share of its mass left has none.
RESERVE = 1e-9
HEAVY = 1 << 16
#: Tokens that a task gathers before it sends them, and rows of a partition.
GATHER, PART_ROWS = 600_000, 4_000_000
#: Bits of a heavy word's code (and one more number, the beginning), and of a row's number in a gathering.
CODE_BITS, ROW_BITS = U64(17), U64(29)

BEGIN, END = U64(0x1D5A2F86C3B94E71), U64(0x7C0E9B3D6A18F255)  # hashes that stand for no word
LIGHT = U64(1 << 63)  # set in the code of every word that isn't heavy


# -- columns on the wire ------------------------------------------------------------


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """Integers as compressed byte planes; ``rising`` ones as their differences."""
    import zstandard

    a = np.asarray(a).astype(U64)
    if rising and len(a):
        a = np.append(a[:1], np.diff(a))
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    a = np.ascontiguousarray(planes.reshape(8, -1).T).view(U64).ravel()
    return np.cumsum(a, dtype=U64) if rising else a


def pair_hash(ctx: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(ctx) * U64(0x9E3779B97F4A7C15) + w)


def counted(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in order (the first key first), with the sums of n."""
    order = np.lexsort(keys[::-1])
    keys, n = tuple(k[order] for k in keys), n[order]
    if not len(n):
        return keys, n
    first = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    return tuple(k[first] for k in keys), np.add.reduceat(n, first)


# -- reading texts --------------------------------------------------------------------


def token_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(row ids, train, context, token, row of token, keys): about GATHER tokens at a time, ends included.

    Keys are two arrays in one: their values, and whether they are null.
    """
    parts: list[tuple] = []
    rows = tokens = 0

    def out():
        uid, train, ctx, tok, row, key, null = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        return uid, train, ctx, tok, row, np.stack([key, null])

    for batch in batches:
        uid, train = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        key, null = np.asarray(batch.column(3).fill_null(0)), np.asarray(batch.column(3).is_null()).astype(np.int64)
        for a, b, w in word_runs(batch.column(2), lower=True):
            tok = np.insert(w.hashes(), w.first[1:], END)
            size = np.diff(w.first) + 1
            ctx = np.append(BEGIN, tok[:-1])
            ctx[np.cumsum(size)[:-1]] = BEGIN
            parts.append((uid[a:b], train[a:b], ctx, tok, rows + np.repeat(np.arange(b - a), size), key[a:b], null[a:b]))
            rows, tokens = rows + b - a, tokens + len(tok)
            if tokens >= GATHER:
                yield out()
                rows = tokens = 0
    if parts:
        yield out()


class Heavy:
    """The most frequent words: their codes, and arrays of model values by code (one more row as the beginning has a code as a context)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, p: np.ndarray):
        order = np.argsort(words)
        self.words, self.rank, self.n = words[order], order.astype(np.int64), len(words)  # code: the place in order of frequency
        self.c, self.p = counts.astype(float), p

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Small numbers for heavy words, marked hashes for others."""
        if not len(self.words):
            return h | LIGHT
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.rank[at].astype(U64), h | LIGHT)

    def contexts(self, h: np.ndarray) -> np.ndarray:
        return np.where(h == BEGIN, U64(self.n), self.codes(h))


def dealt(place: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, which rows, in their order) of the partitions that have any."""
    part = (place % U64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for k in range(parts):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


# -- counting ---------------------------------------------------------------------------


def count_words(texts: DataFrame, parts: int) -> DataFrame:
    """(w, c): training counts of all tokens, by hash; w = 0 holds the number of training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _uid, train, _ctx, tok, row, _key in token_runs(batches):
            w, n = np.unique(tok[train[row]], return_counts=True)
            w, n = np.append(w, U64(0)), np.append(n, train.sum())
            part = (w % U64(parts)).astype(np.int64)
            order = np.lexsort((w, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(k, pack(w[o], True), pack(n[o])) for k in range(parts) if len(o := order[cuts[k] : cuts[k + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["part", "w", "n"])

    def add(table: pa.Table) -> pa.Table:
        w = np.concatenate([unpack(x, True) for x in table.column("w").to_pylist()])
        n = np.concatenate([unpack(x) for x in table.column("n").to_pylist()])
        (w,), n = counted((w,), n)
        return pa.table({"part": pa.array(np.full(len(w), table.column("part")[0].as_py()), pa.int32()), "w": pa.array(w.view(np.int64)), "c": pa.array(n.astype(np.int64))})

    return texts.mapInArrow(run, "part int, w binary, n binary").groupBy("part").applyInArrow(add, "part int, w bigint, c bigint")


#: Kinds of bigrams: of two heavy words (by one key), of a light word (with any context), of a light context (with any word).
BOTH, WORD, CONTEXT = 0, 1, 2
#: Kinds of other rows of `count_pairs`: bigrams seen r times, what a context's bigrams sum up to, and frequent keys of BOTH.
TIMES, SUMS_OF, OFTEN = 3, 4, 5
SEEN = [f"r{r}" for r in range(1, GT + 1)]
PAIR_ROWS = f"part int, kind int, a binary, b binary, n binary, ctx bigint, {', '.join(f'{r} bigint' for r in SEEN)}, c bigint, p1 double"


def find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``q`` its place among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return at, keys[at] == q


def count_pairs(texts: DataFrame, heavy, uni: DataFrame, parts: int, unigram: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Bigrams by partition and kind, their words' codes and counts packed; and rows of the other kinds.

    ``uni``: (part, code, c) of the light words; ``unigram``: probabilities from counts.
    """
    least = MIN_BIGRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = heavy.value
        for _uid, train, ctx, tok, row, _key in token_runs(batches):
            use = train[row]
            c, w = h.contexts(ctx[use]), h.codes(tok[use])
            hw, hc = w < U64(h.n), c <= U64(h.n)
            key, n = np.unique(c[hw & hc] << CODE_BITS | w[hw & hc], return_counts=True)
            sent = [(BOTH, mix(key), (key,), n)]
            for kind, x, y, light in ((WORD, w, c, ~hw), (CONTEXT, c, w, ~hc)):
                keys, n = counted((x[light], y[light]), np.ones(int(light.sum()), np.int64))
                sent.append((kind, keys[0], keys, n))
            for kind, place, keys, n in sent:
                for k, o in dealt(place, parts):
                    cells = [pack(keys[0][o], True), pack(keys[1][o]) if kind else b"", pack(n[o])]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], names=["part", "kind", "a", "b", "n"])

    def add(sent: pa.Table, words: pa.Table) -> pa.Table:
        h = heavy.value
        code, count = (words.column(x).to_numpy() for x in ("code", "c"))
        code = np.ascontiguousarray(code).view(U64)
        order = np.argsort(code)
        code, p_light = code[order], unigram(count[order])
        kinds = sent.column("kind").to_numpy()
        part = sent.column("part")[0].as_py() if sent.num_rows else 0
        out: list[dict] = []
        ctx, seen, p1 = [], [], []
        for kind in (BOTH, WORD, CONTEXT):
            which = np.flatnonzero(kinds == kind)
            if not len(which):
                continue
            cells = [[sent.column(x)[int(i)].as_py() for i in which] for x in ("a", "b", "n")]
            keys = [np.concatenate([unpack(x, True) for x in cells[0]])]
            if kind:
                keys.append(np.concatenate([unpack(x) for x in cells[1]]))
            keys, n = counted(tuple(keys), np.concatenate([unpack(x) for x in cells[2]]).astype(np.int64))
            c, w = (keys[0] >> CODE_BITS, keys[0] & ((U64(1) << CODE_BITS) - U64(1))) if kind == BOTH else keys[:: -1 if kind == WORD else 1]
            own = w < U64(h.n) if kind == CONTEXT else np.ones(len(w), bool)  # a light word's bigram counts where the word is
            times = np.bincount(np.minimum(n[own], GT + 2), minlength=GT + 3)[1 : GT + 2]
            out += [{"part": part, "kind": TIMES, "ctx": r, "c": int(x)} for r, x in enumerate(times, 1)]
            kept = n >= least
            keys, own = [x[kept] for x in keys], own[kept]
            c, w, n = c[kept], w[kept], n[kept]
            out.append({"part": part, "kind": kind, "a": pack(keys[0], True), "b": pack(keys[1]) if kind else b"", "n": pack(n)})
            if kind == BOTH:
                top = np.argsort(-n, kind="stable")[:HEAVY]
                often = pa.table({"part": pa.array(np.full(len(top), part), pa.int32()), "kind": pa.array(np.full(len(top), OFTEN), pa.int32()), "ctx": pa.array(keys[0][top].view(np.int64)), "c": pa.array(n[top])})
            ctx.append(c[own])
            seen.append(n[own])
            p1.append(p_light[find(code, w)[0]] if kind == WORD else h.p[w[own].astype(np.int64)])
        schema = pa.schema([(x, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[t]) for x, t in (col.split(" ") for col in PAIR_ROWS.split(", "))])
        tables = [pa.Table.from_pylist(out, schema)]
        if ctx:
            names, of = np.unique(np.concatenate(ctx), return_inverse=True)
            n = np.concatenate(seen)
            add_up = lambda x, at: np.bincount(of[at], x, len(names))
            cols = {"part": np.full(len(names), part, np.int32), "kind": np.full(len(names), SUMS_OF, np.int32), "ctx": names.view(np.int64)}
            cols |= {x: add_up(None, n == r) for r, x in enumerate(SEEN, 1)} | {"c": add_up(n[n > GT], n > GT).astype(np.int64), "p1": add_up(np.concatenate(p1), slice(None))}
            tables.append(pa.table({x: pa.array(v) for x, v in cols.items()}))
        if BOTH in kinds:
            tables.append(often)
        tables = [pa.table([t.column(f.name) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema], schema=schema) for t in tables]
        return pa.concat_tables(tables)

    sent = texts.mapInArrow(run, "part int, kind int, a binary, b binary, n binary")
    return sent.groupBy("part").cogroup(uni.groupBy("part")).applyInArrow(add, PAIR_ROWS)


def discounts(times: dict[int, int]) -> list[float]:
    """Katz's discount of counts 0 to GT (index 0 unused) from the numbers of items seen r times.

    A discount that the estimate can't give (too few items, or not in (0, 1]) is 1 - 0.5 / r.
    """
    n = [0, *(times.get(r, 0) for r in range(1, GT + 2))]
    out = [0.0]
    common = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT + 1):
        d = 0.0
        if n[r] and common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


def discounted(c, table: list[float]):
    """A count column after discounting."""
    d = F.when(c > GT, F.lit(1.0))
    for r in range(1, GT + 1):
        d = d.when(c == r, F.lit(table[r]))
    return d * c


# -- the model ------------------------------------------------------------------------------


class Model:
    """The sizes of the model, its heavy rows and its stored tables of the others.

    ``words``: (part, code, c, log_p, log_alpha, off) of every word that isn't heavy, off = - log of(ctx) - log alpha(ctx);
    ``pairs``: the kept bigrams, packed, by partition and kind. Logarithms to base 10.
    """

    def __init__(self, texts: DataFrame):
        spark = texts.sparkSession
        total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        self.parts = parts = max(1, math.ceil(total / 6 / PART_ROWS))
        counts = stored(count_words(texts, self.parts), "katz-words")
        words = counts.filter((F.col("w") != 0) & (F.col("c") > 0))
        size = words.agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).first()
        self.tokens, self.types = size.tokens or 0, size.types
        rows = (counts.filter("w = 0").agg(F.sum("c")).first() or [0])[0] or 0
        d1 = discounts({r.c: r.n for r in words.filter(F.col("c") <= GT + 1).groupBy("c").agg(F.count("*").alias("n")).collect()})
        # the unigrams and the unknown word; one count more than there is leaves it some mass at any rate
        n = float(self.tokens + 1)
        shares = np.array([*d1, 1.0])

        def unigram(c: np.ndarray) -> np.ndarray:
            return shares[np.minimum(c, GT + 1)] * c / n

        top = words.orderBy(F.desc("c"), "w").limit(HEAVY).toArrow()  # a fixed number of rows
        c = np.asarray(top.column("c"))
        heavy = Heavy(np.asarray(top.column("w")).view(U64), c, unigram(c))
        shared = spark.sparkContext.broadcast(heavy)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = shared.value.codes(np.ascontiguousarray(np.asarray(batch.column(0))).view(U64))
                yield pa.RecordBatch.from_arrays([pa.array((w % U64(parts)).astype(np.int32)), pa.array(w.view(np.int64)), batch.column(1)], names=["part", "code", "c"])

        uni = stored(words.select("w", "c").mapInArrow(code, "part int, code bigint, c bigint").withColumn("p", discounted(F.col("c"), d1) / n), "katz-unigrams")
        self.p_unknown = 1.0 - (uni.agg(F.sum("p")).first()[0] or 0.0)
        made = stored(count_pairs(texts, shared, uni.filter("code < 0").select("part", "code", "c"), self.parts, unigram), "katz-pairs")
        self.d2 = discounts({r.ctx: r.c for r in made.filter(F.col("kind") == TIMES).groupBy("ctx").agg(F.sum("c").alias("c")).collect()})

        sums = made.filter(F.col("kind") == SUMS_OF).groupBy(F.col("ctx").alias("code")).agg(*(F.sum(x).alias(x) for x in (*SEEN, "c", "p1")))
        mass = sum((F.col(x) * (self.d2[r] * r) for r, x in enumerate(SEEN, 1)), F.col("c").cast("double"))
        sums = sums.select("code", mass.alias("mass"), (1 - F.col("p1")).alias("rest"))
        every = uni.unionByName(spark.createDataFrame([(0, heavy.n, rows, None)], uni.schema))
        # one count more than there is leaves a context some mass that no discount did
        of = F.when(F.col("mass") >= F.col("c") * (1 - RESERVE), F.col("c") + 1).otherwise(F.col("c"))
        log_alpha = F.log10((1 - F.col("mass") / of) / F.col("rest"))
        words = every.join(sums, "code", "left").select("part", "code", "c", F.log10("p").alias("log_p"), F.coalesce(log_alpha, F.lit(0.0)).alias("log_alpha"), F.coalesce(-F.log10(of) - log_alpha, F.lit(0.0)).alias("off"))
        words = stored(words, "katz-model")
        few = words.filter("code >= 0").toArrow()  # the heavy ones and the beginning
        at = np.asarray(few.column("code"))
        self.log_p, self.log_alpha, self.off = (np.zeros(heavy.n + 1) for _ in range(3))
        for x, column in ((self.log_p, "log_p"), (self.log_alpha, "log_alpha"), (self.off, "off")):
            x[at] = few.column(column).to_numpy()
        self.words, self.heavy = words.filter("code < 0"), heavy
        self.pairs = made.filter(F.col("kind") <= CONTEXT).select("part", "kind", "a", "b", "n")
        top = made.filter(F.col("kind") == OFTEN).select("ctx", "c").orderBy(F.desc("c"), "ctx").limit(HEAVY).toArrow()
        key, c = (np.asarray(top.column(x)) for x in ("ctx", "c"))
        order = np.argsort(key)
        self.pair = key[order].view(U64)
        self.pair_gain = self.gain(self.pair, c[order])

    def log_mass(self, c: np.ndarray) -> np.ndarray:
        """Of counts after discounting."""
        return np.log10(np.array([1.0, *self.d2[1:], 1.0])[np.minimum(c, GT + 1)] * np.maximum(c, 1))

    def gain(self, key: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What kept bigrams of heavy words have over backing off."""
        word = (key & ((U64(1) << CODE_BITS) - U64(1))).astype(np.int64)
        return self.log_mass(c) - self.log_p[word] + self.off[(key >> CODE_BITS).astype(np.int64)]


SUMS = "uid bigint, key bigint, train boolean, tokens bigint, known bigint, base double, score double"


def evaluate(texts: DataFrame, model: Model) -> DataFrame:
    """(uid, key, train, tokens, known, base, score): sums over the tokens of each row; uid names the rows."""
    spark, parts = texts.sparkSession, model.parts
    words, pairs = model.words, model.pairs
    light = copy.copy(model)
    light.words = light.pairs = None
    shared = spark.sparkContext.broadcast(light)  # HEAVY rows twice: fixed sizes
    tokens, types, p_unknown = model.tokens, model.types, model.p_unknown
    row_mask = (U64(1) << ROW_BITS) - U64(1)

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (tokens + types + 1))

    def rows(kind: int, part: int, *cols: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], names=["kind", "part", "a", "b", "row", "n", "uid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        heavy = m.heavy
        for uid, train, ctx, tok, row, key in token_runs(batches):
            n_rows, ids = len(uid), pack(uid, True)
            w, c = heavy.codes(tok), heavy.contexts(ctx)
            hw, hc = w < U64(heavy.n), c <= U64(heavy.n)
            # what the heavy words give, where the text is
            add = lambda at, x: np.bincount(at, x, n_rows)
            iw = w[hw].astype(np.int64)
            score = add(row[hw], m.log_p[iw]) + add(row[hc], m.log_alpha[c[hc].astype(np.int64)])
            both = hw & hc
            cell, n = np.unique((c[both] << CODE_BITS | w[both]) << ROW_BITS | row[both].astype(U64), return_counts=True)
            pair, at_row = cell >> ROW_BITS, (cell & row_mask).astype(np.int64)
            at, top = find(m.pair, pair)
            score += add(at_row[top], m.pair_gain[at[top]] * n[top])
            direct = np.stack([add(row, None), add(row[hw], heavy.c[iw] > 0), add(row[hw], base(heavy.c[iw])), score])
            yield rows(-1, int(uid[0]) % parts, direct.tobytes(), key.tobytes(), train.astype(np.int64).tobytes(), b"", ids)
            sent = [(BOTH, mix(pair[~top]), (pair[~top], None, at_row[~top]), n[~top])]
            for kind, x, y, use in ((WORD, w, c, ~hw), (CONTEXT, c, w, ~hc)):
                keys, n = counted((x[use], y[use], row[use]), np.ones(int(use.sum()), np.int64))
                sent.append((kind, keys[0], keys, n))
            for kind, place, (a, b, r), n in sent:
                for k, o in dealt(place, parts):
                    yield rows(kind, k, pack(a[o], True), pack(b[o]) if kind else b"", pack(r[o]), pack(n[o]), ids)

    sent = texts.mapInArrow(run, "kind int, part int, a binary, b binary, row binary, n binary, uid binary")
    model_rows = words.unionByName(pairs, allowMissingColumns=True)

    def meet(blobs: pa.Table, model_: pa.Table) -> pa.Table:
        m = shared.value
        n_heavy = U64(m.heavy.n)
        word = model_.filter(pc.is_null(model_.column("kind")))
        code = np.ascontiguousarray(word.column("code").to_numpy()).view(U64)
        order = np.argsort(code)
        code = code[order]
        count, log_p, log_alpha, off = (word.column(x).to_numpy()[order] for x in ("c", "log_p", "log_alpha", "off"))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros(0, U64), np.zeros(0, np.int64)) for k in (BOTH, WORD, CONTEXT)}
        for r in model_.filter(pc.is_valid(model_.column("kind"))).select(["kind", "a", "b", "n"]).to_pylist():  # one of each kind
            pair, c = unpack(r["a"], True), unpack(r["n"]).astype(np.int64)
            if r["kind"]:
                pair = pair_hash(pair, unpack(r["b"]))
                order = np.argsort(pair)
                pair, c = pair[order], c[order]
            held[r["kind"]] = pair, c

        # a gathering's rows stay together: its sums of this part are one row, of the documents that have any
        sums: dict[int, np.ndarray] = {}
        names: dict[int, tuple[bytes, bytes]] = {}
        ids: dict[int, bytes] = {}
        for r in range(blobs.num_rows):
            kind, va, vb, vr, vn, vu = (blobs.column(k)[r].as_py() for k in ("kind", "a", "b", "row", "n", "uid"))
            uid = unpack(vu, True).view(np.int64)
            first = int(uid[0])
            out = sums.setdefault(first, np.zeros((4, len(uid))))
            ids[first] = vu
            if kind < 0:
                out += np.frombuffer(va).reshape(4, -1)
                names[first] = (vb, vr)
                continue
            row, n, a = unpack(vr).astype(np.int64), unpack(vn).astype(np.float64), unpack(va, True)
            add = lambda x, n=n, row=row, size=len(uid): np.bincount(row, x * n, size)
            known, times = held[kind]
            if kind == BOTH:
                at, kept = find(known, a)
                out[3] += np.bincount(row[kept], m.gain(a[kept], times[at[kept]]) * n[kept], len(uid))
                continue
            b = unpack(vb)
            at, kept = find(known, pair_hash(a, b))
            mass = m.log_mass(times[at[kept]])
            which, ok = find(code, a)
            which = which[ok]
            if kind == WORD:
                c, p, more = np.zeros(len(a), np.int64), np.full(len(a), math.log10(p_unknown)), np.zeros(len(a))
                c[ok], p[ok] = count[which], log_p[which]
                p[kept] = mass
                near = kept & (b <= n_heavy)
                more[near] = m.off[b[near].astype(np.int64)]
                out[1] += add(ok)
                out[2] += add(base(c))
                out[3] += add(p + more)
            else:
                more, alpha = np.zeros(len(a)), np.zeros(len(a))
                alpha[ok], more[ok] = log_alpha[which], off[which]
                more[~kept] = 0.0
                near = b[kept] < n_heavy
                more[np.flatnonzero(kept)[near]] += mass[near] - m.log_p[b[kept][near].astype(np.int64)]
                out[3] += add(alpha + more)
        cols: list[list] = [[], [], [], [], [], []]
        for first, out in sums.items():
            at = np.flatnonzero(out.any(axis=0))
            for c, x in zip(cols, (first, ids[first], at.astype(np.int32).tobytes(), out[:, at].tobytes(), *names.get(first, (b"", b""))), strict=True):
                c.append(x)
        return pa.table({"first": pa.array(cols[0], pa.int64()), **{k: pa.array(c, pa.binary()) for k, c in zip(("uid", "at", "sums", "key", "train"), cols[1:], strict=True)}})

    def add(table_: pa.Table) -> pa.Table:
        """All parts' sums of one gathering, a row a document."""
        uid = unpack(table_.column("uid")[0].as_py(), True).view(np.int64)
        total = np.zeros((4, len(uid)))
        for at, part in zip(table_.column("at").to_pylist(), table_.column("sums").to_pylist(), strict=True):
            total[:, np.frombuffer(at, np.int32)] += np.frombuffer(part).reshape(4, -1)
        key, train = next((k, t) for k, t in zip(table_.column("key").to_pylist(), table_.column("train").to_pylist(), strict=True) if t)
        values, null = np.frombuffer(key, np.int64).reshape(2, -1)
        return pa.table({
            "uid": pa.array(uid),
            "key": pa.array(values, pa.int64(), mask=null.astype(bool)),
            "train": pa.array(np.frombuffer(train, np.int64).astype(bool)),
            "tokens": pa.array(np.rint(total[0]).astype(np.int64)),
            "known": pa.array(np.rint(total[1]).astype(np.int64)),
            "base": pa.array(total[2]),
            "score": pa.array(total[3]),
        })

    met = sent.groupBy("part").cogroup(model_rows.groupBy("part")).applyInArrow(meet, "first bigint, uid binary, at binary, sums binary, key binary, train binary")
    return met.groupBy("first").applyInArrow(add, SUMS)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, rest: int = 2) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), (~held_out(key, modulus, rest)).alias("train"), F.col(text).alias("text"), F.col(key).cast("bigint").alias("key"))
    model = Model(texts)
    sums = evaluate(texts, model)
    return sums.select(F.col("key").alias(key), (~F.col("train")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")
