"""Operator 6: passages that repeat across documents, by compressed FM-indexes.

A window is `WINDOW` consecutive words. Equal windows hold the same smallest hash of `GRAM`
consecutive words, so each document is cut into segments, runs of windows that share it, and each
such key is one unit of work: only windows with the same key can be equal. Segments with the same
words are one class, counted for its smallest document (so copies cost nothing but a row). Keys
whose classes begin in several documents are dealt to shards of about `SHARD_WORDS` words; each
shard builds an FM-index of its classes and streams them through it by backward search, which
gives for each window the smallest document that holds it. A key with more than `HOT_WORDS` words of
classes would make a shard too large; its windows are compared one by one as groups instead.

A word is removed if a window over it also starts in a document with a smaller id. Windows are judged
on the input. Words are compared by 64-bit hashes of their bytes.

Defined results: null, empty and shorter texts have no window and lose nothing. A null key is
no document: the row keeps all of its words and takes none from others. Rows that repeat key and text are one
document; rows that repeat a key with another text are judged by the key and cut each by its own windows
(`place`, a hash of the text, tells them apart). Very long texts are cut into segments like any other. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.fm_index import FMIndex
from sessionlake.llm.linking import small_side, stored
from sessionlake.llm.text import BASE, U64, mix, powers, shingles, word_runs

WINDOW, GRAM = 50, 8
#: Windows of a segment at most, so that no text makes a long one.
SEGMENT = 64
SHARD_WORDS = 1_000_000
HOT_WORDS = 250_000


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    length = 1
    y = x
    while 2 * length <= k:
        y = np.minimum(y[: len(y) - length], y[length:])
        length *= 2
    m = len(x) - k + 1
    return np.minimum(y[:m], y[k - length : k - length + m]) if m > 0 else y[:0]


def sequence_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the word hashes in each range."""
    up, down = powers(len(h) + 1)
    sums = np.append(U64(0), np.cumsum(h * up[:-1]))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * BASE)


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, seg, doc_id, place, start, windows): the segments of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for a, b, w in word_runs(batch.column(1), lower=False):
                h = w.hashes()
                least = sliding_min(shingles(h, GRAM), WINDOW - GRAM + 1)
                doc = np.repeat(np.arange(b - a), np.diff(w.first))
                at = np.flatnonzero(doc[: len(least)] == doc[WINDOW - 1 :][: len(least)])
                if not len(at):
                    continue
                least, doc = least[at], doc[at]
                new = np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))
                first = np.flatnonzero(new)
                inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                first = np.flatnonzero(new | (inside % SEGMENT == 0))
                windows = np.diff(np.append(first, len(at)))
                begin = at[first]
                seg = sequence_hash(h, begin, begin + windows + WINDOW - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[first].view(np.int64)), pa.array(seg.view(np.int64)), pa.array(keys[a + doc[first]]), pa.array(places[a + doc[first]]), pa.array((begin - w.first[doc[first]]).astype(np.int32)), pa.array(windows.astype(np.int32))],
                    names=["gram", "seg", "doc_id", "place", "start", "windows"],
                )

    return docs.select("key", "text", "place").mapInArrow(run, "gram bigint, seg bigint, doc_id bigint, place bigint, start int, windows int")


def with_words(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``classes`` (gram, seg, doc_id, place, start, windows, shard) with their words' hashes, read from their documents."""
    asked = classes.groupBy(F.col("doc_id").alias("key"), "place").agg(F.collect_list(F.struct("gram", "seg", "start", "windows", "shard")).alias("asked"))
    joined = docs.join(small_side(asked, n), ["key", "place"]).select("key", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys = batch.column(2), np.asarray(batch.column(0))
            for a, b, w in word_runs(batch.column(1), lower=False):
                h = w.hashes()
                for i in range(b - a):
                    rows = lists[a + i].values
                    cols = {c: np.asarray(rows.field(c)) for c in ("gram", "seg", "start", "windows", "shard")}
                    own = h[w.first[i] : w.first[i + 1]]
                    words = [own[s : s + k + WINDOW - 1].tobytes() for s, k in zip(cols["start"], cols["windows"], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols["shard"]), pa.array(cols["gram"]), pa.array(cols["seg"]), pa.array(np.full(len(words), keys[a + i])), pa.array(words, pa.binary())],
                        names=["shard", "gram", "seg", "doc_id", "words"],
                    )

    return joined.mapInArrow(run, "shard bigint, gram bigint, seg bigint, doc_id bigint, words binary")


FOUND = "gram bigint, seg bigint, first int, windows int"


def intervals(earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and lengths of the runs of true values."""
    edge = np.diff(np.concatenate([[0], earlier.astype(np.int8), [0]]))
    begin = np.flatnonzero(edge == 1)
    return begin, np.flatnonzero(edge == -1) - begin


def search_shard(table: pa.Table) -> pa.Table:
    """Index the classes of a shard, stream them through, report windows of smaller documents."""
    words = [np.frombuffer(x, U64) for x in table.column("words").to_pylist()]
    doc = np.asarray(table.column("doc_id"))
    _, ids = np.unique(np.concatenate(words), return_inverse=True)
    ends = np.cumsum([len(x) for x in words])
    texts = np.split(ids + 1, ends[:-1])
    text = np.concatenate([np.append(t, 0) for t in texts])
    owner = np.repeat(doc, [len(t) + 1 for t in texts])
    index = FMIndex(text, owner, WINDOW)
    rows: list[list] = [[], [], [], []]
    gram, seg = np.asarray(table.column("gram")), np.asarray(table.column("seg"))
    for i, least in enumerate(index.least_owners(texts)):
        for first, n in zip(*intervals(least < doc[i]), strict=True):
            for c, x in zip(rows, (gram[i], seg[i], first, n), strict=True):
                c.append(int(x))
    return pa.table({"gram": pa.array(rows[0], pa.int64()), "seg": pa.array(rows[1], pa.int64()), "first": pa.array(rows[2], pa.int32()), "windows": pa.array(rows[3], pa.int32())})


def search_hot(words: DataFrame) -> DataFrame:
    """The same for keys with very many classes: each window is a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                h = np.frombuffer(batch.column("words")[r].as_py(), U64)
                at = np.arange(len(h) - WINDOW + 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sequence_hash(h, at, at + WINDOW).view(np.int64)), *(pa.array(np.full(n, batch.column(c)[r].as_py())) for c in ("gram", "seg", "doc_id")), pa.array(at.astype(np.int32))],
                    names=["window", "gram", "seg", "doc_id", "first"],
                )

    rows = stored(words.mapInArrow(run, "window bigint, gram bigint, seg bigint, doc_id bigint, first int"), "hot-windows")
    least = rows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least <> most").drop("most")
    return rows.join(least, "window").filter("least < doc_id").select("gram", "seg", "first", F.lit(1).alias("windows"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, place, gone): for each document that loses words, the ranges of words [begin, end) that go."""
    docs = docs.filter(F.col(key).isNotNull() & (F.length(text) >= 2 * WINDOW - 1)).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("place"))
    rows = stored(segments(docs, key, text), "segments")
    # a class: the same words; counted for its smallest document, at its first place there
    classes = rows.groupBy("gram", "seg", "windows").agg(F.min(F.struct("doc_id", "place", "start")).alias("at"), F.max("doc_id").alias("last"))
    classes = stored(classes.select("gram", "seg", "windows", "at.doc_id", "at.place", "at.start", "last"), "segment-classes")
    keys = classes.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.col("windows") + (WINDOW - 1)).alias("words"))
    keys = stored(keys.filter("low < high").select("gram", "words"), "segment-keys")
    size = keys.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.max("words").alias("most")).first()
    found = docs.sparkSession.createDataFrame([], FOUND)
    if size.n:
        shards = max(1, math.ceil(size.words / SHARD_WORDS))
        hot = F.col("words") > HOT_WORDS
        shard = F.when(hot, -1).otherwise(F.pmod(F.xxhash64("gram"), F.lit(shards)))
        asked = stored(classes.join(small_side(keys, size.n), "gram").select("gram", "seg", "doc_id", "place", "start", "windows", shard.cast("bigint").alias("shard")), "asked-classes")
        words = with_words(docs, asked, asked.count())
        words = stored(words, "class-words") if size.most > HOT_WORDS else words
        found = words.filter("shard >= 0").groupBy("shard").applyInArrow(search_shard, FOUND)
        if size.most > HOT_WORDS:
            found = found.unionByName(search_hot(words.filter("shard < 0")))
        found = stored(found, "found-windows")
    # ranges of words: all of a segment outside its class's smallest document, there the windows found
    copies = classes.filter("doc_id < last").select("gram", "seg", F.col("doc_id").alias("low"))
    whole = rows.join(copies, ["gram", "seg"]).filter("doc_id > low").select("doc_id", "place", "start", "windows")
    firsts = classes.select("gram", "seg", F.col("doc_id").alias("low")).join(found.withColumnRenamed("windows", "n"), ["gram", "seg"])
    part = rows.join(firsts, ["gram", "seg"]).filter("doc_id = low").select("doc_id", "place", (F.col("start") + F.col("first")).alias("start"), F.col("n").alias("windows"))
    ranges = whole.unionByName(part).select("doc_id", "place", F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (WINDOW - 1)).alias("end")).alias("r"))
    merged = ranges.groupBy("doc_id", "place").agg(F.array_sort(F.collect_set("r")).alias("gone"))  # as many as the document has segments

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ranges_ in batch.column(2).to_pylist():
                flat: list[int] = []
                for r in ranges_:
                    if flat and r["begin"] <= flat[-1]:
                        flat[-1] = max(flat[-1], r["end"])
                    else:
                        flat += [r["begin"], r["end"]]
                out.append(flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "place", "gone"])

    return merged.mapInArrow(merge, "doc_id bigint, place bigint, gone array<int>")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per document: key, n_words, n_removed, and the kept words joined by spaces (or their SHA-256)."""
    gone = stored(repeated_passages(docs, key, text), "gone-words")
    n = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("place").alias("_p"), "gone")
    rows = rows.join(small_side(gone, n), (F.col("_k").cast("bigint") == F.col("_d")) & (F.xxhash64("_t") == F.col("_p")), "left").select("_k", "_t", "gone")
    kind = rows.schema["_k"].dataType.simpleString()
    last = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for r in range(batch.num_rows):
                words = (batch.column(1)[r].as_py() or "").encode().split()  # bytes split at ASCII white space
                ranges = batch.column(2)[r].as_py() or []
                total.append(len(words))
                if ranges:
                    cuts = [0, *ranges, len(words)]
                    words = [w for a, b in zip(cuts[::2], cuts[1::2], strict=True) for w in words[a:b]]
                removed.append(total[-1] - len(words))
                joined = b" ".join(words)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", last])

    return rows.mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_removed bigint, {last} string")
