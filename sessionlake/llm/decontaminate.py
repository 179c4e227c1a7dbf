"""Operator 10: benchmark passages in documents, by q-gram filtering and banded alignment.

Texts and items are normalised (A-Z lowered, white space runs one space, trimmed). A document
holds a passage of an item if `WINDOW` characters of the item (all of a shorter one)
align with a region of the document with at most `EDITS` of their number in edits. By the q-gram
lemma such a region shares at least w + 1 - q (e + 1) q-grams with the window, all on diagonals (place
in the document less place in the item) at most e from the first. So shared q-grams are counted in
overlapping bands of diagonals. In runs that meet the bound, every window that holds enough of the
q-grams near a run's first diagonal is aligned with both ends free. Items too short for the bound
(under 18 characters) are found if they stand there unchanged.

Every document is read once for each block of items. Blocks hold about `BLOCK_CHARS`
characters of items, so what is sent to the tasks is bounded however many items there are.

Defined results: null and empty texts hold nothing. Items that are null or empty once normalised
are never found. Documents with a null key are left out. Rows that repeat a key, on either side,
are reported as one, by the best passage of any of their texts. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.line_dedup import CHAR_KEYS
from sessionlake.llm.text import U64, mix, powers, runs, utf8

Q, WINDOW, EDITS, MIN_CHARS = 9, 80, 0.075, 1
BLOCK_CHARS = 4_000_000
COLUMNS = ["doc_id", "item_id", "n_edits", "item_start", "doc_start", "doc_end"]
#: Bits of the first look-up of a q-gram.
SIEVE = 22


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of normalised documents, where each document begins, and each one's place in its text."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    place = np.arange(len(chars)) - np.repeat(first[:-1], np.diff(first))
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    chars = np.where(space, np.uint32(32), chars)
    for leading in (True, False):
        bounds = np.zeros(len(chars) + 1, bool)
        bounds[first] = True
        drop = space.copy()
        if leading:
            drop[1:] &= space[:-1] | bounds[1:-1]
        else:
            drop[:-1] &= bounds[1:-1]
        first = np.append(0, np.cumsum(~drop))[first]
        chars, space, place = chars[~drop], space[~drop], place[~drop]
    upper = (chars >= 65) & (chars <= 90)
    return np.where(upper, chars + np.uint32(32), chars), first, place


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash for the q-gram that begins at each character (of all but the last q - 1)."""
    if len(chars) < q:
        return np.zeros(0, U64)
    up, down = powers(len(chars) + 1)
    sums = np.append(U64(0), np.cumsum(CHAR_KEYS[chars] * up[:-1]))
    return mix((sums[q:] - sums[:-q]) * down[: len(chars) - q + 1])


class Items:
    """The q-grams of a block of items, and their windows' bounds."""

    def __init__(self, ids: list[int], texts: list[str]):
        chars, first, _ = normalised(*utf8(pa.array(texts, pa.string())))
        some = np.diff(first) >= MIN_CHARS
        self.ids = np.array(ids, np.int64)[some]
        self.chars = [chars[first[i] : first[i + 1]] for i in np.flatnonzero(some)]
        size = np.array([len(c) for c in self.chars], np.int64)
        self.window = np.minimum(size, WINDOW)
        self.edits = np.floor(EDITS * self.window).astype(np.int64)
        self.edits[self.window + 1 < Q * (self.edits + 1) + 1] = 0
        self.least = self.window + 1 - Q * (self.edits + 1)
        self.most_edits = int(self.edits.max(initial=0))
        # items shorter than a q-gram, by length: their hashes in order, and the items
        self.short = []
        for n in np.unique(size[size < Q]):
            which = np.flatnonzero(size == n)
            h = np.array([grams(self.chars[i], int(n))[0] for i in which], U64)
            order = np.argsort(h, kind="stable")
            self.short.append((int(n), h[order], which[order]))
        h = [grams(c) for c in self.chars]
        n = np.array([len(x) for x in h], np.int64)
        hashes = np.concatenate(h) if h else np.zeros(0, U64)
        item = np.repeat(np.arange(len(h)), n)
        at = np.concatenate([np.arange(k) for k in n]) if h else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], item[order], at[order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(self.hashes >> U64(64 - SIEVE)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of shared q-grams, and for each the entry of the table that it shares."""
        p = np.flatnonzero(self.sieve[(h >> U64(64 - SIEVE)).astype(np.int64)])
        least = int(self.least[self.window >= Q].min(initial=WINDOW))
        # a place needs enough others around it before its table entries matter
        around = np.searchsorted(p, p + near) - np.searchsorted(p, p - near)
        p = p[around >= least]
        left, right = np.searchsorted(self.hashes, h[p], "left"), np.searchsorted(self.hashes, h[p], "right")
        n = right - left
        place = np.repeat(p, n)
        entry = np.arange(n.sum()) + np.repeat(left - (np.cumsum(n) - n), n)
        return place, entry


def align_parts(windows: list[np.ndarray], regions: list[np.ndarray], before: np.ndarray, e: int, anywhere: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: fewest edits to a part of its region inside a band of diagonals, and where the part begins and ends.

    A region has ``before`` characters (up to e) in front of the band's middle diagonal. The part begins ``anywhere`` in the
    band, or with the region. All alignments advance together, a row of every band at a time.
    """
    n, one = len(windows), 2 * e + 2  # a cell holds edits * one + where the part begins
    rows = np.array([len(w) for w in windows])
    far = 1 << 40
    a = np.zeros((n, rows.max()), np.int64)
    b = np.full((n, rows.max() + 2 * e + 1), -1, np.int64)  # -1 equals nothing
    low = (e - before)[:, None]
    for i, (w, r) in enumerate(zip(windows, regions, strict=True)):
        a[i, : len(w)] = w
        b[i, low[i, 0] : low[i, 0] + len(r)] = r[: b.shape[1] - low[i, 0]]
    high = low + np.array([len(r) for r in regions])[:, None]
    k = np.arange(2 * e + 1)[None]
    outside = lambda i: (i + k < low) | (i + k > high)
    d = np.where(outside(0) | (k != low if not anywhere else False), far, k)
    d = np.where(outside(0), far, np.minimum.accumulate(d - k * one, axis=1) + k * one)
    best, begin, end = np.full(n, far), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(1, rows.max() + 1):
        same = a[:, i - 1 : i] == b[:, i - 1 : i + 2 * e]
        new = np.minimum(d + ~same * one, np.append(d[:, 1:], np.full((n, 1), far), axis=1) + one)
        out = outside(i)
        new = np.where(out, far, new)
        d = np.minimum.accumulate(new - k * one, axis=1) + k * one  # insertions along the row
        d = np.where(out, far, d)
        done = rows == i
        if done.any():
            at = d.argmin(axis=1)
            cell = d[np.arange(n), at]
            best, begin, end = np.where(done, cell // one, best), np.where(done, cell % one - low[:, 0], begin), np.where(done, i + at - low[:, 0], end)
    return best, begin, end


def align(windows: list[np.ndarray], regions: list[np.ndarray], edits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window: fewest edits to a beginning of its region, inside a band of diagonals, and its length."""
    best, _, end = align_parts(windows, regions, np.zeros(len(windows), np.int64), int(edits.max()), False)
    return best, end


def find_short(chars: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int, int]]:
    """As `find`, of the items shorter than a q-gram: their first places."""
    for n, hashes, which in items.short:
        h = grams(chars, n)
        left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        place = np.flatnonzero(right > left)
        doc = np.searchsorted(first, place, side="right") - 1
        inside = place + n <= first[doc + 1]
        place, doc = place[inside], doc[inside]
        if not len(place):
            continue
        _, once = np.unique(np.stack([doc.astype(U64), h[place]]), axis=1, return_index=True)
        for p, d in zip(place[once], doc[once], strict=True):
            for x in range(left[p], right[p]):
                yield int(d), int(which[x]), 0, 0, int(p), int(p) + n


def find(chars: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item, edits, item place, document place, end) of the best passage of each pair."""
    yield from find_short(chars, first, items)
    h = grams(chars)
    e = items.most_edits
    place, entry = items.hits(h, WINDOW + e)
    doc = np.searchsorted(first, place, side="right") - 1
    inside = place + Q <= first[doc + 1]
    place, entry, doc = place[inside], entry[inside], doc[inside]
    if not len(place):
        return
    item, at = items.item[entry], items.at[entry]
    diagonal = place - at
    low = int(diagonal.min())
    passed = np.zeros(len(place), bool)
    for half in (0, 1):  # bands of 2 (e + 1) diagonals that begin every e + 1
        band = (diagonal - low + half * (e + 1)) // (2 * (e + 1))
        order = np.lexsort((place, band, item, doc))
        group = np.flatnonzero(np.append(True, (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0) | (np.diff(band[order]) != 0)))
        last = np.repeat(np.append(group[1:], len(order)), np.diff(np.append(group, len(order))))
        need = items.least[item[order]]
        at_least = np.arange(len(order)) + need - 1
        ok = at_least < last
        reach = items.window[item[order]] - Q + items.edits[item[order]]
        ok &= place[order[np.minimum(at_least, len(order) - 1)]] - place[order] <= reach
        passed[order[ok]] = True
    if not passed.any():
        return
    pair = doc.astype(np.int64) * len(items.ids) + item
    held = np.flatnonzero(np.isin(pair, pair[passed]))
    order = held[np.lexsort((diagonal[held], pair[held]))]
    cuts = np.flatnonzero(np.append(True, np.diff(pair[order]) != 0))
    for i, j in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        best = best_passage(chars, first[doc[order[i]]], first[doc[order[i]] + 1], items, int(item[order[i]]), at[order[i:j]], diagonal[order[i:j]], passed[order[i:j]])
        if best:
            yield int(doc[order[i]]), int(item[order[i]]), *best


def best_passage(chars: np.ndarray, lo: int, hi: int, items: Items, k: int, at: np.ndarray, diagonal: np.ndarray, passed: np.ndarray) -> tuple[int, int, int, int] | None:
    """(edits, item place, document place, end) of item ``k`` in the document [lo, hi), by their shared q-grams in order of the diagonal."""
    w, budget, text = int(items.window[k]), int(items.edits[k]), items.chars[k]
    windows = np.arange(len(text) - w + 1)
    best = None
    todo: list[np.ndarray] = []  # (diagonal, window) to align
    starts = np.unique(diagonal[passed])
    for n, middle in enumerate(starts, 1):
        a, b = np.searchsorted(diagonal, middle - budget), np.searchsorted(diagonal, middle + budget, "right")
        shared = np.unique(at[a:b])
        enough = windows[np.searchsorted(shared, windows + w - Q, "right") - np.searchsorted(shared, windows) >= items.least[k]]
        enough = enough[(enough + middle >= lo - budget) & (enough + middle + w <= hi + budget)]
        todo.append(np.stack([np.full(len(enough), middle), enough]))
        if n < len(starts) and sum(t.shape[1] for t in todo) < 512:
            continue
        both = np.concatenate(todo, axis=1)
        todo = []
        for s in range(0, both.shape[1], 512):
            place, window = both[:, s : s + 512].sum(axis=0), both[1, s : s + 512]
            left = np.maximum(lo, place - budget)
            # in front of the document: the part begins later in the band
            regions = [chars[x : max(x, min(hi, p + w + budget))] for x, p in zip(left, place, strict=True)]
            cost, begin, end = align_parts([text[x : x + w] for x in window], regions, place - left, budget, True)
            c = int(cost.argmin())
            if cost[c] <= budget and (best is None or cost[c] < best[0]):
                best = (int(cost[c]), int(window[c]), int(left[c] + begin[c]), int(left[c] + end[c]))
            if best and best[0] == 0:
                return best
    return best


def passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per pair of document and item: doc_id, item_id, n_edits, item_start, doc_start, doc_end.

    The places are code points: of the normalised item, and of the document's text as it is.
    """
    items = benchmark.filter(F.col(item_key).isNotNull() & (F.length(item_text) >= MIN_CHARS)).select(F.col(item_key).cast("bigint").alias("id"), F.col(item_text).alias("text")).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    rows = docs.filter(F.col(key).isNotNull() & (F.length(text) >= 1)).select(F.col(key).cast("bigint"), text)
    spark = docs.sparkSession
    kinds = ", ".join(f"{c} {'bigint' if c.endswith('_id') else 'int'}" for c in COLUMNS)
    found = spark.createDataFrame([], kinds)
    for n in range(blocks if size else 0):
        few = sorted(items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).collect())  # about BLOCK_CHARS characters
        shared = spark.sparkContext.broadcast(Items([r.id for r in few], [r.text for r in few]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                keys = np.asarray(batch.column(0))
                data, offsets = utf8(batch.column(1))
                for a, b in runs(offsets, 1 << 20):
                    chars, first, place = normalised(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    out = [(keys[a + d], block.ids[k], e, s, place[x], place[y - 1] + 1) for d, k, e, s, x, y in find(chars, first, block)]
                    if out:
                        cols = [np.array(c) for c in zip(*out, strict=True)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c.astype(np.int32)) for c in cols[2:])], names=COLUMNS)

        found = found.unionByName(rows.mapInArrow(run, kinds))
    best = F.min(F.struct("n_edits", "doc_start", "doc_end", "item_start")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_edits", "b.item_start", "b.doc_start", "b.doc_end")
