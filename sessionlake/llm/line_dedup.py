"""Operator 1: fuzzy line deduplication by MinHash.

A line is normalised (A-Z lowered, white space runs one space, trimmed) and is the set of its
8-character shingles; a shorter line is one whole shingle. Minwise values of the distinct lines
are cut into bands; lines that share a band are candidates, confirmed by exact Jaccard similarity of at least 0.75 and merged by
distributed union-find (`linking.resolve`). Of each component the first line, by document
and position, stays; all others are removed from their documents.

Recall: 14 bands of 3 values miss a pair at the threshold with probability 5e-4, one of
similarity 0.85 with 2e-6. A candidate needs 20 of 42 equal values (missed at the
threshold: 6e-5).

Defined results: lines that are empty once normalised take no part and stay. A line of fewer
than 8 characters is similar to its exact copies only, which have its id, so it needs no band.
A null text stays null, with no lines; an empty one has none either.
Documents with a null key stay as they are. Rows that repeat key and text count as one document: what
is removed from one is removed from all. Rows that repeat a key with another text are documents of their own, in
order of a hash of their texts (`place`). A document all of whose lines go has an empty text.
Ties: the least (key, place, position) stays. Very long texts and lines are read whole, a run of documents at a
time. Extra columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import linking
from sessionlake.llm.exact_dedup import fresh
from sessionlake.llm.text import BASE, U64, give_back, keep_room, minhash, mix, powers, runs, utf8

keep_room(8 << 20)  # larger arrays are those of many lines

Q, PERCENT, MIN_CHARS = 8, 75, 1
BANDS, ROWS, CUT = 14, 3, 20
VALUES = BANDS * ROWS
SEED = 1

#: Bytes of texts whose lines are read at once: their arrays fit a processor's cache.
RUN_BYTES = 1 << 18
#: A 64-bit key for every code point; A-Z take those of a-z.
CHAR_KEYS = mix(np.arange(1, 0x110001, dtype=U64))
CHAR_KEYS[65:91] = CHAR_KEYS[97:123]
NEWLINE = 10


class Lines:
    """The normalised lines of a run of documents, as ranges of code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        first = offsets if len(chars) == len(data) else np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]  # in code points
        brk = chars == NEWLINE
        other = (chars - np.uint32(9) <= 4) & ~brk  # white space that is no space
        if other.any():
            chars = np.where(other, np.uint32(32), chars)
        space = chars == 32
        for after in (True, False):  # drop spaces after a space or a break, then those before a break
            bounds = np.zeros(len(chars) + 1, bool)
            bounds[first] = True
            drop = space.copy()
            if after:
                drop[1:] &= brk[:-1] | space[:-1] | bounds[1:-1]
            else:
                drop[:-1] &= brk[1:] | bounds[1:-1]
            gone = np.flatnonzero(drop)
            if len(gone):
                first = first - np.searchsorted(gone, first)
                keep = ~drop
                chars, brk, space = chars[keep], brk[keep], space[keep]
        self.chars = chars
        at = np.flatnonzero(brk)
        doc_of_break = np.searchsorted(first, at, side="right") - 1
        n_docs = len(first) - 1
        per_doc = np.bincount(doc_of_break, minlength=n_docs) + 1
        self.doc = np.repeat(np.arange(n_docs), per_doc)
        begin = np.append(0, np.cumsum(per_doc))
        self.pos = np.arange(len(self.doc)) - begin[self.doc]
        # a document's lines start at its first character and after each of its breaks
        start = np.empty(len(self.doc), np.int64)
        start[begin[:-1]] = first[:-1]
        rest = np.ones(len(self.doc), bool)
        rest[begin[:-1]] = False
        start[rest] = at + 1
        end = np.empty(len(self.doc), np.int64)
        end[begin[1:] - 1] = first[1:]
        last = np.zeros(len(self.doc), bool)
        last[begin[1:] - 1] = True
        end[~last] = at
        self.start, self.end = start, end
        up, _down = powers(len(chars) + 1)
        self.sums = np.zeros(len(chars) + 1, U64)
        np.cumsum(CHAR_KEYS[chars] * up[:-1], out=self.sums[1:])

    def ids(self) -> np.ndarray:
        _, down = powers(len(self.sums))
        return mix((self.sums[self.end] - self.sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64) * BASE).view(np.int64)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of some lines end to end, and where each line's begin."""
        n = self.end[which] - self.start[which] - Q + 1
        first = np.append(0, np.cumsum(n))
        at = np.arange(first[-1]) + np.repeat(self.start[which] - first[:-1], n)
        _, down = powers(len(self.sums))
        return mix((self.sums[at + Q] - self.sums[at]) * down[at]), first[:-1]

    def texts(self, which: np.ndarray) -> list[bytes]:
        data = self.chars.tobytes().decode("utf-32-le").encode()
        start, end = self.start[which], self.end[which]
        if len(data) > len(self.chars):  # from code points to bytes
            at = np.append(0, np.cumsum(1 + (self.chars > 0x7F) + (self.chars > 0x7FF) + (self.chars > 0xFFFF)))
            start, end = at[start], at[end]
        return [data[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]

    def text(self, i: int) -> bytes:
        return self.chars[self.start[i] : self.end[i]].tobytes().decode("utf-32-le").encode()


def line_runs(texts: pa.Array, least: int = MIN_CHARS) -> Iterator[tuple[int, Lines, np.ndarray, np.ndarray]]:
    """(first document, lines, which have ``least`` characters, ids of these) of run after run of documents."""
    data, offsets = utf8(texts)
    for a, b in runs(offsets, RUN_BYTES):
        lines = Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        which = np.flatnonzero(lines.end - lines.start >= least)
        yield a, lines, which, lines.ids()[which]


def signature(lines: Lines, which: np.ndarray) -> np.ndarray:
    return minhash(*lines.shingles(which), VALUES, SEED)


def read_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)


def read_set(data: bytes) -> np.ndarray:
    """The distinct shingles of a normalised line."""
    chars = code_points(data)
    up, down = powers(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, U64)
    np.cumsum(CHAR_KEYS.take(chars) * up[:-1], out=sums[1:])
    out = (sums[Q:] - sums[:-Q]) * down[: len(chars) - Q + 1]
    out.sort()
    new = out[1:] != out[:-1]  # np.unique's table takes longer
    return out if new.all() else out[np.append(True, new)]


def chosen_paths(rows: DataFrame, level: int) -> DataFrame:
    """(node, id): two children of each row of a large node, by minwise values that the node chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, ids, sig = np.asarray(batch.column(0)), np.asarray(batch.column(1)), read_signatures(batch.column(2))
                own = linking.fold(np.full(len(ids), level), node).view(U64)
                one = (own % U64(VALUES)).astype(np.int64)
                for c in (one, (one + 1 + ((own >> U64(32)) % U64(VALUES - 1)).astype(np.int64)) % VALUES):
                    child = linking.fold(node, c, sig[np.arange(len(ids)), c])
                    yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(ids)], names=["node", "id"])

    return rows.select("node", "id", "sig").mapInArrow(run, "node bigint, id bigint")


def places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, place, pos, id, nodes): where each line that takes part stands, and the nodes of its bands as 64-bit
    numbers. A line that can't have near copies has none, nor has one that stands before in the same run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            keys, place = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for a, lines, which, ids in line_runs(batch.column(1)):
                long = np.flatnonzero(lines.end[which] - lines.start[which] >= Q)
                banded = np.sort(long[np.unique(ids[long], return_index=True)[1]])
                sig = signature(lines, which[banded])
                nodes = np.stack([linking.fold(np.full(len(banded), k), *(sig[:, k * ROWS + r] for r in range(ROWS))) for k in range(BANDS)], axis=1)
                size = np.zeros(len(which) + 1, np.int32)
                size[banded + 1] = 8 * BANDS
                cells = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(np.cumsum(size, dtype=np.int32)), pa.py_buffer(nodes.tobytes())])
                doc = a + lines.doc[which]
                yield pa.RecordBatch.from_arrays([pa.array(keys[doc]), pa.array(place[doc]), pa.array(lines.pos[which].astype(np.int32)), pa.array(ids), cells], names=["doc_id", "place", "pos", "id", "nodes"])
        give_back()

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("place"))
    return rows.mapInArrow(run, "doc_id bigint, place bigint, pos int, id bigint, nodes binary")


def banded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a batch of `places` and the id of each."""
    lines, column = np.asarray(batch.column("id")), batch.column("nodes")
    size = np.asarray(pc.binary_length(column)) // 8
    return np.frombuffer(b"".join(column.to_pylist()), np.int64), np.repeat(lines, size)


def candidates(docs: DataFrame, text: str, ids: DataFrame, n: int) -> DataFrame:
    """(id, sig, data): minwise values and normalised text of the given distinct lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lines, which, found in line_runs(batch.column(0), Q):
                found, first = np.unique(found, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(lines.texts(which[first]), pa.binary())], names=["id", "data"])
        give_back()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(1).to_pylist()
                data = code_points(b"".join(rows))
                ends = np.cumsum([len(r.decode()) for r in rows])
                up, down = powers(len(data) + 1)
                sums = np.append(U64(0), np.cumsum(CHAR_KEYS[data] * up[:-1]))
                n_sh = np.diff(np.append(0, ends)) - Q + 1
                first = np.append(0, np.cumsum(n_sh))
                at = np.arange(first[-1]) + np.repeat(np.append(0, ends)[:-1] - first[:-1], n_sh)
                sig = minhash(mix((sums[at + Q] - sums[at]) * down[at]), first[:-1], VALUES, SEED)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sig], pa.binary()), batch.column(1)], names=["id", "sig", "data"])
        give_back()

    made = docs.select(text).mapInArrow(run, "id bigint, data binary")
    return made.join(linking.small_side(ids, n), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(sign, "id bigint, sig binary, data binary")


def line_classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Places (doc_id, place, pos, id) of lines, and (id, component) of lines that have near copies."""
    docs = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    at = linking.stored(places(docs, key, text), "line-places")
    nodes = linking.shared_packed(at.select("id", "nodes"), banded, BANDS * at.count())
    ids = linking.stored(nodes.select("id").distinct(), "line-ids")
    lines = linking.stored(candidates(docs, text, ids, ids.count()), "lines")
    sets = lambda few, n: lines.select("id", "data").join(linking.small_side(few, n), "id", "left_semi")
    items = linking.Items(lines.select("id", "sig"), sets, read_signatures, read_set, CUT, PERCENT)
    _, comp = linking.resolve(nodes, items, chosen_paths)
    return at.drop("nodes"), comp


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later near copies of lines removed from the text, n_lines (before), n_removed."""
    at, comp = line_classes(docs, key, text)
    n = comp.count()
    at = at.join(linking.small_side(comp, n), "id", "left").select("doc_id", "place", "pos", F.coalesce("component", "id").alias("line"))
    first = at.groupBy("line").agg(F.min(F.struct("doc_id", "place", "pos")).alias("f"))
    gone = at.join(first.select("f.*"), ["doc_id", "place", "pos"], "left_anti")
    cut, of, where = (fresh(x, docs.columns) for x in ("cut", "of", "where"))
    gone = gone.groupBy(F.col("doc_id").alias(of), F.col("place").alias(where)).agg(F.collect_set("pos").alias(cut))
    gone = linking.stored(gone, "line-gone")
    rows = gone.agg(F.count("*") + F.sum(F.size(cut))).first()[0] or 0
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(cut, i))
    same = (F.col(key).cast("bigint") == F.col(of)) & (F.xxhash64(text) == F.col(where))
    joined = docs.join(linking.small_side(gone, rows), same, "left")
    new = {
        text: F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.concat_ws("\n", kept)),
        "n_lines": F.when(F.length(text) > 0, F.size(lines)).otherwise(0).cast("bigint"),
        "n_removed": F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("bigint"),
    }
    return joined.withColumns(new).drop(cut, of, where)
