"""Operator 13: alignment of two tokenizers' encodings of each text, by pointer jumping.

A is a byte-level BPE over a space and the text, B a SentencePiece model that adds the space itself. Both cut
the same bytes, so an A token and a B token are linked if their byte ranges overlap. Byte offsets
where tokens of both end cut a document into groups, the components of the links. They are found
without walking: every token points to the token that overlaps it and reaches farthest to the right
(one that shares its end with an A token points to that, which points to itself), and squaring the pointer array
(`succ[succ]`) halves every chain until all tokens hold their component's terminal token.

A task encodes each document once and writes its digests with its distinct links, packed. Counts of links are
corpus-wide: tasks sum documents by link before the exchange. Links that many documents hold (at most
`HEAVY` of them, by a threshold on the count) are known to all tasks afterwards; all others meet their
count in an exchange, in which no key is hot, because a link there has few documents.

Defined results: null and empty texts, and texts that either encoding doesn't give back byte for byte, have no
tokens: zeros and an empty string. Rows are documents: repeated rows and ids count as often as they come, null
ids are kept. Very long texts are encoded whole; a task holds one run of texts (`RUN_BYTES`, or one longer
text) and its tokens. Ties of counts are all best. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.linking import stored
from sessionlake.llm.text import runs, utf8

RUN_BYTES = 1 << 19
#: Links whose counts every task knows, at most (17 bytes each).
HEAVY = 1 << 20
#: Distinct links that a task sums before it sends them.
SUMMED = 1 << 20

_loaded: dict[tuple[str, str], Tokenizers] = {}


class Tokens:
    """The bytes of a vocabulary, end to end, and ids as decimals with room for a separator."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.digits = np.array([len(str(i)) + 1 for i in range(len(entries))], np.int64)
        self.digit_start = np.cumsum(self.digits) - self.digits
        self.digit_flat = np.frombuffer("".join(f"{i}," for i in range(len(entries))).encode(), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_spans(self.start[ids], self.size[ids])]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each span, end to end."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class Tokenizers:
    """Both encoders and their vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        entries = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for entry, i in ranks.items():
            entries[i] = entry
        self.a = Tokens(entries)
        # GPT-2's pattern, which a ByteLevel pre-tokenizer stands for.
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._fast = tiktoken.Encoding("a", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        self._exact = Tokenizer.from_file(a_path)
        self._exact.encode_special_tokens = True
        self._b = sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b = Tokens([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]])

    def encode_a(self, text: str) -> list[int]:
        try:
            return self._fast.encode_ordinary(" " + text)
        except (ValueError, RuntimeError):  # its regular expressions give up on some very long runs
            return self._exact.encode(" " + text, add_special_tokens=False).ids

    def encode_b(self, text: str) -> list[int]:
        return self._b.encode(text)


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """Loaded once in each Python worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


@dataclass
class Alignment:
    """Documents' tokens end to end: ids, byte ends, group of each token, and each document's first token."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from left to right, of A and B tokens with these ends (both cut the same bytes)."""
    n = len(a_end)
    to_b, to_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    succ = np.concatenate([np.where(b_end[to_b] > a_end, n + to_b, np.arange(n)), to_a]) if n else to_a
    while True:
        farther = succ[succ]
        if np.array_equal(farther, succ):
            break
        succ = farther
    terminal = np.flatnonzero(succ[:n] == np.arange(n))
    group = np.searchsorted(terminal, succ)
    return group[:n], group[n:]


def align(t: Tokenizers, texts: list[str]) -> tuple[np.ndarray, Alignment]:
    """Which texts have tokens, and the alignment of these."""
    raw = [(" " + x).encode() for x in texts]
    a, b = [], []
    for x in texts:
        a.append(np.array(t.encode_a(x) if x else [], np.int64))
        b.append(np.array(t.encode_b(x) if x else [], np.int64))
    same = lambda v, ids, data: int(v.size[ids].sum()) == len(data) and v.bytes_of(ids).tobytes() == data
    good = np.array([bool(x) and same(t.a, i, d) and same(t.b, j, d) for x, i, j, d in zip(texts, a, b, raw, strict=True)], bool)
    a, b = ([ids for ids, ok in zip(side, good, strict=True) if ok] for side in (a, b))
    first = [np.cumsum([0, *map(len, side)]) for side in (a, b)]
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (a, b))
    ends = np.cumsum(t.a.size[a]), np.cumsum(t.b.size[b])
    return good, Alignment(a, b, *ends, *components(*ends), *first)


def groups_text(t: Tokenizers, x: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all documents as bytes, and the documents' bounds in it (each ends in a separator)."""
    n, m = len(x.a), len(x.b)
    count = int(x.a_group[-1]) + 1 if n else 0
    b_before = np.searchsorted(x.b_group, np.arange(count))
    a_upto = np.searchsorted(x.a_group, np.arange(count), side="right")
    place = np.concatenate([np.arange(n) + b_before[x.a_group], np.arange(m) + a_upto[x.b_group]])
    start, size, mark = (np.empty(n + m, k) for k in (np.int64, np.int64, np.uint8))
    start[place] = np.concatenate([t.a.digit_start[x.a], t.b.digit_start[x.b] + len(t.a.digit_flat)])
    size[place] = np.concatenate([t.a.digits[x.a], t.b.digits[x.b]])
    last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (x.a_group, x.b_group)]
    mark[place] = np.concatenate([np.where(last[0], ord("|"), ord(",")), np.where(last[1], ord(";"), ord(","))])
    out = np.concatenate([t.a.digit_flat, t.b.digit_flat])[_spans(start, size)]
    end = np.cumsum(size)
    out[end - 1] = mark
    return out, np.concatenate([[0], end])[x.a_first + x.b_first]


def link_pairs(x: Alignment, width: int) -> tuple[np.ndarray, np.ndarray]:
    """a * width + b of all links in order of A tokens, and the documents' bounds in them."""
    a_start = np.concatenate([[0], x.a_end[:-1]]) if len(x.a) else x.a_end
    first, last = np.searchsorted(x.b_end, a_start, side="right"), np.searchsorted(x.b_end, x.a_end)
    count = last - first + 1
    pairs = np.repeat(x.a * width, count) + x.b[_spans(first, count)]
    return pairs, np.concatenate([[0], np.cumsum(count)])[x.a_first]


def pack(pairs: np.ndarray) -> tuple[bytes, int]:
    """Distinct pairs and how often each comes, compressed (differences and counts by byte planes), and their number."""
    values, times = np.unique(pairs, return_counts=True)
    if not len(values):
        return b"", 0
    planes = np.stack([np.diff(values, prepend=0), times]).astype("<u4").view(np.uint8).reshape(2, -1, 4)
    return pa.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes(), codec="zstd", asbytes=True), len(values)


def unpack(data: bytes, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    if not distinct:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * distinct, codec="zstd", asbytes=True), np.uint8)
    values, times = np.ascontiguousarray(planes.reshape(2, 4, distinct).transpose(0, 2, 1)).view("<u4").reshape(2, distinct).astype(np.int64)
    return np.cumsum(values), times


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, groups (the text of its groups, null without tokens)."""
    return _encoded(docs, a_path, b_path, key, text, digest=False)


def _encoded(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, digest: bool) -> DataFrame:
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    last = "groups_sha256 string, n_distinct bigint, links binary" if digest else "groups string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        for batch in batches:
            for lo, hi in runs(utf8(batch.column(1))[1], RUN_BYTES):
                part = [x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                good, x = align(t, part)
                out, at = groups_text(t, x)
                pairs, link_at = link_pairs(x, len(t.b.size))
                group_at = np.append(x.a_group, int(x.a_group[-1]) + 1 if len(x.a) else 0)[x.a_first]
                full = {"n_a": np.diff(x.a_first), "n_b": np.diff(x.b_first), "n_groups": np.diff(group_at), "n_links": np.diff(link_at)}
                texts = [out[i : j - 1].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo)]
                for v in full.values():
                    put = np.zeros(len(good), np.int64)
                    put[good] = v
                    columns.append(pa.array(put))
                of = iter(zip(texts, link_at[:-1], link_at[1:], strict=True))
                if digest:
                    shas, distinct, packed = [], [], []
                    for ok in good:
                        s, i, j = next(of) if ok else (b"", 0, 0)
                        shas.append(hashlib.sha256(s).hexdigest() if ok else "")
                        data, n = pack(pairs[i:j])
                        packed.append(data)
                        distinct.append(n)
                    columns += [pa.array(shas), pa.array(distinct, pa.int64()), pa.array(packed, pa.binary())]
                else:
                    columns.append(pa.array([next(of)[0].decode() if ok else None for ok in good], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, *full, *[c.split()[0] for c in last.split(", ")]])

    return rows.mapInArrow(run, f"`{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, {last}")


def _documents_by_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, documents) of a task's documents; a pair comes again when the task's sums grow full."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        pairs, n = (np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
        values, at = np.unique(pairs, return_inverse=True)
        return values, np.bincount(at, weights=n, minlength=len(values)).astype(np.int64)

    def out(values: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(values), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(values[i : i + 65536]), pa.array(n[i : i + 65536])], names=["pair", "n"])

    size = 0
    for batch in batches:
        for data, distinct in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            values = unpack(data.as_py(), distinct)[0]
            held.append((values, np.ones(len(values), np.int64)))
            size += len(values)
            if size >= 2 * SUMMED:
                held = [summed()]
                size = len(held[0][0])
                if size >= SUMMED:
                    yield from out(*held[0])
                    held, size = [], 0
    yield from out(*summed())


def link_counts(encoded: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that hold it), best (no pair of its A id has more). A ids are as many as the vocabulary."""
    counts = encoded.select("links", "n_distinct").mapInArrow(_documents_by_link, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {width}")), "link-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _heavy(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of the highest counts, at most `HEAVY`: all with a count of 2^k or more, for the least such k."""
    by_power = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()  # 64 rows at most
    least, total = 64, 0
    for k, rows in sorted(by_power, reverse=True):
        if (total := total + rows) > HEAVY:
            break
        least = k
    if least == 64:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    known = counts.filter(F.col("n") >= 1 << least).toArrow()
    pair, n, best = (known.column(i).to_numpy() for i in range(3))
    order = np.argsort(pair)
    return pair[order], n[order], best[order].astype(bool)


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    encoded = _encoded(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), a_path, b_path, "id", "text", digest=True)
    rows = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = link_counts(rows, width)
    known = docs.sparkSession.sparkContext.broadcast(_heavy(counts))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums per document, under a negative pair of its own, and a row per link not known here."""
        pair, n, best = known.value
        for batch in batches:
            found = [[np.zeros(0, np.int64)] for _ in range(5)]
            for r, data, distinct in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                values, times = unpack(data.as_py(), distinct)
                at = np.searchsorted(pair, values)
                hit = at < len(pair)
                hit[hit] = pair[at[hit]] == values[hit]
                at, here = at[hit], times[hit]
                rare = values[~hit]
                one = [[r], [-1 - r], [0], [int(here[best[at]].sum())], [int((here * n[at]).sum())]]
                rest = [np.full(len(rare), r), rare, times[~hit], np.zeros(len(rare), np.int64), np.zeros(len(rare), np.int64)]
                for column, x, y in zip(found, one, rest, strict=True):
                    column += [np.array(x, np.int64), y]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["row", "pair", "times", "n_best", "count_sum"])

    links = rows.select("row", "links", "n_distinct").mapInArrow(looked_up, "row bigint, pair bigint, times bigint, n_best bigint, count_sum bigint")
    sums = links.join(counts, "pair", "left").groupBy("row").agg(
        F.sum(F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"),
    )
    return rows.drop("links", "n_distinct").join(sums, "row").select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
