"""Operator 8: exact SentencePiece (BPE) encoding by backtracking, and decoding.

Merge-type encoding picks the best-scored adjacent pair again and again. The same
token sequence is the only one whose adjacent tokens are all *compatible*: two tokens
are compatible when re-merging their joined text gives the two back. So a segment is
encoded left to right: an Aho-Corasick pass lists the pieces that start at each
position, the longest compatible one is taken, a shorter one if it leads nowhere, and a
bit field remembers the positions from which no encoding of the rest exists.

Text is cut where no piece can reach across (before a run of spaces, around a line feed),
and encoded segments are kept in a memo bounded in bytes, so each task pays once for
a frequent word; it goes when the task ends. Runs of several spaces hold pieces of equal score, for which order
matters; segments with them take the merge loop itself.

Defined results: null and empty text give no ids and an empty decoded text; a character
outside the vocabulary becomes its UTF-8 byte pieces; U+2581 stands for a space, as in the
library. Rows are independent: repeated rows and ids come out as often as they came in,
extra columns are ignored (`encode_documents` keeps them), an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sessionlake.llm import text as _  # how a worker keeps memory

SPACE = "▁"
#: Bytes of segments, ids and decoded texts that a task remembers; the memo starts anew when it is full.
MEMO_BYTES = 96 << 20
#: What an entry takes besides its characters.
ENTRY_BYTES = 300

_models: dict[str, PieceModel] = {}


class _Memo(dict):
    """Segment (after ``prefix``) to its ids as text, with the decoded text beside it."""

    def __init__(self, model: PieceModel, prefix: str):
        super().__init__()
        self.model, self.prefix, self.decoded, self.bytes = model, prefix, {}, 0

    def forget(self) -> None:
        self.clear()
        self.decoded.clear()
        self.bytes = 0

    def __missing__(self, segment: str) -> str:
        if self.bytes >= MEMO_BYTES:
            self.forget()
        text = self.prefix + segment
        ids = self.model.encode_known(text)
        if ids is None:
            ids = self.model.encode_segment(text)
            self.decoded[segment] = self.model.decode_ids(ids)
        else:  # its pieces are the text
            self.decoded[segment] = text.replace(SPACE, " ")
        self[segment] = out = ",".join([self.model.number[i] for i in ids])
        self.bytes += ENTRY_BYTES + 4 * len(segment) + len(out)
        return out


class PieceModel:
    """The pieces of a model file, with their scores, and the encoder over them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.number = [str(i) for i in range(n)]
        self.byte_id, self.byte_of = {}, {}
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.byte_of[i] = int(p[1:-1], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p], self.rank[p] = i, sp.get_score(i)
        self.hidden = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        longer = {c for p in self.id if len(p) > 1 for c in p}
        #: Characters of longer pieces that are no piece themselves need the merge loop.
        self.loose = longer - self.id.keys()
        self.cut_lines = "\n" not in longer
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.cut_words = not inner
        self.segments = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+") if self.cut_lines else re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.compatible_memo: dict[tuple[int, int], bool] = {}
        self.spaced, self.bare, self.whole = _Memo(self, SPACE), _Memo(self, ""), _Memo(self, "")

    # -- encoding ------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The defining merge loop: best score first, leftmost among equals."""
        sym: list[str | None] = list(text)
        left, right = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(sym) and (joined := sym[i] + sym[j]) in self.rank:
                heapq.heappush(heap, (-self.rank[joined], i, j, joined))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or right[i] != j or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, None
            right[i] = right[j]
            if right[j] < len(sym):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in sym if s is not None]

    def compatible(self, a: int, b: int) -> bool:
        """True if re-merging the joined text gives the two pieces back (a = -1: b alone)."""
        got = self.compatible_memo.get((a, b))
        if got is None:
            pair = [self.pieces[i] for i in (a, b) if i >= 0]
            got = self.compatible_memo[a, b] = self.merge("".join(pair)) == pair
        return got

    def backtrack(self, text: str) -> list[int] | None:
        """Ids of a text of known characters; None if no compatible sequence exists."""
        starts: list[list[tuple[int, int]]] = [[] for _ in text]
        for last, (length, i) in self.automaton.iter(text):
            starts[last - length + 1].append((last + 1, i))  # shortest first
        failed, pos, n = 0, 0, len(text)
        out: list[int] = []
        tries = [len(starts[0])]
        at = [0]
        previous, known = -1, self.compatible_memo
        while pos < n:
            k = tries[-1] = tries[-1] - 1
            if k < 0:
                if not out:
                    return None
                failed |= 1 << pos
                tries.pop()
                at.pop()
                pos = at[-1]
                out.pop()
                previous = out[-1] if out else -1
                continue
            end, i = starts[pos][k]
            if failed >> end & 1:
                continue
            fits = known.get((previous, i))
            if not (self.compatible(previous, i) if fits is None else fits):
                continue
            out.append(i)
            previous, pos = i, end
            at.append(pos)
            tries.append(len(starts[pos]) if pos < n else 0)
        return out

    def forget(self) -> None:
        for memo in (self.spaced, self.bare, self.whole):
            memo.forget()

    def encode_known(self, text: str) -> list[int] | None:
        """Ids of a text all of whose characters are pieces, if its pieces are those of `backtrack`; None for any other."""
        return self.backtrack(text) if self.id.keys() >= set(text) and SPACE * 2 not in text else None

    def encode_segment(self, text: str) -> list[int]:
        if (ids := self.encode_known(text)) is not None:
            return ids
        out: list[int] = []
        run = ""
        for c in text + "\0":  # the end mark closes the last run
            if c in self.id or c in self.loose:
                run += c
                continue
            if run:
                ids = None if SPACE * 2 in run or self.loose.intersection(run) else self.backtrack(run)
                if ids is None:
                    for p in self.merge(run):
                        out += [self.id[p]] if p in self.id else self.as_bytes(p)
                else:
                    out += ids
                run = ""
            out += self.as_bytes(c)
        del out[-len(self.as_bytes("\0")) :]
        return out

    def as_bytes(self, c: str) -> list[int]:
        return [self.byte_id.get(b, self.unknown) for b in c.encode("utf-8")] if self.byte_id else [self.unknown]

    # -- decoding ------------------------------------------------------------

    def decode_ids(self, ids: list[int]) -> str:
        """The text of some ids, with the added first space still there."""
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i is not None and i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i is not None:
                out.append(" ⁇ " if i == self.unknown else "" if i in self.hidden else self.pieces[i])
        return "".join(out).replace(SPACE, " ")

    # -- whole texts -----------------------------------------------------------

    def encode(self, text: str) -> tuple[str, str]:
        """The ids, joined by commas, and their decoded text."""
        if not text:
            return "", ""
        text = text.replace(SPACE, " ")
        ids: list[str] = []
        decoded: list[str] = []
        if self.cut_words and self.cut_lines and "  " not in text and text[0] != " ":
            spaced, bare = self.spaced, self.bare
            first = True
            for line in text.split("\n"):
                words = line.split(" ")
                head = words[0]
                if first:
                    first = False
                    ids += [spaced[w] for w in words]
                    part = [spaced.decoded.get(w) for w in words]
                else:
                    ids.append(bare["\n"])
                    decoded.append(bare.decoded["\n"])
                    rest = words[1:]
                    if head:
                        ids.append(bare[head])
                        decoded.append(bare.decoded[head])
                    ids += [spaced[w] for w in rest]
                    part = [spaced.decoded.get(w) for w in rest]
                if None in part:  # the memo started anew in the middle of this line
                    words = words if len(part) == len(words) else words[1:]
                    part = [self.decode_ids(self.encode_segment(SPACE + w)) if p is None else p for w, p in zip(words, part, strict=True)]
                decoded += part
        else:
            full = SPACE + text.replace(" ", SPACE)
            for s in self.segments.findall(full) if self.cut_words else [full]:
                ids.append(self.whole[s])
                decoded.append(self.whole.decoded[s])
        joined = "".join(decoded)
        return ",".join(ids), joined[1:] if joined.startswith(" ") else joined


def model(path: str) -> PieceModel:
    """The model of a file, loaded once in each Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with two more columns: token ids (array of int) and the text they decode to."""
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            pairs = [m.encode(t or "") for t in batch.column(text).to_pylist()]
            arrays = [batch.column(f.name) for f in kept]
            arrays.append(pa.array([[int(i) for i in a.split(",")] if a else [] for a, _ in pairs], pa.list_(pa.int32())))
            arrays.append(pa.array([b for _, b in pairs], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [ids, decoded])
        m.forget()

    return docs.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, SHA-256 of the joined ids and of the decoded text.

    The same encoding as `encode_documents`; the digests are taken where the ids are made, so
    the ids themselves need not travel.
    """
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for i in range(batch.num_rows):  # one text at a time: a batch may hold very long ones
                ids, decoded = m.encode(batch.column(1)[i].as_py() or "")
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(sha(ids))
                b.append(sha(decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        m.forget()

    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
