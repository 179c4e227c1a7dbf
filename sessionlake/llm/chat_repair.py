"""Operator 11: the cheapest edits that give conversations a legal order of roles.

Legal roles read ``(s?(ua)+)?`` by their initials (system, user, assistant). An automaton of four states accepts
that, so what a row's edits cost is a min-plus matrix of four by four, one for each symbol (role initial and
fault). Equal consecutive symbols are a run; the costs before a run come from those behind it by the cached
binary powers of its matrix. The choices are unrolled from the front along the exact costs-to-go, with the
least edit initial first, which is the least audit of all cheapest ones.

A conversation of up to `HOT_ROWS` rows and `HOT_BYTES` of text is solved where its sorted rows stream by. A longer
one is split: its rows are cut into segments by quantiles of the turn, each segment gives its matrix, a
conversation's few segment matrices give the costs at every cut and then its states there, and the segments are
unrolled in parallel. Duplicates of a split conversation are found by a grouped minimum, not in one place. What
the contract wants in a single cell per conversation (one audit, one SHA-256 over its text) is streamed in order at
the end, without being held.

Defined results: nulls in role and text are one space (so such texts are blank and such roles no known one), null
turns come first, a null conversation is a conversation. Rows of equal turn go by role, then text; repeated rows
are duplicates. Empty texts are blank. Very long texts are kept whole. A conversation without rows left has zeros
and an empty audit. Extra columns are ignored; an empty table gives no rows.
Rows that share one turn of a split conversation stay in one segment.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.linking import small_side, stored

HOT_ROWS, HOT_BYTES = 50_000, 16 << 20
#: Rows of a run that are unrolled at once.
BLOCK = 1024

SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: Symbols: the role (system, user, assistant, another), 4 more if truncated, or GONE for rows that must go.
GONE = 8
START = 0
#: Where an emitted system, user or assistant row leads from each state (start, after s, after u, after a).
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT, EMIT = (2, 2, 3, 2), ("user", "user", "assistant", "user")
BEHIND = (0, 4, 2, 0)  # costs after the last row: insert what is missing
NEVER = 1 << 50

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and how often each row stands (0: dropped, 2: repeated), by crc32 of ``conv_id:turn``."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), (F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn"))) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return plain.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


# -- costs ----------------------------------------------------------------------


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, *(a[s][k] + b[k][t] for k in range(4))) for t in range(4)) for s in range(4))


def _apply(m: Matrix, v: Vector) -> Vector:
    return tuple(min(m[s][t] + v[t] for t in range(4)) for s in range(4))


def _row_matrix(symbol: int) -> Matrix:
    """Costs of inserts before a row and of its own edit, from state to state."""
    inserts = tuple(tuple(0 if s == t else 2 if NEXT[s] == t else 4 if NEXT[NEXT[s]] == t else NEVER for t in range(4)) for s in range(4))
    own = [[NEVER] * 4 for _ in range(4)]
    for s in range(4):
        own[s][s] = 3
        if symbol != GONE:
            cut = symbol >> 2
            own[s][NEXT[s]] = min(own[s][NEXT[s]], 2 + cut)
            kept = STEP[s].get("sua?"[symbol & 3])
            if kept is not None:
                own[s][kept] = min(own[s][kept], cut)
    return _times(inserts, tuple(map(tuple, own)))


IDENTITY: Matrix = tuple(tuple(0 if s == t else NEVER for t in range(4)) for s in range(4))
_powers: dict[int, list[Matrix]] = {}


def _power(symbol: int, k: int) -> Matrix:
    """The matrix of 2^k equal rows."""
    known = _powers.setdefault(symbol, [_row_matrix(symbol)])
    while len(known) <= k:
        known.append(_times(known[-1], known[-1]))
    return known[k]


def before_run(symbol: int, count: int, v: Vector) -> Vector:
    """The costs-to-go before a run of equal rows, from those behind it."""
    for k in range(count.bit_length()):
        if count >> k & 1:
            v = _apply(_power(symbol, k), v)
    return v


class Runs:
    """The symbols of consecutive rows, run by run."""

    def __init__(self, symbols: list[int] | None = None, counts: list[int] | None = None):
        self.symbols, self.counts = symbols or [], counts or []

    def add(self, symbol: int, count: int = 1) -> None:
        if self.symbols and self.symbols[-1] == symbol:
            self.counts[-1] += count
        elif count:
            self.symbols.append(symbol)
            self.counts.append(count)

    def matrix(self) -> Matrix:
        m = IDENTITY
        for symbol, count in zip(self.symbols, self.counts, strict=True):
            for k in range(count.bit_length()):
                if count >> k & 1:
                    m = _times(m, _power(symbol, k))
        return m

    def bounds(self, behind: Vector) -> list[Vector]:
        """The costs-to-go before each run, and behind the last."""
        out = [behind]
        for symbol, count in zip(reversed(self.symbols), reversed(self.counts), strict=True):
            out.append(before_run(symbol, count, out[-1]))
        return out[::-1]

    def edits(self, state: int, behind: Vector, last: bool = True) -> Iterator[tuple[str, int]]:
        """(edit initial, state after it) of the cheapest edits with the least initials; inserts at the end if ``last``."""
        at = self.bounds(behind)
        for run, (symbol, count) in enumerate(zip(self.symbols, self.counts, strict=True)):
            for lo in range(0, count, BLOCK):
                size = min(BLOCK, count - lo)
                costs = [before_run(symbol, count - lo - size, at[run + 1])]
                for _ in range(size):
                    costs.append(_apply(_power(symbol, 0), costs[-1]))
                for i in range(size, 0, -1):
                    for edit, state in _row_edits(symbol, state, costs[i], costs[i - 1]):
                        yield edit, state
        while last and behind[state]:
            state = NEXT[state]
            yield "I", state


def _row_edits(symbol: int, state: int, here: Vector, behind: Vector) -> Iterator[tuple[str, int]]:
    while here[state] != 3 + behind[state]:
        after = NEXT[state]
        if here[state] == 2 + here[after]:
            state = after
            yield "I", state
            continue
        kept = STEP[state].get("sua?"[symbol & 3])
        if kept is not None and here[state] == (symbol >> 2) + behind[kept]:
            yield "K", kept
        else:
            yield "R", after
        return
    yield "D", state


# -- rows -----------------------------------------------------------------------


class Segment:
    """Consecutive rows of a conversation: what is counted and their runs; their rows too if ``keep``."""

    def __init__(self, keep: bool):
        self.runs, self.rows, self.keep, self.seen = Runs(), [], keep, set()
        self.counts = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = None  # role initials
        self.low = self.high = None  # turns
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, times: int, fresh: bool | None) -> None:
        """``times`` equal rows, the first of them ``fresh`` if no earlier row has its role and text (None: find out here)."""
        if times and turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        ink = text.rstrip(SPACES)
        for copies, new in ((min(times, 1), (role, text) not in self.seen if fresh is None else fresh), (times - 1, False)):
            if copies <= 0:
                continue
            if fresh is None:
                self.seen.add((role, text))
            initial = role[:1]
            fault = "blank" if not ink else "duplicate" if not new else "truncated" if ink[-1] not in ".!?" else None
            if fault:
                self.counts[fault] += copies
            if self.first is None:
                self.first = initial
            else:
                self.counts["illegal"] += f"{self.last}{initial}" not in LEGAL
            self.counts["illegal"] += (copies - 1) * (initial * 2 not in LEGAL)
            self.last = initial
            self.runs.add(GONE if fault in ("blank", "duplicate") else ("sua".find(initial) % 4 if initial else 3) + 4 * (fault == "truncated"), copies)
            if self.keep:
                self.rows += [(role, text)] * copies

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _repaired(edits: Iterator[tuple[str, int]], rows: Iterator[tuple[str, str]], state: int) -> Iterator[tuple[str, str | None]]:
    """(edit, the line that it leaves, None for a deleted row)."""
    for edit, after in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        yield edit, None if edit == "D" else f"{role if edit == 'K' else EMIT[state]}:{text}"
        state = after


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows that share the first ``keys`` columns, each group as it streams by."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held = next(rows, None)

    def group(key: tuple) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[:keys] == key:
            row, held = held, None
            yield row[keys:]
            held = next(rows, None)

    while held is not None:
        key = held[:keys]
        part = group(key)
        yield key, part
        for _ in part:
            pass


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    out: list[tuple] = []
    for (conv,), rows in _grouped(batches, 1):
        seg = Segment(keep=True)
        for turn, role, text, times in rows:
            seg.add(turn, role, text, times, None)
        done = list(_repaired(seg.runs.edits(START, BEHIND), iter(seg.rows), START))
        sha = hashlib.sha256("\n".join(line for _, line in done if line is not None).encode()).hexdigest()
        cost = seg.runs.bounds(BEHIND)[0][START]
        out.append((conv, *(seg.counts | {"gaps": seg.gaps, "cost": cost}).values(), "".join(e for e, _ in done), sha))
        if len(out) == 4096:
            yield _batch(names, out)
            out = []
    yield _batch(names, out)


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    whole = {"conv_id", *COUNTS}
    kinds = [pa.int64() if n in whole else pa.string() for n in names]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


RESULT = ", ".join(["conv_id bigint", *(f"{c} bigint" for c in COUNTS), "audit string", "repaired_sha256 string"])


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups together, their rows in order of turn (nulls first), role and text."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.col("turn").asc_nulls_first(), "role", "text")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, times): `COUNTS`, audit, repaired_sha256."""
    rows = rows.select("conv_id", "turn", "role", "text", F.col("times").cast("bigint").alias("times"))
    size = rows.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text") * F.col("times")).alias("bytes"))
    long = stored(size.filter((F.col("n") > HOT_ROWS) | (F.col("bytes") > HOT_BYTES)), "long-conversations")
    count, parts = long.agg(F.count("*"), F.max(F.greatest(F.col("n") / HOT_ROWS, F.col("bytes") / HOT_BYTES))).first()
    if not count:
        return _dealt(rows, "conv_id").mapInArrow(_solve_whole, RESULT)
    few = small_side(long.select(F.col("conv_id").alias("c")), count)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    whole = _dealt(rows.join(few, same, "left_anti"), "conv_id").mapInArrow(_solve_whole, RESULT)
    return whole.unionByName(_repair_split(rows.filter("times > 0").join(few, same, "left_semi"), count, math.ceil(2 * parts)))


# -- conversations in segments ----------------------------------------------------


def _segmented(rows: DataFrame, count: int, parts: int) -> DataFrame:
    """Equal rows as one, with their number, whether they are the first of their role and text, and their segment."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    conv = F.struct("conv_id").alias("conv")  # compares with null
    rows = rows.select(conv, "turn", "role", "text", "times", digest.alias("digest"))
    rows = rows.groupBy("conv", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("times").alias("times"))
    rows = stored(rows, "conversation-rows")
    first = rows.groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    cuts = rows.groupBy("conv").agg(F.percentile_approx("turn", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts"))
    rows = rows.join(first, ["conv", "digest"]).join(small_side(cuts, count), "conv")
    before = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("turn"))), F.lit(0))
    seg = F.when(F.col("turn").isNull() | F.col("cuts").isNull(), 0).otherwise(before)
    return rows.select(F.col("conv.conv_id").alias("conv_id"), seg.alias("seg"), "turn", "role", "text", "times", F.col("turn").eqNullSafe(F.col("first.turn")).alias("fresh"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, part), rows in _grouped(batches, 2):
        seg = Segment(keep=False)
        for row in rows:
            seg.add(*row)
        m = np.array(seg.runs.matrix(), np.int64).ravel().tolist()
        facts = [seg.low, seg.high, seg.turns, *(seg.counts[c] for c in COUNTS[1:5])]
        runs = [*seg.runs.symbols, *seg.runs.counts]
        values = [conv, part, m, facts, [seg.first, seg.last], runs]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["conv_id", "seg", "matrix", "facts", "ends", "runs"])


def _runs_of(flat: list[int]) -> Runs:
    half = len(flat) // 2
    return Runs([int(x) for x in flat[:half]], [int(x) for x in flat[half:]])


def _costs_at_cuts(table: pa.Table) -> pa.Table:
    """The costs-to-go behind each segment of one conversation (a row per segment)."""
    table = table.sort_by("seg")
    v, out = BEHIND, []
    for m in reversed(table["matrix"].to_pylist()):
        out.append(list(v))
        v = _apply(tuple(tuple(m[4 * s : 4 * s + 4]) for s in range(4)), v)
    return table.select(["conv_id", "seg"]).append_column("behind", pa.array(out[::-1], pa.list_(pa.int64()))).append_column("cost", pa.array([v[START]] * len(out), pa.int64()))


def _states_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the cheapest edits of a segment lead from each state."""
    for batch in batches:
        for conv, part, behind, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            after = []
            for state in range(4):
                for _, state in _runs_of(runs).edits(state, tuple(behind), last=False):
                    pass
                after.append(state)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([after], pa.list_(pa.int64()))], names=["conv_id", "seg", "after"])


def _states_at_cuts(table: pa.Table) -> pa.Table:
    """The state in which the cheapest edits of one conversation enter each segment, and whether it is the last."""
    table = table.sort_by("seg")
    state, out = START, []
    for after in table["after"].to_pylist():
        out.append(state)
        state = after[state]
    flags = [False] * (len(out) - 1) + [True]
    return table.select(["conv_id", "seg"]).append_column("state", pa.array(out, pa.int32())).append_column("last", pa.array(flags))


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment (its plan first, then its rows) the edits and the lines they leave, in numbered pieces."""
    names, kinds = ["conv_id", "seg", "piece", "audit", "lines"], [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    for (conv, part), rows in _grouped(batches, 2):
        plan = next(rows)
        behind, runs, state, last = plan[-4:]
        each = ((role, text) for _, role, text, times, *_ in rows for _ in range(times))
        audit, lines, size, piece = [], [], 0, 0

        def out() -> pa.RecordBatch:
            values = [conv, part, piece, "".join(audit), "".join(f"\n{x}" for x in lines)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for edit, line in _repaired(_runs_of(runs).edits(state, tuple(behind), last), each, state):
            audit.append(edit)
            if line is not None:
                lines.append(line)
                size += len(line)
            if len(audit) >= 10_000 or size >= 1 << 20:
                yield out()
                audit, lines, size, piece = [], [], 0, piece + 1
        yield out()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and SHA-256 of each conversation whose pieces stream by in order."""
    for (conv,), pieces in _grouped(batches, 1):
        sha, audit, begun = hashlib.sha256(), [], False
        for _, _, edits, lines in pieces:
            audit.append(edits)
            sha.update((lines if begun else lines[1:]).encode())
            begun = begun or bool(lines)
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])


def _totals(table: pa.Table) -> pa.Table:
    """Counts of one conversation from its segments' (a row per segment)."""
    table = table.sort_by("seg")
    facts, ends = table["facts"].to_pylist(), table["ends"].to_pylist()
    lows, highs = [f[0] for f in facts if f[0] is not None], [f[1] for f in facts if f[1] is not None]
    gaps = max(highs) - min(lows) + 1 - sum(f[2] for f in facts) if lows else 0
    blank, duplicate, truncated, illegal = (sum(f[k] for f in facts) for k in range(3, 7))
    illegal += sum(f"{x[1]}{y[0]}" not in LEGAL for x, y in zip(ends, ends[1:], strict=False))
    values = [table["conv_id"][0].as_py(), gaps, blank, duplicate, truncated, illegal]
    return pa.table({n: pa.array([v], pa.int64()) for n, v in zip(["conv_id", *COUNTS[:5]], values, strict=True)})


def _by_conversation(df: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return df.groupBy("conv_id").applyInArrow(function, schema)


def _repair_split(rows: DataFrame, count: int, parts: int) -> DataFrame:
    seg = stored(_segmented(rows, count, parts), "segment-rows")
    summary = _dealt(seg, "conv_id", "seg").mapInArrow(_summaries, "conv_id bigint, seg int, matrix array<bigint>, facts array<bigint>, ends array<string>, runs array<bigint>")
    summary = stored(summary, "segments")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["seg"] == b["seg"])

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, same(a, b)).drop(b["conv_id"]).drop(b["seg"])

    costs = stored(_by_conversation(summary.select("conv_id", "seg", "matrix"), _costs_at_cuts, "conv_id bigint, seg int, behind array<bigint>, cost bigint"), "cut-costs")
    plan = beside(summary.select("conv_id", "seg", "runs"), costs.select("conv_id", "seg", "behind"))
    after = plan.select("conv_id", "seg", "behind", "runs").mapInArrow(_states_after, "conv_id bigint, seg int, after array<bigint>")
    states = stored(_by_conversation(after, _states_at_cuts, "conv_id bigint, seg int, state int, last boolean"), "cut-states")
    plan = beside(plan, states).withColumn("order", F.lit(0))
    both = seg.withColumn("order", F.lit(1)).unionByName(plan, allowMissingColumns=True)
    keys = ["conv_id", "seg"]
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "order", F.col("turn").asc_nulls_first(), "role", "text")
    dealt = dealt.select(*keys, "turn", "role", "text", "times", "behind", "runs", "state", "last")
    pieces = stored(dealt.mapInArrow(_unrolled, "conv_id bigint, seg int, piece bigint, audit string, lines string"), "repaired-pieces")
    done = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "piece").mapInArrow(_digested, "conv_id bigint, audit string, repaired_sha256 string")
    totals = _by_conversation(summary.select("conv_id", "seg", "facts", "ends"), _totals, ", ".join(["conv_id bigint", *(f"{c} bigint" for c in COUNTS[:5])]))
    cost = costs.groupBy("conv_id").agg(F.max("cost").alias("cost"))
    on = lambda a, b: a.join(b, a["conv_id"].eqNullSafe(b["conv_id"])).drop(b["conv_id"])
    return on(on(totals, cost), done).select("conv_id", *COUNTS, "audit", "repaired_sha256")
