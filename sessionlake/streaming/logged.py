"""Sessionize a log whose ticks and flushes are explicit rows.

A tick is due when it is an interval past the last *due* tick: a chain along each stream. The log is shuffled by
stream and sorted once; windows say which segment each row is in, and one pass over the sorted rows (`saving_rows`, a
batch at a time in every partition) follows the chain. It carries the stream's last due tick and nothing else, so
no tick is joined or written for it.

The rest are X1's steps. The rows that set states open segments (P8, W2); due ticks and flushes fall into the
segment that is open; a segment ends at its last flush, or at the idle row that saves it; kept segments are
numbered and merged (W4, A8). Only rows that open or save go on to them. `response_log_logged` (S10) reads the replies off
the same rows; only the first save of a segment has to ask whether its segment continues a session.

Rows of one stream with equal ``(ts_us, seq)`` have no order of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.config import SessionConfig, saved
from sessionlake.operators.audit import timed_responses
from sessionlake.operators.sessionize import KEY, ORDER, SESSION_COLUMNS, _run_islands_plain, event_states, is_opener, merge_runs, min_duration, prepare_events, stream_window

TICK, FLUSH = "tick", "flush"
_COLUMNS = [KEY, "ts_us", "seq", "t", "kind", "app_id", "workspace"]


class Chain:
    """The due ticks of sorted rows: a stream's last due tick goes from batch to batch."""

    def __init__(self, interval: int):
        self.interval = int(interval)
        self.key, self.last, self.place = None, 0, None

    def due(self, keys: list, seconds: list, places: list) -> list[int]:
        """Which of a batch's ticks are due; rows at the very place of a due tick are too. A null key or second never is."""
        found = []
        key, last, place = self.key, self.last, self.place
        for i, (k, t) in enumerate(zip(keys, seconds, strict=True)):
            if k is None or t is None:
                continue
            if k != key:
                key, last, place = k, 0, None  # the last due tick of a new stream is at second 0
            if t - last >= self.interval:
                last, place = t, places[i]
                found.append(i)
            elif t == last and places[i] == place:
                found.append(i)
        self.key, self.last, self.place = key, last, place
        return found


def due_ticks(ticks: DataFrame, interval: int) -> DataFrame:
    """(stream_key, t): the due ones among distinct tick seconds; the last due tick of a new stream is at second 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(interval)
        for b in batches:
            seconds = b.column("t").to_pylist()
            yield b.take(pa.array(chain.due(b.column(KEY).to_pylist(), seconds, seconds), pa.int64()))

    rows = ticks.select(KEY, F.col("t").cast("long").alias("t"))
    return rows.repartition(KEY).sortWithinPartitions(KEY, "t").mapInArrow(scan, rows.schema)


def _accepted(config: SessionConfig, at: str) -> Column:
    """P3 for a flush at column ``at`` of the segment that began at ``start``."""
    m = int(config.min_session_duration)
    return F.col(at).isNotNull() & (F.lit(m == 0) | (F.col(at) - F.col("start") > F.lit(m)))


def saving_rows(rows: DataFrame, config: SessionConfig, all_rows: bool) -> DataFrame:
    """Rows sorted by stream and order, with ``saves`` (a due tick or a flush, in a segment), ``taken`` (it passes P3) and
    ``again`` (its segment had one before). ``all_rows`` false leaves out those that neither open nor save."""
    m = int(config.min_session_duration)
    interval = int(config.flush_interval)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, before = Chain(interval), None
        for b in batches:
            n, segno, t = b.num_rows, b.column("segno"), b.column("t")
            inside = pc.greater(segno, 0)
            known = pc.is_valid(b.column(KEY)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(pc.and_(pc.equal(b.column("kind"), TICK), inside).fill_null(False).to_numpy(zero_copy_only=False))
            ticks = b.take(pa.array(at))
            places = list(zip(ticks.column("ts_us").to_pylist(), ticks.column("seq").to_pylist(), strict=True))
            saves = pc.and_(pc.equal(b.column("kind"), FLUSH), inside).fill_null(False).to_numpy(zero_copy_only=False).copy()
            saves[at[chain.due(ticks.column(KEY).to_pylist(), ticks.column("t").to_pylist(), places)]] = True
            taken = saves & known
            if m:
                taken &= pc.greater(pc.subtract(t, b.column("start")), m).fill_null(False).to_numpy(zero_copy_only=False)
            again = np.zeros(n, bool)
            if (hit := np.flatnonzero(taken)).size:
                own = b.take(pa.array(hit))
                key, number = own.column(KEY).to_numpy(), own.column("segno").to_numpy()
                again[hit[1:]] = (key[1:] == key[:-1]) & (number[1:] == number[:-1])
                again[hit[0]] = before == (key[0], number[0])
                before = (key[-1], number[-1])
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(saves), pa.array(taken), pa.array(again)], [*b.schema.names, "saves", "taken", "again"])
            yield out if all_rows else out.filter(pc.or_(pa.array(saves), pc.is_valid(b.column("state"))))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(scan, f"{columns}, saves boolean, taken boolean, again boolean")


def logged_rows(log: DataFrame, config: SessionConfig, all_rows: bool = True) -> DataFrame:
    """Openers (with ``state``), ticks and flushes in order: which segment they are in (``segno``, 0: none), its ``start``, and if they save it."""
    ev = prepare_events(log).select(*_COLUMNS[:-1], F.col("workspace").cast("int").alias("workspace"))
    acts = F.col("kind").isin(TICK, FLUSH)
    openers = event_states(ev.filter(~acts), config).filter(is_opener()).select(*_COLUMNS[:5], F.col("after").alias("state"))
    rows = openers.unionByName(ev.filter(acts).select(*_COLUMNS[:5]), allowMissingColumns=True)
    upto = stream_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.last(F.when(F.col("state").isNotNull(), F.col("t")), ignorenulls=True).over(upto)
    rows = rows.withColumn("segno", F.count("state").over(upto)).withColumn("start", start)
    return saving_rows(rows.sortWithinPartitions(KEY, *ORDER), config, all_rows)  # the windows' own order: no second sort


def _segments(rows: DataFrame, config: SessionConfig) -> DataFrame:
    """The segments of `logged_rows`, in X1's columns, with their number."""
    opener = F.struct("ts_us", "seq", "t", "kind", "state")
    segs = rows.filter("segno > 0").groupBy(KEY, "segno").agg(F.max(F.when(F.col("state").isNotNull(), opener)).alias("o"), F.max(F.when(F.col("saves"), F.col("t"))).alias("last"))
    w = Window.partitionBy(KEY).orderBy("segno")
    idled = (F.lead("o.kind").over(w) == "idle_on") & F.col("o.state.is_active")
    segs = segs.withColumn("flush_t", F.when(idled, F.lead("o.t").over(w)).otherwise(F.col("last")))
    segs = segs.select(KEY, "segno", "o.ts_us", "o.seq", F.col("o.t").alias("start"), "o.state", "flush_t")
    return segs.withColumn("kept", _accepted(config, "flush_t"))


def sessionize_logged(log: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """(stream_key, seq, ts|ts_us, kind incl. tick/flush, app_id, workspace) -> sessions."""
    segs = min_duration(_segments(logged_rows(log, config, all_rows=False), config))
    return merge_runs(_run_islands_plain(segs)).select(*SESSION_COLUMNS)


def response_log_logged(log: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """S10 for X2: (stream_key, ts_us, seq, kind, response) of every row, ticks and flushes too."""
    rows = saved(logged_rows(log, config), "logged-replies")
    moves = F.col("state").isNotNull() | F.col("saves")
    segs = _run_islands_plain(min_duration(_segments(rows.filter(moves), config))).select(KEY, "segno", "_run_start")
    rows = rows.filter(F.col("kind").isin(TICK, FLUSH)).select(KEY, *ORDER, "kind", "segno", "saves", "taken", "again")
    # a save that passes P3 is in a kept segment; the first of a segment merges if its run began before
    asks = F.col("taken") & ~F.col("again")
    first = rows.filter(asks).join(segs, [KEY, "segno"]).withColumn("grows", ~F.col("_run_start")).drop("_run_start")
    rows = rows.filter(~asks).withColumn("grows", F.lit(True)).unionByName(first)
    reply = (
        F.when(F.col("segno") == 0, "Ignored")
        .when(~F.col("saves"), "Handled")
        .when(~F.col("taken"), "Ignored")
        .when(F.col("grows"), "Flushed(merged)")
        .otherwise("Flushed")
    )
    acts = rows.select(KEY, *ORDER, "kind", reply.alias("response"))
    ev = prepare_events(log).filter(~F.col("kind").isin(TICK, FLUSH))
    return timed_responses(ev, config).select(KEY, *ORDER, "kind", "response").unionByName(acts)


def hourly_ticks(events: DataFrame, horizon: int, every: int = 3600, kind: str = TICK) -> DataFrame:
    """Explicit tick rows for a log: every ``every`` seconds from the first full
    period after a stream's first event through ``horizon``. A tick at second s
    sorts after all events of that second, a flush after the tick."""
    first = events.groupBy(KEY).agg(F.min("t").alias("_t0"))
    # a row per stream is little and would be read by few tasks, but its ticks are many
    first = first.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), KEY, "_t0")
    start = (F.col("_t0") - F.pmod(F.col("_t0"), F.lit(every)) + F.lit(every)).cast("long")
    stop = F.lit(horizon).cast("long")
    grid = F.when(start <= stop, F.sequence(start, stop, F.lit(every).cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    ticks = first.select(KEY, F.explode(grid).alias("t"))
    return ticks.select(
        KEY,
        F.lit(2**62 + (kind == FLUSH)).cast("long").alias("seq"),
        (F.col("t") * F.lit(1_000_000) + F.lit(999_999)).alias("ts_us"),
        "t",
        F.lit(kind).alias("kind"),
        F.lit(None).cast("string").alias("app_id"),
        F.lit(None).cast("int").alias("workspace"),
    )
