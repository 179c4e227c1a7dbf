"""Sessionize event streams with Structured Streaming.

Plan: ``readStream`` (one or more producers, unioned: X7) -> event-time column ->
``withWatermark`` -> ``groupBy(group of streams).transformWithStateInPandas`` (the only
shuffle) -> ``foreachBatch`` upsert sink (X8).

A key of the state is a group of streams (`GROUPS`, by hash), not a stream: a call from Python to the state store costs
more than the rules cost for many rows, and a group of many streams makes as many calls as a group of one. Its state is a
value with what is known of each of its streams (the O(1) machine of ``streaming.machine``, the buckets where it has
rows, its next saving flush), and a map of entries with the rows that the watermark has not passed. Rows that arrive together
and are few lie in one entry (`RUN_ROWS`); of more, an entry takes as long a time as lies between the
first of them and its own first, so a row is written again a few times at most before its turn comes. An entry has `ENTRY_ROWS` rows at most, and
no arrival rewrites one that is larger than what arrives.
Event-time timers drive the rest (X4):

- each entry has one at the end of its first row's bucket. When the watermark passes it, the rows of all buckets that are
  complete are replayed in ``(ts_us, seq)`` order (arrival order does not matter), and their streams' virtual 1 Hz
  clocks run up to the last second that the watermark has closed (capped at the horizon). The rest of an entry becomes
  one of a later bucket. A group's other timers of the same watermark find nothing left and touch no state;
- a group has one at the first next saving flush of its streams: those with an open segment and no row before that flush. A silent stream
  wakes for nothing else: flushes that the minimum duration would ignore get no timer.

Idle transitions (X5) are ordinary events of the machine. Rows later than the watermark
are dropped by Spark; those that slip through are counted in the state (``late``).

A producer may send heartbeats (``kind = 'heartbeat'``): rows that only move the watermark.
They are told apart by their kind, never by a key, so every ``stream_key`` is a user's.

Output rows are upserts ``(stream_key, session_seq, start, end, state, version)``. The sink writes each
micro-batch to its own folder under the id that Spark gave the checkpoint (a retry overwrites it), and
merges `FAN` folders of a level into one of the next, newest version per key, so a long run leaves few
folders. ``read_compacted`` keeps the newest version per key (S4).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sessionlake import schema
from sessionlake.config import SessionConfig
from sessionlake.operators.sessionize import prepare_events
from sessionlake.sources.store import KEY, _fs, compact_versions
from sessionlake.streaming.machine import CLOCK, LATE, MachineState, SessionMachine

#: Waiting rows: a letter of `LETTERS` per row, and JSON with a list per column (`Row`, then the kinds that have no letter).
ROWS = "kinds string, columns string"
LETTERS = {"focus": "f", "workspace": "w", "idle_on": "i", "idle_off": "o", "tick": "t", "flush": "s"}
KINDS = {letter: kind for kind, letter in LETTERS.items()}
UPSERT_SCHEMA = schema.SESSION_CHANGES
#: Kind of the rows that only move the watermark; they belong to no stream.
HEARTBEAT = "heartbeat"
#: Seconds of event time whose waiting rows are replayed together.
BUCKET_SECONDS = 3600
#: Rows of several buckets that one entry of the state takes in any case, and the most that it takes.
RUN_ROWS = 64
ENTRY_ROWS = 16_384
#: Groups of streams, each a key of the state.
GROUPS = 4096
#: Groups that a task remembers as up to date.
KNOWN_CURRENT = 100_000
#: Batch folders of a level that become one of the next.
FAN = 8


class Row(NamedTuple):
    """A waiting row; ``stream`` is the key as text, empty for null."""

    ts_us: int
    seq: int
    stream: str
    app_id: str | None
    workspace: int | None
    kind: str


class Stream:
    """What is known of a stream: its machine, the buckets that hold rows of it, and the second of its next saving flush."""

    __slots__ = ("due", "machine", "pending")

    def __init__(self, machine: list | None = None, pending: list | None = None, due: int | None = None):
        self.machine, self.pending, self.due = machine or MachineState().to_list(), set(pending or ()), due

    def to_list(self) -> list:
        return [self.machine, [*self.pending], self.due]


def pack_rows(rows: list[Row]) -> tuple[str, str]:
    *columns, kinds = map(list, zip(*rows, strict=True))
    return "".join([LETTERS.get(k, "?") for k in kinds]), json.dumps([*columns, [k for k in kinds if k not in LETTERS]])


def unpack_rows(packed: tuple[str, str]) -> list[Row]:
    *columns, odd = json.loads(packed[1])
    odd = iter(odd)
    return [*map(Row, *columns, [KINDS.get(k) or next(odd) for k in packed[0]])]


class SessionProcessor(StatefulProcessor):
    """The session rules over a group's streams, each one's rows in order of event time.

    Frames without a ``stream_key`` are of one stream, the group's key.
    """

    def __init__(self, config: SessionConfig, horizon: int | None, bucket: int):
        self.config, self.horizon, self.bucket = config, horizon, int(bucket)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current: dict[tuple, int] = {}  # groups that have come up to a watermark in this task
        self.known = handle.getValueState("streams", "streams string, entries string, flush bigint")
        self.rows = handle.getMapState("rows", "entry bigint", ROWS)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict[str, Stream], dict[int, list[int]], int | None]:
        """The streams, the entries' first buckets and sizes, and the second of the flush that has a timer."""
        streams, entries, flush = self.known.get() or ("{}", "[]", None)
        return {name: Stream(*v) for name, v in json.loads(streams).items()}, {n: v for n, *v in json.loads(entries)}, flush

    def _store(self, streams: dict[str, Stream], entries: dict[int, list[int]], flush: int | None) -> None:
        self.known.update((json.dumps({name: s.to_list() for name, s in streams.items()}), json.dumps([[n, *v] for n, v in entries.items()]), flush))

    def _end_ms(self, bucket: int) -> int:
        return (bucket + 1) * self.bucket * 1000

    def _keep(self, rows: list[Row], entries: dict[int, list[int]]) -> None:
        """Put waiting rows into entries, each with a timer at the end of its first bucket."""
        of: dict[int, list[Row]] = {}
        width = self.bucket * 1_000_000
        for row in rows:
            of.setdefault(row[0] // width, []).append(row)
        new: list[tuple[int, list[Row]]] = []
        reach = None  # the bucket up to which the newest entry goes
        for bucket in sorted(of):
            both = len(new[-1][1]) + len(of[bucket]) if new else 0
            if new and (both <= RUN_ROWS or (bucket < reach and both <= ENTRY_ROWS)):
                new[-1][1].extend(of[bucket])
            else:
                reach = 2 * bucket - min(of)
                new += [(bucket, of[bucket][i : i + ENTRY_ROWS]) for i in range(0, len(of[bucket]), ENTRY_ROWS)]
        small: dict[int, int] = {}
        for n, (bucket, size) in entries.items():
            small[bucket] = n if bucket not in small or size < entries[small[bucket]][1] else small[bucket]
        free = max(entries, default=-1) + 1
        for bucket, got in new:
            n = small.pop(bucket, None)
            if n is not None and entries[n][1] <= max(RUN_ROWS, len(got)) and entries[n][1] + len(got) <= ENTRY_ROWS:
                got = unpack_rows(self.rows.getValue((n,))) + got
            else:
                n, free = free, free + 1
                self.handle.registerTimer(self._end_ms(bucket))
            entries[n] = [bucket, len(got)]
            self.rows.updateValue((n,), pack_rows(got))

    def _set_flush(self, flush: int | None, streams: dict[str, Stream], entries: dict[int, list[int]], fired: int) -> int | None:
        """Move the flush's timer to the first one due."""
        nxt = min((s.due for s in streams.values() if s.due is not None), default=None)
        if flush is not None and flush != nxt and (flush + 1) * 1000 > fired and all(self._end_ms(b) != (flush + 1) * 1000 for b, _ in entries.values()):
            self.handle.deleteTimer((flush + 1) * 1000)  # it hasn't fired, and isn't an entry's too
        if nxt is not None and nxt != flush:
            self.handle.registerTimer((nxt + 1) * 1000)
        return nxt

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streams, entries, flush = self._load()
        self.current.pop(key, None)
        fresh: list[Row] = []
        for pdf in rows:
            names = pdf["stream_key"].tolist() if "stream_key" in pdf else [str(key[0])] * len(pdf)
            apps = [None if no else str(v) for v, no in zip(pdf["app_id"].tolist(), pdf["app_id"].isna().tolist(), strict=True)]
            spaces = [None if no else int(v) for v, no in zip(pdf["workspace"].tolist(), pdf["workspace"].isna().tolist(), strict=True)]
            fresh += map(Row, map(int, pdf["ts_us"].tolist()), map(int, pdf["seq"].tolist()), names, apps, spaces, map(str, pdf["kind"].tolist()))
        for name in {row[2] for row in fresh}:
            streams.setdefault(name, Stream())
        closed = {name: s.machine[CLOCK] * 1_000_000 for name, s in streams.items() if s.machine[CLOCK] is not None}
        late = [row for row in fresh if row[0] < closed.get(row[2], row[0])]
        for row in late:
            streams[row[2]].machine[LATE] += 1  # its second was already closed by the virtual clock
        if late:
            fresh = [row for row in fresh if row[0] >= closed.get(row[2], row[0])]
        for row in fresh:
            streams[row[2]].pending.add(row[0] // (self.bucket * 1_000_000))
        self._keep(fresh, entries)
        for s in streams.values():
            if s.due is not None and s.pending and min(s.pending) * self.bucket <= s.due:
                s.due = None  # the bucket's own timer comes with rows to apply first
        self._store(streams, entries, self._set_flush(flush, streams, entries, -1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.current.get(key) == watermark:
            return  # another timer of this watermark has done it all
        if len(self.current) >= KNOWN_CURRENT:
            self.current.clear()
        self.current[key] = watermark
        streams, entries, flush = self._load()
        held: list[Row] = []
        for n in [n for n, (bucket, _) in entries.items() if self._end_ms(bucket) <= watermark]:
            held += unpack_rows(self.rows.getValue((n,)))
            self.rows.removeKey((n,))
            del entries[n]
        closed = watermark // (self.bucket * 1000) * self.bucket * 1_000_000  # where the first incomplete bucket begins
        self._keep([r for r in held if r[0] >= closed], entries)
        for s in streams.values():
            s.pending = {b for b in s.pending if self._end_ms(b) > watermark}
        ready: dict[str, list[Row]] = {name: [] for name, s in streams.items() if s.due is not None and (s.due + 1) * 1000 <= watermark}
        for row in sorted(held, key=itemgetter(0, 1)):
            if row[0] >= closed:
                break
            ready.setdefault(row[2], []).append(row)
        changed: list[tuple] = []
        for name, todo in ready.items():
            changed += self._replay(name, streams[name], todo, watermark)
        self._store(streams, entries, self._set_flush(flush, streams, entries, watermark))
        if changed:
            out = pd.DataFrame(changed, columns=[f.name for f in UPSERT_SCHEMA.fields], dtype="object")  # inferred, keys beside a null would be floats
            yield out.astype({"stream_key": "Int64", "session_seq": "int32", "start": "int64", "end": "int64", "is_active": "bool", "workspace": "Int32", "version": "int64"})

    def _replay(self, name: str, stream: Stream, rows: list[Row], watermark: int) -> list[tuple]:
        """Apply a stream's rows, run its clock as far as it is known to be silent; the sessions that change."""
        c, first = self.config, min(stream.pending, default=None)
        machine = SessionMachine(c.flush_interval, c.min_session_duration, c.hidden_applications, MachineState.from_list(stream.machine))
        for ts_us, _, _, app, ws, kind in rows:
            machine.event_with_ticks(kind, ts_us // 1_000_000, app, ws)
        clock = watermark // 1000 - 1  # every second strictly before the watermark's is closed
        if first is not None:
            clock = min(clock, first * self.bucket - 1)
        machine.ticks_through(clock if self.horizon is None else min(clock, int(self.horizon)))
        stream.due = self._next_flush(machine, first)
        key = int(name) if name else None
        changes = [(key, seq, start, end, *st, version) for seq, start, end, st, version in machine.take_changes()]
        stream.machine = machine.s.to_list()
        return changes

    def _next_flush(self, machine: SessionMachine, first: int | None) -> int | None:
        """The second of the next flush that saves something, if no row may come before it."""
        s, c = machine.s, self.config
        if s.open is None or s.clock is None:
            return None
        due = max(s.clock, s.last_due + c.flush_interval)
        short = c.min_session_duration + 1 - (due - s.open[0]) if c.min_session_duration else 0
        if short > 0:
            due += -(-short // c.flush_interval) * c.flush_interval
        if (first is not None and due >= first * self.bucket) or (self.horizon is not None and due > self.horizon):
            return None
        return due


def event_time(events: DataFrame) -> DataFrame:
    """Add ``event_time`` (TIMESTAMP from ``ts_us``) for the watermark."""
    ev = prepare_events(events)
    return ev.withColumn("event_time", F.timestamp_micros("ts_us"))


def sessionize_stream(
    events: DataFrame,
    config: SessionConfig = SessionConfig(),
    horizon: int | None = None,
    watermark_delay: str = "1 day",
    bucket_seconds: int = BUCKET_SECONDS,
    groups: int = GROUPS,
) -> DataFrame:
    """Streaming DataFrame of events -> streaming DataFrame of session upserts.

    Sessions appear once the watermark has passed their bucket of ``bucket_seconds``. Needs the RocksDB state
    store; a checkpoint goes with one ``bucket_seconds`` and one number of ``groups``.
    """
    group = F.pmod(F.xxhash64("stream_key"), F.lit(int(groups))).alias("stream_group")
    name = F.coalesce(F.col("stream_key").cast("string"), F.lit("")).alias("stream_key")  # a null would make the frame's keys floats
    ev = event_time(events).select(
        group, name, "seq", "ts_us", "event_time", "kind", "app_id", F.col("workspace").cast("int").alias("workspace")
    )
    upserts = T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name == "stream_key") for f in UPSERT_SCHEMA.fields])
    # heartbeats go after they have moved the watermark: the condition names the event time, so the
    # optimizer keeps it above the watermark
    heartbeat = (F.col("kind") == HEARTBEAT) & F.col("event_time").isNotNull()
    return (
        ev.withWatermark("event_time", watermark_delay)
        .filter(~heartbeat)
        .groupBy("stream_group")
        .transformWithStateInPandas(SessionProcessor(config, horizon, bucket_seconds), outputStructType=upserts, outputMode="Update", timeMode="EventTime")
    )


def run_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id that Spark wrote into a checkpoint when its query first started; None before that."""
    fs, path = _fs(spark, f"{checkpoint.rstrip('/')}/metadata")
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(path.toString()).first()[0])["id"]


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What stands after ``prefix`` in the names of a folder's entries."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(n[len(prefix) :] for s in fs.listStatus(jpath) if (n := s.getPath().getName()).startswith(prefix))


def upsert_sink(spark: SparkSession, path: str, checkpoint: str):
    """``foreachBatch`` writer; each batch id of a run owns one folder (retries overwrite it).

    Versions and batch ids count from the run's own state, so one folder holds one run. A checkpoint that
    is another run's, or a new one (also at the path of one that was deleted), is refused before anything is written.
    """
    root = path.rstrip("/")

    def own() -> str | None:
        name = run_id(spark, checkpoint)
        if any(n != name for n in _names(spark, root, "run_id=")):
            raise ValueError(f"{root} holds the sessions of another run; use a new folder or that run's checkpoint")
        return name

    own()

    def write(batch: DataFrame, batch_id: int) -> None:
        run = f"{root}/run_id={own()}"
        batch.write.mode("overwrite").parquet(f"{run}/level=0/batch_id={int(batch_id)}")
        merge_levels(spark, run)

    return write


def merge_levels(spark: SparkSession, run: str) -> None:
    """Merge every `FAN` batch folders of a level into one of the next, the newest version of each key.

    The merged folder is complete before its parts go; a failure in between leaves rows twice, which
    readers see once, by version.
    """
    for level in range(64):
        parts = sorted(int(n) for n in _names(spark, f"{run}/level={level}", "batch_id="))
        if len(parts) < FAN:
            return
        paths = [f"{run}/level={level}/batch_id={n}" for n in parts]
        rows = spark.read.schema(UPSERT_SCHEMA).parquet(*paths)
        newest = F.max_by(F.struct(*(c for c in rows.columns if c not in KEY)), "version").alias("row")
        rows = rows.groupBy(*KEY).agg(newest).select(*KEY, "row.*")
        rows.write.mode("overwrite").parquet(f"{run}/level={level + 1}/batch_id={parts[-1]}")
        for p in paths:
            fs, jpath = _fs(spark, p)
            fs.delete(jpath, True)


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """The session table from the upsert log: newest version per (stream_key, session_seq)."""
    folders = [T.StructField("run_id", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("batch_id", T.LongType())]
    versions = spark.read.schema(T.StructType(UPSERT_SCHEMA.fields + folders)).parquet(path)
    return compact_versions(versions).select(*[f.name for f in schema.SESSIONS.fields])


def run_to_completion(
    spark: SparkSession,
    upserts: DataFrame,
    sink_path: str,
    checkpoint: str,
) -> None:
    """Drive a streaming query over everything available now, then stop."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):  # the state needs RocksDB
        spark.conf.set(
            key,
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    try:
        query = _start(spark, upserts, sink_path, checkpoint)
    finally:  # the setting is the query's own: it is recorded in its checkpoint
        if current is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, current)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def _start(spark: SparkSession, upserts: DataFrame, sink_path: str, checkpoint: str):
    return (
        upserts.writeStream.outputMode("update")
        .foreachBatch(upsert_sink(spark, sink_path, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
