"""producers' message logs as a Spark data source, batch and stream.

A log is a folder per producer, ``<root>/stream_key=<number>/source=<name>``, of text files in order of their
names. Producers append a line for each message, ``<arrival in microseconds>`` tab ``<JSON message>``: the
reference stamps an event when it arrives, so the time is a part of the log, and a line's place is its byte
position in the producer's whole log (the files before it and its offset). Positions grow with the lines, are the same
in a batch, a stream and after a restart, and are the stream's offsets.

Many producers can share a log: a collector's folder, ``<root>/collector=<name>``, holds files of the same kind whose lines
begin with the producer, ``<stream_key>`` tab ``<source, URL-encoded>`` tab (empty: null). A line's place is its position in the
collector's log, so a producer's places grow as well. `write_message_lines` lands such a log: files go with the bytes, not with the producers.

Files are cut into byte ranges, small ones are put together, and tasks read them on their own; a line belongs to the range in which it begins.
A line without its end hasn't arrived yet. Of a line over the size limit one byte more than the limit is kept, so
that it is quarantined without being held. A line without an arrival time is no message: its text is null,
and so it is quarantined too. Files are opened through Arrow's file systems.

With the ``availableNow`` trigger Spark reads such a source in one batch and runs none without data after it: what
the batch's own watermark closes comes out with the next data. Other triggers don't wait for that.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sessionlake import schema
from sessionlake.config import MAX_MESSAGE_SIZE
from sessionlake.functions.scalar import ts_micros

#: Bytes of a file that one task reads.
RANGE_BYTES = 64 << 20
#: What opening a file counts for, in bytes, when small ones are put together.
OPEN_BYTES = 256 << 10
#: Lines that a task hands on at once.
BATCH_LINES = 8192
#: Bytes of a line that are kept: a time, a tab and a message one byte over the limit.
KEPT = 32 + MAX_MESSAGE_SIZE + 1
#: Bytes more of a collector's line, for the producer in front.
PRODUCER_BYTES = 4096
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ARROW = pa.schema([("stream_key", pa.int64()), ("source", pa.string()), ("seq", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("line", pa.string())])


@dataclass
class Range:
    """Lines that begin at bytes ``start`` to ``stop`` of a file; ``base`` bytes of its log lie before the file.

    In a collector's log (``stream_key`` is None) lines name their producers.
    """

    path: str
    stream_key: int | None
    source: str
    base: int
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """What a task reads: a range, or several of small files."""

    parts: list[Range]


@dataclass
class LogFile:
    path: str
    base: int
    size: int


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def logs(root: str) -> dict[tuple[int | None, str], list[LogFile]]:
    """The files of each producer's log, and of each collector's (its key is None), in order."""
    from pyarrow import fs

    system, base = _open(root)
    found = defaultdict(list)
    for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        parts = dict(p.partition("=")[::2] for p in info.path[len(base) :].split("/")[:-1])
        if info.is_file and "stream_key" in parts and "source" in parts and not info.base_name.startswith(("_", ".")):
            found[int(parts["stream_key"]), parts["source"]].append(info)
        elif info.is_file and "collector" in parts and not info.base_name.startswith(("_", ".")):
            found[None, parts["collector"]].append(info)
    out = {}
    for key, infos in found.items():
        files, before = [], 0
        for info in sorted(infos, key=lambda i: i.path):
            files.append(LogFile(info.path, before, info.size))
            before += info.size
        out[key] = files
    return out


def ranges(files: list[LogFile], key: tuple[int | None, str], begin: int, end: int, step: int) -> Iterator[Range]:
    """Ranges of a log's bytes from ``begin`` to ``end``."""
    for f in files:
        lo, hi = max(begin - f.base, 0), min(end - f.base, f.size)
        for start in range(lo, hi, step):
            yield Range(f.path, *key, f.base, start, min(start + step, hi))


def packed(parts: Iterator[Range], step: int) -> list[InputPartition]:
    """The ranges, small ones put together up to ``step`` bytes."""
    out, room = [], 0
    for part in parts:
        size = part.stop - part.start + OPEN_BYTES
        if not out or size > room:
            out.append(Ranges([]))
            room = step
        out[-1].parts.append(part)
        room -= size
    return out


def lines_of(f, start: int, stop: int, kept: int = KEPT) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end, ``kept`` bytes at most) of the complete lines that begin from ``start`` to ``stop``."""
    at = max(start - 1, 0)
    f.seek(at)
    reader = io.BufferedReader(f, 1 << 20)
    passed = start == 0  # else the line that holds the byte before belongs to the range before
    while at < stop or not passed:
        first = reader.readline(kept)
        size, last = len(first), first
        while last and not last.endswith(b"\n"):
            last = reader.readline(1 << 16)
            size += len(last)
        if not last:
            return  # its end hasn't arrived
        if passed:
            yield at, first.rstrip(b"\r\n")
        passed = True
        at += size


def _producer(raw: bytes) -> tuple[int | None, str | None, bytes]:
    """The producer in front of a collector's line, and the rest; a line that names none is no message."""
    key, _, rest = raw.partition(b"\t")
    source, tab, rest = rest.partition(b"\t")
    try:
        return int(key) if key else None, unquote_plus(source.decode()) if source else None, rest if tab else b""
    except ValueError:
        return None, None, b""


def _batch(part: Range, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    seqs, times, texts, keys, sources = [], [], [], [part.stream_key] * len(rows), [part.source] * len(rows)
    shared = part.stream_key is None
    for i, (at, raw) in enumerate(rows):
        if shared:
            keys[i], sources[i], raw = _producer(raw)
        stamp, tab, message = raw.partition(b"\t")
        known = tab and stamp.isdigit() and len(stamp) < 18
        seqs.append(part.base + at)
        times.append(EPOCH + timedelta(microseconds=int(stamp)) if known else None)
        texts.append(message[:KEPT].decode("utf-8", "replace") if known else None)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sources, pa.string()), pa.array(seqs), pa.array(times, ARROW.field("ts").type), pa.array(texts, pa.string())], schema=ARROW)


def read_range(root: str, part: Range) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    size = 0
    with _open(root)[0].open_input_file(part.path) as f:
        for row in lines_of(f, part.start, part.stop, KEPT + PRODUCER_BYTES * (part.stream_key is None)):
            held.append(row)
            size += len(row[1])
            if len(held) >= BATCH_LINES or size > 8 << 20:
                yield _batch(part, held)
                held, size = [], 0
    if held:
        yield _batch(part, held)


class _Reader:
    def __init__(self, options: dict):
        self.root, self.step = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        for part in partition.parts if partition else ():  # none if there is no log
            yield from read_range(self.root, part)


class LogReader(_Reader, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return packed((r for key, files in logs(self.root).items() for r in ranges(files, key, 0, files[-1].base + files[-1].size, self.step)), self.step)


def _log_name(key: tuple[int | None, str]) -> str:
    return f"{'collector' if key[0] is None else key[0]}/{key[1]}"


class LogStream(_Reader, DataSourceStreamReader):
    """Offsets are the positions up to which each producer's log has been read, always at the end of a line."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system = _open(self.root)[0]
        out = {}
        for key, files in logs(self.root).items():
            f = files[-1]
            out[_log_name(key)] = f.base + _complete(system, f.path, f.size)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = ((key, files, _log_name(key)) for key, files in logs(self.root).items())
        return packed((r for key, files, name in found for r in ranges(files, key, start.get(name, 0), end.get(name, 0), self.step)), self.step)

    def commit(self, end: dict) -> None:
        pass


def _complete(system, path: str, size: int) -> int:
    """Bytes of a file up to the end of its last complete line."""
    with system.open_input_file(path) as f:
        while size:
            low = max(0, size - (1 << 16))
            f.seek(low)
            at = f.read(size - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            size = low
    return 0


class MessageLog(DataSource):
    """``spark.read.format("message_log").load(root)`` -> stream_key, source, seq, ts, line."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self):
        return schema.ENVELOPES_LANDED

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(self.options)


def read_message_lines(spark: SparkSession, path: str, streaming: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The messages of all logs under ``path``: (stream_key, source, seq, ts, line)."""
    spark.dataSource.register(MessageLog)
    reader = spark.readStream if streaming else spark.read
    return reader.format("message_log").option("rangeBytes", range_bytes).load(path)


def write_message_lines(envelopes: DataFrame, path: str, collector: str = "0") -> None:
    """Land envelope rows (stream_key, source, seq, ts, line) as a collector's log; a producer's lines stay in order of (ts, seq).

    Each producer's lines lie in one file, and a file holds many producers.
    """
    text = F.concat(ts_micros(envelopes, "ts").cast("string"), F.lit("\t"), "line")
    parts = (F.col("stream_key").cast("string"), F.url_encode("source"), text)
    line = F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in parts))
    ordered = envelopes.repartition("stream_key", "source").sortWithinPartitions("stream_key", "source", "ts", "seq")
    ordered.select(line.alias("value")).write.text(f"{path.rstrip('/')}/collector={collector}")
