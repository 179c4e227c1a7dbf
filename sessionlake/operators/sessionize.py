"""Batch sessionizing (X1) as a closed form over window functions.

The reference runs a state machine per user, driven by a 1 Hz tick. Its result
does not need recursion: every quantity is a running "last non-null" value, a
lag or a lead over the events of one ``stream_key`` ordered by ``(ts_us, seq)``.
All windows share one partitioning and one sort, so the whole job is one shuffle
on ``stream_key``; the final per-run aggregate reuses that partitioning.

Steps (P2 drop_hidden, W1 fill_workspace, P8/W2 event states, W3 segments,
P3 min_duration, W4 run islands, A8 merge runs):

1. Hidden focus rows are dropped before any window (they change nothing).
2. ``ws`` = last workspace seen up to the row; then workspace rows go.
3. ``own`` = state a row sets (focus: its app or idle; idle_on: idle).
4. ``drv`` = last ``own`` strictly before; ``old`` = last state that an idle_on
   saved (``drv`` when active); ``after`` = state after the row; ``before`` = lag.
5. A row opens a segment if it is a focus row or its state differs from before.
6. A segment's flush: the next opener's time when that is an idle_on on an active
   segment, else the last grid point ``t1 + k*interval`` before the next opener
   (ticks of second s come after the events of second s). Boundary mode flushes
   at the next opener.
7. Kept flushes (longer than the minimum) are grouped into runs of equal state:
   a run is one session from its first start to its last flush.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.config import SessionConfig
from sessionlake.functions.scalar import idle_state, state, to_seconds, ts_micros

KEY = "stream_key"
ORDER = ("ts_us", "seq")


def stream_window():
    return Window.partitionBy(KEY).orderBy(*ORDER)


def _prior():
    return stream_window().rowsBetween(Window.unboundedPreceding, -1)


def _upto():
    return stream_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def prepare_events(events: DataFrame) -> DataFrame:
    """Add ``ts_us`` and ``t`` (whole seconds) when the input carries only ``ts``."""
    df = events
    if "ts_us" not in df.columns:
        df = df.withColumn("ts_us", ts_micros(df, "ts"))
    if "t" not in df.columns:
        df = df.withColumn("t", to_seconds("ts_us"))
    return df


def drop_hidden(events: DataFrame, hidden_applications) -> DataFrame:
    """Remove focus rows of hidden apps (before any window function).

    A short literal list becomes an ``isin`` predicate. A DataFrame of app ids
    (column ``app_id``) becomes a left anti join; Spark picks broadcast or a
    shuffle from its size estimate, so no unbounded broadcast is forced.
    """
    if isinstance(hidden_applications, DataFrame):
        hidden = hidden_applications.select(F.col("app_id").alias("_hidden_app")).distinct()
        focus = events.filter(F.col("kind") == "focus")
        rest = events.filter(F.col("kind") != "focus")
        kept = focus.join(hidden, focus["app_id"] == hidden["_hidden_app"], "left_anti")
        return kept.unionByName(rest)
    hidden = list(hidden_applications or ())
    if not hidden:
        return events
    is_hidden = (F.col("kind") == "focus") & F.col("app_id").isin(hidden)
    return events.filter(~F.coalesce(is_hidden, F.lit(False)))


def fill_workspace(events: DataFrame) -> DataFrame:
    """``ws`` = latest workspace at each event (forward fill, D6)."""
    ws = F.last(F.when(F.col("kind") == "workspace", F.col("workspace")), ignorenulls=True)
    return events.withColumn("ws", ws.over(_upto()).cast("int"))


def own_state() -> Column:
    """The state a row sets (focus: its app on the current workspace ``ws``, or
    idle when focus is lost; idle_on: idle); NULL for rows that set none."""
    kind = F.col("kind")
    return F.when(
        kind == "focus",
        F.when(F.col("app_id").isNotNull(), state(F.lit(True), F.col("app_id"), F.col("ws"))).otherwise(
            idle_state()
        ),
    ).when(kind == "idle_on", idle_state())


def saved_state() -> Column:
    """The state an idle_on row saves for a later return (``_drv`` when active)."""
    return F.when(
        (F.col("kind") == "idle_on") & F.coalesce(F.col("_drv.is_active"), F.lit(False)), F.col("_drv")
    )


def after_state() -> Column:
    """State after a row from its own state, the last set state (``_drv``) and the saved one (``_old``)."""
    kind = F.col("kind")
    return (
        F.when((kind == "focus") | (kind == "idle_on"), F.col("_own"))
        .when(F.col("_drv").isNull(), F.lit(None))
        .when(F.col("_drv.is_active"), F.col("_drv"))
        .otherwise(F.coalesce(F.col("_old"), idle_state()))
    )


def _event_states_plain(events: DataFrame, config: SessionConfig) -> DataFrame:
    """P8 + W2 on the plain plan (all of a stream in one window partition).

    Output keeps the input columns plus ``ws``, ``before`` and ``after`` (structs
    of is_active, app_id, workspace; NULL = no current session yet).
    """
    ev = fill_workspace(drop_hidden(prepare_events(events), config.hidden_applications))
    ev = ev.filter(F.col("kind") != "workspace")
    ev = ev.withColumn("_own", own_state())
    ev = ev.withColumn("_drv", F.last("_own", ignorenulls=True).over(_prior()))
    ev = ev.withColumn("_old", F.last(saved_state(), ignorenulls=True).over(_prior()))
    ev = ev.withColumn("after", after_state())
    ev = ev.withColumn("before", F.lag("after").over(stream_window()))
    return ev.withColumnRenamed("_old", "old_state").drop("_own", "_drv")


def is_opener() -> Column:
    return F.col("after").isNotNull() & (
        (F.col("kind") == "focus") | ~F.col("after").eqNullSafe(F.col("before"))
    )


def finish_segments(ev: DataFrame, config: SessionConfig) -> DataFrame:
    """Flush time and P3 for opener rows carrying ``start``, ``state``, ``_next_t``,
    ``next_kind``, ``_first_t`` (first opener of the key) and ``_horizon``."""
    interval = F.lit(int(config.flush_interval))
    end_t = F.coalesce(F.col("_next_t"), F.col("_horizon") + 1)
    if config.flush == "interval":
        t1 = F.greatest(F.col("_first_t"), interval)
        span = end_t - 1 - t1
        last_grid = t1 + span - F.pmod(span, interval)
        flush_t = F.when(
            (F.col("next_kind") == "idle_on") & F.col("state.is_active"), F.col("_next_t")
        ).when(last_grid >= F.col("start"), last_grid)
    else:
        flush_t = F.coalesce(F.col("_next_t"), F.col("_horizon"))
    m = int(config.min_session_duration)
    ev = ev.withColumn("end_t", end_t).withColumn("flush_t", flush_t.cast("long"))
    # origin of the flush grid (first opener of the key, at least one interval)
    ev = ev.withColumn("grid_t1", F.greatest(F.col("_first_t"), interval))
    kept = F.col("flush_t").isNotNull() & (
        F.lit(m == 0) | ((F.col("flush_t") - F.col("start")) > F.lit(m))
    )
    return ev.withColumn("kept", kept).drop("_next_t", "_first_t", "_horizon")


def _segments_plain(events: DataFrame, config: SessionConfig, horizon: int | None) -> DataFrame:
    """W3 on the plain plan.

    Without a horizon each stream ends at the last second of any of its rows (hidden apps and
    workspace rows too): an aggregate that reads the key and the time, joined by the key that the
    windows are partitioned by.
    """
    events = prepare_events(events)
    ev = _event_states_plain(events, config).filter(is_opener())
    if horizon is None:
        last = events.groupBy(KEY).agg(F.max("t").alias("_horizon"))
        ev = ev.join(last, KEY)
    else:
        ev = ev.withColumn("_horizon", F.lit(horizon))
    w = stream_window()
    ev = ev.select(
        KEY,
        "seq",
        "ts_us",
        F.col("t").alias("start"),
        F.col("after").alias("state"),
        F.lead("t").over(w).alias("_next_t"),
        F.lead("kind").over(w).alias("next_kind"),
        F.first("t").over(_upto()).alias("_first_t"),
        "_horizon",
    )
    return finish_segments(ev, config)


def min_duration(segs: DataFrame) -> DataFrame:
    """Keep only segments whose last flush passed the duration filter."""
    return segs.filter(F.col("kept"))


def _run_islands_plain(kept_segments: DataFrame) -> DataFrame:
    """W4 on the plain plan: number runs of equal state among kept segments (1-based per key)."""
    w = stream_window()
    change = (~F.col("state").eqNullSafe(F.lag("state").over(w))).cast("int")
    changed = kept_segments.withColumn("_chg", F.coalesce(change, F.lit(1)))
    return (
        changed.withColumn("session_seq", F.sum("_chg").over(_upto()).cast("int"))
        .withColumn("_run_start", F.col("_chg") == 1)
        .drop("_chg")
    )


def merge_runs(islands: DataFrame, with_counts: bool = False) -> DataFrame:
    """One session per run: first start, last flush, the run's state.

    The grouping keys start with ``stream_key``, so the aggregate reuses the
    window's hash partitioning (no second exchange).
    """
    return islands.groupBy(
        KEY,
        "session_seq",
        F.col("state.is_active").alias("is_active"),
        F.col("state.app_id").alias("app_id"),
        F.col("state.workspace").alias("workspace"),
    ).agg(
        F.min("start").alias("start"),
        F.max("flush_t").alias("end"),
        *([F.count(F.lit(1)).alias("segments")] if with_counts else []),
    )


SESSION_COLUMNS = ["stream_key", "session_seq", "start", "end", "is_active", "app_id", "workspace"]

# ---------------------------------------------------------------- public entry points
# Every entry point splits hot streams (more than ``hot_key_rows`` rows) from the
# rest: ordinary streams take the plain one-shuffle plan, hot streams the chunked
# plan of ``operators.skew``; results are unioned. ``hot_key_rows=None`` turns the
# split off.

HOT_KEY_ROWS = 5_000_000  # a stream with more rows than this takes the chunked plan
ROWS_PER_CHUNK = 1_000_000  # target rows per time chunk of a hot stream


def _skew():
    from sessionlake.operators import skew

    return skew


def _split(events, config, hot_key_rows, rows_per_chunk):
    """(ordinary rows, hot rows) - or (all rows, None) when no stream is hot.

    The check is one small aggregate job; without hot streams the plan is
    exactly the plain one.
    """
    return _skew().split_hot(prepare_events(events), config, hot_key_rows, rows_per_chunk)


def event_states(
    events: DataFrame,
    config: SessionConfig = SessionConfig(),
    hot_key_rows: int | None = HOT_KEY_ROWS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """P8 + W2: state before and after every non-workspace event.

    Output keeps the input columns plus ``ws``, ``before``, ``after`` (structs of
    is_active, app_id, workspace; NULL = no current session yet) and ``old_state``.
    """
    if hot_key_rows is None:
        return _event_states_plain(events, config)
    cold, hot = _split(events, config, hot_key_rows, rows_per_chunk)
    plain = _event_states_plain(cold, config)
    if hot is None:
        return plain
    chunked = _skew().chunked_event_states(hot, config).select(*plain.columns)
    return plain.unionByName(chunked)


def segments(
    events: DataFrame,
    config: SessionConfig = SessionConfig(),
    horizon: int | None = None,
    hot_key_rows: int | None = HOT_KEY_ROWS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """One row per segment (opener) with its start, end bound and last flush.

    Columns: stream_key, seq, ts_us, start, state, next_kind, end_t (next opener
    or horizon + 1), flush_t (NULL = never flushed), grid_t1, kept (passes P3),
    chunk (NULL for streams on the plain plan).
    """
    cold, hot = (events, None) if hot_key_rows is None else _split(events, config, hot_key_rows, rows_per_chunk)
    plain = _segments_plain(cold, config, horizon).withColumn("chunk", F.lit(None).cast("long"))
    if hot is None:
        return plain
    chunked = _skew().chunked_segments(hot, config, horizon).select(*plain.columns)
    return plain.unionByName(chunked)


def run_islands(kept_segments: DataFrame) -> DataFrame:
    """Number runs of equal state among kept segments (1-based per key).

    Rows of hot streams (``chunk`` set) are numbered with the chunked prefix sum.
    """
    if "chunk" not in kept_segments.columns:
        return _run_islands_plain(kept_segments)
    plain = _run_islands_plain(kept_segments.filter(F.col("chunk").isNull()))
    chunked = _skew().chunked_islands(kept_segments.filter(F.col("chunk").isNotNull()))
    return plain.unionByName(chunked.select(*plain.columns))


def sessionize(
    events: DataFrame,
    config: SessionConfig = SessionConfig(),
    horizon: int | None = None,
    hot_key_rows: int | None = HOT_KEY_ROWS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Event log -> sessions (stream_key, session_seq, start, end, state columns).

    Ordinary streams: one shuffle on ``stream_key``, one sort, all windows, and a
    final aggregate that reuses the partitioning. Hot streams: the chunked plan.
    """
    def plain(ev):
        segs = min_duration(_segments_plain(ev, config, horizon))
        return merge_runs(_run_islands_plain(segs)).select(*SESSION_COLUMNS)

    if hot_key_rows is None:
        return plain(events)
    cold, hot = _split(events, config, hot_key_rows, rows_per_chunk)
    if hot is None:
        return plain(cold)
    hot_segs = min_duration(_skew().chunked_segments(hot, config, horizon))
    hot_sessions = merge_runs(_skew().chunked_islands(hot_segs)).select(*SESSION_COLUMNS)
    return plain(cold).unionByName(hot_sessions)
