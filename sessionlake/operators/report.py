"""Report tables: timeline (R1) and time report (R2/A7), with sorting (O5) and day breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.scalar import (
    human_duration,
    local_date_key,
    local_day,
    local_time,
    state_label,
    timeline_label,
)
from sessionlake.operators.query import query_filtered


def day_break(sessions: DataFrame, offset_seconds: int = 0) -> DataFrame:
    """``new_day`` is true for the first session of each local day (per stream, by start).

    In start order the local day only grows, so "day differs from the previous
    session's day" is "first session of its (stream, day)". The window is keyed by
    (stream_key, day), so a very active stream is split over its days.
    """
    day = local_date_key("start", offset_seconds)
    w = Window.partitionBy("stream_key", "_day")
    first = F.min(F.struct("start", "session_seq")).over(w)
    return (
        sessions.withColumn("_day", day)
        .withColumn("new_day", first == F.struct("start", "session_seq"))
        .drop("_day")
    )


def timeline(
    sessions: DataFrame,
    from_: int | None = None,
    to: int | None = None,
    limit: int | None = None,
    offset_seconds: int = 0,
) -> DataFrame:
    """Filtered sessions in start order, per stream, with display columns.

    Columns: stream_key, session_seq, start, end, position, new_day, day_heading
    (set on the first session of a local day), local_time, duration_text, label.
    The limit applies per stream (the reference reads one user's table).
    """
    page = query_filtered(sessions, from_, to, limit=limit, sort_by_start="asc", per_stream=True)
    out = day_break(page, offset_seconds)
    return out.select(
        "stream_key",
        "session_seq",
        "start",
        "end",
        "position",
        "new_day",
        F.when(F.col("new_day"), local_day("start", offset_seconds)).alias("day_heading"),
        local_time("start", offset_seconds).alias("local_time"),
        human_duration(F.col("end") - F.col("start")).alias("duration_text"),
        timeline_label().alias("label"),
    )


def time_report(
    sessions: DataFrame,
    ascending: bool = True,
    by_time: bool = True,
    from_: int | None = None,
    to: int | None = None,
) -> DataFrame:
    """Time per state plus the two totals, in one pass over the sessions.

    The per-state sums group by ``(stream_key, is_active, app_id, workspace)``;
    sessions coming out of the sessionizer are already hash-partitioned by
    ``stream_key``, so this aggregate adds no shuffle. The totals (A1, A3) are
    window sums over the few state rows of each stream, and the two total rows
    are emitted next to the stream's first state row by one ``explode`` - no
    second aggregate, no union, nothing computed twice. Rows:
    ``kind = 'state'`` with ``label`` (state display text) and ``position`` (O5
    order within the stream: by time or by label, ascending or descending,
    label as tie breaker); ``kind = 'total'`` with label ``Total screen time``
    or ``Idle time`` (0 when there is none) and NULL position.
    """
    df = sessions
    if from_ is not None or to is not None:
        from sessionlake.operators.query import filter_range

        df = filter_range(df, from_, to)
    states = df.groupBy("stream_key", "is_active", "app_id", "workspace").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("seconds")
    )
    states = states.select("stream_key", "is_active", state_label().alias("label"), "seconds")
    key = F.col("seconds") if by_time else F.col("label")
    order = [key.asc() if ascending else key.desc(), F.col("label").asc() if ascending else F.col("label").desc()]
    w = Window.partitionBy("stream_key").orderBy(*order)
    whole = Window.partitionBy("stream_key")
    ranked = states.select(
        "stream_key",
        "label",
        "seconds",
        F.row_number().over(w).cast("long").alias("position"),
        F.coalesce(F.sum(F.when(F.col("is_active"), F.col("seconds"))).over(whole), F.lit(0)).cast("long").alias("_act"),
        F.coalesce(F.sum(F.when(~F.col("is_active"), F.col("seconds"))).over(whole), F.lit(0)).cast("long").alias("_idle"),
    )
    row = lambda kind, label, secs, pos: F.struct(
        F.lit(kind).alias("kind"), label.alias("label"), secs.alias("seconds"), pos.alias("position")
    )
    null_pos = F.lit(None).cast("long")
    mine = row("state", F.col("label"), F.col("seconds"), F.col("position"))
    rows = F.when(
        F.col("position") == 1,
        F.array(
            mine,
            row("total", F.lit("Total screen time"), F.col("_act"), null_pos),
            row("total", F.lit("Idle time"), F.col("_idle"), null_pos),
        ),
    ).otherwise(F.array(mine))
    out = ranked.select("stream_key", F.inline(rows))
    return out.select("stream_key", "kind", "label", "seconds", "position", human_duration("seconds").alias("duration_text"))
