"""Audit tables derived from the sessionizer's intermediate columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.config import SessionConfig
from sessionlake.operators.sessionize import (
    event_states,
    min_duration,
    prepare_events,
    run_islands,
    segments,
)

# The reference's response names.
HANDLED = "Handled"
IGNORED = "Ignored"
SESSION_CREATED = "SessionCreated"
SESSION_IDLED_TRUE = "SessionIdled(true)"
SESSION_IDLED_FALSE = "SessionIdled(false)"


def response_log(events: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """One response per input event (ticks are virtual and not listed): stream_key, seq, kind, response."""
    return timed_responses(events, config).drop("ts_us")


def timed_responses(events: DataFrame, config: SessionConfig) -> DataFrame:
    """The rows of `response_log` with their ``ts_us``.

    Non-workspace, non-hidden rows take their response from the state before the
    event. Hidden focus rows (Ignored) and workspace rows (Handled) need no
    window, so they are a map-only branch of the same scan.
    """
    ev = prepare_events(events)
    states = event_states(ev, config)
    b_act = F.col("before.is_active")
    kind = F.col("kind")
    resp = (
        F.when(kind == "focus", F.lit(SESSION_CREATED))
        .when(
            kind == "idle_on",
            F.when(F.col("before").isNull(), F.lit(HANDLED))
            .when(~b_act, F.lit(IGNORED))
            .otherwise(F.lit(SESSION_IDLED_TRUE)),
        )
        .when(
            kind == "idle_off",
            F.when(F.col("before").isNull() | b_act, F.lit(IGNORED))
            .when(F.col("old_state").isNotNull(), F.lit(SESSION_IDLED_FALSE))
            .otherwise(F.lit(HANDLED)),
        )
    )
    main = states.select("stream_key", "ts_us", "seq", "kind", resp.alias("response"))
    hidden = list(config.hidden_applications)
    side = ev.filter(
        (F.col("kind") == "workspace")
        | ((F.col("kind") == "focus") & F.col("app_id").isin(hidden) if hidden else F.lit(False))
    ).select(
        "stream_key",
        "ts_us",
        "seq",
        "kind",
        F.when(F.col("kind") == "workspace", F.lit(HANDLED)).otherwise(F.lit(IGNORED)).alias("response"),
    )
    return main.unionByName(side)


def flush_log(
    events: DataFrame, config: SessionConfig = SessionConfig(), horizon: int | None = None
) -> DataFrame:
    """Every accepted flush, as the insert/update journal of the session table.

    Per kept segment: the accepted grid flushes (``explode(sequence(lo, hi, I))``
    from the first grid point longer than the minimum to the last one) plus the
    idle flush at the next opener. ``merged`` is false only for the first flush
    of the first segment of a run (an insert); all others update the run.
    Columns: stream_key, session_seq, flush_t, merged.
    """
    segs = run_islands(min_duration(segments(events, config, horizon)))
    interval = int(config.flush_interval)
    m = int(config.min_session_duration)
    start = F.col("start")
    if config.flush == "interval":
        t1 = F.col("grid_t1")
        low = F.greatest(start, t1) if m == 0 else F.greatest(start + F.lit(m + 1), t1)
        # first grid point >= low
        gap = low - t1
        lo = t1 + gap + F.pmod(-gap, F.lit(interval))
        idle_flush = (F.col("next_kind") == "idle_on") & F.col("state.is_active")
        hi = F.when(idle_flush, F.col("end_t") - 1 - F.pmod(F.col("end_t") - 1 - t1, F.lit(interval))).otherwise(
            F.col("flush_t")
        )
        grid = F.when(hi >= lo, F.sequence(lo, hi, F.lit(interval).cast("long"))).otherwise(
            F.array().cast("array<bigint>")
        )
        times = F.when(idle_flush, F.concat(grid, F.array(F.col("flush_t")))).otherwise(grid)
    else:
        times = F.array(F.col("flush_t"))
    out = segs.select(
        "stream_key",
        "session_seq",
        "seq",
        F.posexplode(times).alias("_pos", "flush_t"),
        F.col("_run_start"),
    )
    return out.select(
        "stream_key",
        "session_seq",
        F.col("flush_t").cast("long").alias("flush_t"),
        (~((F.col("_pos") == 0) & F.col("_run_start"))).alias("merged"),
    )


# ---------------------------------------------------------------- V1


def check_sessions(sessions: DataFrame) -> DataFrame:
    """V1: every row with ``violation`` = the broken rules joined by ';' (empty = good).

    Rules: NOT NULL columns present; ``end >= start``; active => app_id present;
    idle => no app_id and no workspace.
    """
    reasons = F.concat_ws(
        ";",
        F.when(F.col("start").isNull(), F.lit("start is null")),
        F.when(F.col("end").isNull(), F.lit("end is null")),
        F.when(F.col("is_active").isNull(), F.lit("is_active is null")),
        F.when(F.col("end") < F.col("start"), F.lit("end before start")),
        F.when(F.col("is_active") & F.col("app_id").isNull(), F.lit("active without app_id")),
        F.when(~F.col("is_active") & F.col("app_id").isNotNull(), F.lit("idle with app_id")),
        F.when(~F.col("is_active") & F.col("workspace").isNotNull(), F.lit("idle with workspace")),
    )
    return sessions.withColumn("violation", reasons)


def split_checked(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V1 as (good rows, rejected rows with reason)."""
    checked = check_sessions(sessions)
    good = checked.filter(F.col("violation") == "").drop("violation")
    bad = checked.filter(F.col("violation") != "")
    return good, bad
