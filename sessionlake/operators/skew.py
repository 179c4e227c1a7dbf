"""Hot streams: the sessionizer's prefix scans split over time chunks.

A stream is sequential by nature, so the plain plan sends all of one
``stream_key`` to one task. When a single stream holds a large share of all
rows (a bot, a replayed device, a mis-keyed producer) that task is the job.
This module splits such streams into time chunks and still computes exactly
the same result.

1. ``hot_streams``: rows, first and last second per stream (a partial
   aggregate over two columns); streams above ``hot_key_rows`` are hot. The
   table has at most ``total_rows / hot_key_rows`` rows - that is its size
   bound, so it is broadcast to tag the events (no shuffle of the events for
   tagging). Only when it is not empty, ``first_setters`` adds each hot
   stream's first state-setting second.
2. A hot stream is cut into chunks of about ``rows_per_chunk`` rows by event
   time; windows run per ``(stream_key, chunk)`` - one shuffle on that pair.
3. Every "last value strictly before" of the plain plan becomes
   ``coalesce(value inside the chunk, carry from earlier chunks)``. The carry
   comes from a per-chunk summary (one row per chunk: an aggregate that needs
   no shuffle, because the rows are already partitioned by the chunk key), a
   window over the few summary rows of the stream, and a broadcast join back
   (the summary has ``hot rows / rows_per_chunk`` rows). The lead to the next
   opener is the same with the first value of later chunks.
4. Runs of equal state (session numbers) are a prefix sum over chunks.

The carries use the same state expressions as the plain plan
(``own_state``, ``saved_state``, ``after_state``, ``finish_segments``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.config import SessionConfig
from sessionlake.operators.sessionize import (
    HOT_KEY_ROWS,
    KEY,
    ROWS_PER_CHUNK,
    after_state,
    drop_hidden,
    finish_segments,
    is_opener,
    own_state,
    saved_state,
)

KC = [KEY, "chunk"]
DEFAULT_HOT_KEY_ROWS = HOT_KEY_ROWS
DEFAULT_ROWS_PER_CHUNK = ROWS_PER_CHUNK


def _cw():
    return Window.partitionBy(*KC).orderBy("ts_us", "seq")


def _cprior():
    return _cw().rowsBetween(Window.unboundedPreceding, -1)


def _cupto():
    return _cw().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _chunks_before():
    return Window.partitionBy(KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def _chunks_after():
    return Window.partitionBy(KEY).orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)


def _order_if(value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct("ts_us", "seq"))


def with_last_before(df: DataFrame, value: str, name: str, materialize: bool = True) -> DataFrame:
    """Add ``name`` = last non-null ``value`` over all earlier chunks of the stream.

    ``materialize`` checkpoints the input first. A level without it evaluates
    the previous level twice (once for its summary, once for the rows): four
    reads of the last checkpoint with window passes that need no shuffle and no
    sort. Spark does not reuse the repeated broadcast here (the self join gives
    the copy new attribute ids), so uncut levels are never chained: cutting every
    second level keeps the plan two copies wide and trades one checkpoint write
    for two extra reads.
    """
    if materialize:
        df = cut(df)
    v = F.col(value)
    summary = df.groupBy(*KC).agg(F.max_by(v, _order_if(v)).alias("_v"))
    carry = summary.select(*KC, F.last("_v", ignorenulls=True).over(_chunks_before()).alias(name))
    return df.join(F.broadcast(carry), KC, "left")


def with_first_after(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name`` = first non-null ``value`` over all later chunks of the stream."""
    df = cut(df)
    v = F.col(value)
    summary = df.groupBy(*KC).agg(F.min_by(v, _order_if(v)).alias("_v"))
    carry = summary.select(*KC, F.first("_v", ignorenulls=True).over(_chunks_after()).alias(name))
    return df.join(F.broadcast(carry), KC, "left")


# ---------------------------------------------------------------- detection


def hot_streams(
    events: DataFrame,
    hot_key_rows: int = DEFAULT_HOT_KEY_ROWS,
    rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK,
) -> DataFrame:
    """Streams with more than ``hot_key_rows`` rows and their chunk width in seconds.

    Reads only ``stream_key`` and the time (the scan prunes every other column),
    and aggregates map-side first, so on the common input without hot streams
    the check costs a narrow scan and a small shuffle.
    """
    stats = events.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("t").alias("_t0"),
        F.max("t").alias("_tmax"),
    )
    hot = stats.filter(F.col("_n") > F.lit(int(hot_key_rows)))
    width = F.ceil((F.col("_tmax") - F.col("_t0") + 1) * F.lit(int(rows_per_chunk)) / F.col("_n"))
    return hot.select(KEY, "_t0", "_tmax", F.greatest(width, F.lit(1)).cast("long").alias("_chunk_s"))


def first_setters(events: DataFrame, hot: DataFrame, config: SessionConfig) -> DataFrame:
    """The first setter second of each hot stream (its first opener: the grid origin).

    Runs only when hot streams exist; the semi join against the bounded
    hot-stream table is a broadcast, the aggregate is partial first.
    """
    kind = F.col("kind")
    hidden = list(config.hidden_applications)
    is_hidden = F.col("app_id").isin(hidden) if hidden else F.lit(False)
    setter = (kind == "idle_on") | ((kind == "focus") & ~F.coalesce(is_hidden, F.lit(False)))
    rows = events.join(F.broadcast(hot.select(KEY)), KEY, "left_semi").filter(setter)
    return rows.groupBy(KEY).agg(F.min("t").alias("_t_first"))


def split_hot(
    events: DataFrame,
    config: SessionConfig,
    hot_key_rows: int = DEFAULT_HOT_KEY_ROWS,
    rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary streams, rows of hot streams with ``chunk``, ``_t_first``, ``_tmax``).

    The hot-stream table is computed once and checkpointed: the emptiness check and
    the broadcast that tags the rows read it from there instead of aggregating the
    events again. It is small by construction, nothing stays cached, and it outlives
    the executors that made it.
    """
    from sessionlake.config import ensure_checkpoint_dir

    ensure_checkpoint_dir(events.sparkSession)
    hot = hot_streams(events, hot_key_rows, rows_per_chunk).checkpoint()
    if hot.isEmpty():
        return events, None
    hot = hot.join(first_setters(events, hot, config), KEY, "left").checkpoint()
    tagged = events.join(F.broadcast(hot), KEY, "left")
    cold = tagged.filter(F.col("_chunk_s").isNull()).drop("_t0", "_tmax", "_t_first", "_chunk_s")
    hot_rows = tagged.filter(F.col("_chunk_s").isNotNull()).withColumn(
        "chunk", F.floor((F.col("t") - F.col("_t0")) / F.col("_chunk_s")).cast("long")
    ).drop("_t0", "_chunk_s")
    # partitioned by (stream_key, chunk) once; checkpoints keep that partitioning.
    # More partitions than chunks would only be empty ones.
    n_chunks = hot.select(
        F.sum(F.floor((F.col("_tmax") - F.col("_t0")) / F.col("_chunk_s")) + 1).alias("n")
    ).first()["n"]
    shuffle_parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cold, hot_rows.repartition(max(1, min(int(n_chunks), shuffle_parts)), *KC)


def cut(df: DataFrame) -> DataFrame:
    """Materialize to the shared checkpoint folder and cut the lineage.

    Each carry level reads its input twice (per-chunk summary and join back);
    without a cut the plan would double at every level. Reliable checkpoints
    live in ``spark.checkpoint.dir`` and survive executor loss.

    A checkpoint records the partitioning and sort order of the plan that wrote
    it only when that plan is not adaptive (an adaptive plan may still coalesce
    its partitions, so it reports none). The chunked plan depends on both: the
    windows and per-chunk aggregates after a cut then read it in place, with no
    exchange and no sort. So the writing job runs with AQE off; the setting is
    restored right after.
    """
    from sessionlake.config import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


# ---------------------------------------------------------------- chunked plan


def chunked_event_states(hot: DataFrame, config: SessionConfig) -> DataFrame:
    """W1/W2/P8 for hot rows: same columns as ``event_states`` plus ``chunk``."""
    ev = drop_hidden(hot, config.hidden_applications)
    # Workspace carried across chunks
    ev = ev.withColumn("_wsv", F.when(F.col("kind") == "workspace", F.col("workspace")))
    ev = ev.withColumn("_ws_l", F.last("_wsv", ignorenulls=True).over(_cupto()))
    ev = with_last_before(ev, "_wsv", "_ws_in")
    ev = ev.withColumn("ws", F.coalesce("_ws_l", "_ws_in").cast("int")).filter(F.col("kind") != "workspace")
    ev = ev.drop("_wsv", "_ws_l", "_ws_in")
    # Last set state
    ev = ev.withColumn("_own", own_state())
    ev = ev.withColumn("_drv_l", F.last("_own", ignorenulls=True).over(_cprior()))
    ev = with_last_before(ev, "_own", "_drv_in", materialize=False)
    ev = ev.withColumn("_drv", F.coalesce("_drv_l", "_drv_in")).drop("_drv_l", "_drv_in")
    # Saved (old) state
    ev = ev.withColumn("_sv", saved_state())
    ev = ev.withColumn("_old_l", F.last("_sv", ignorenulls=True).over(_cprior()))
    ev = with_last_before(ev, "_sv", "_old_in")
    ev = ev.withColumn("_old", F.coalesce("_old_l", "_old_in")).drop("_sv", "_old_l", "_old_in")
    # state after / before: "after" is NULL only before the stream's first setter,
    # so the last non-null "after" of earlier chunks is the previous row's
    ev = ev.withColumn("after", after_state())
    ev = ev.withColumn("_bef_l", F.lag("after").over(_cw()))
    ev = with_last_before(ev, "after", "_after_in", materialize=False)
    ev = ev.withColumn("before", F.coalesce("_bef_l", "_after_in")).drop("_bef_l", "_after_in")
    return ev.withColumnRenamed("_old", "old_state").drop("_own", "_drv")


def chunked_segments(hot: DataFrame, config: SessionConfig, horizon: int | None) -> DataFrame:
    """W3 for hot rows: same columns as ``segments`` plus ``chunk``."""
    op = chunked_event_states(hot, config).filter(is_opener())
    op = op.withColumn("_nxt", F.struct(F.col("t").alias("t"), F.col("kind").alias("kind")))
    op = op.withColumn("_nxt_l", F.lead("_nxt").over(_cw()))
    op = with_first_after(op, "_nxt", "_nxt_in")
    nxt = F.coalesce("_nxt_l", "_nxt_in")
    op = op.select(
        KEY,
        "chunk",
        "seq",
        "ts_us",
        F.col("t").alias("start"),
        F.col("after").alias("state"),
        nxt["t"].alias("_next_t"),
        nxt["kind"].alias("next_kind"),
        F.col("_t_first").alias("_first_t"),
        (F.lit(horizon) if horizon is not None else F.col("_tmax")).alias("_horizon"),
    )
    return finish_segments(op, config)


def chunked_islands(kept: DataFrame) -> DataFrame:
    """W4 for hot kept segments: ``session_seq`` as a prefix sum over chunks.

    No checkpoint here: the input is two window passes over the checkpoint that
    ``with_first_after`` wrote, so the summary and the rows re-read that one.
    """
    w = _cw()
    df = kept.withColumn("_first_in_chunk", F.row_number().over(w) == 1)
    df = df.withColumn("_chg_l", (~F.col("state").eqNullSafe(F.lag("state").over(w))).cast("int"))
    order = F.struct("ts_us", "seq")
    summary = df.groupBy(*KC).agg(
        F.min_by("state", order).alias("_first_state"),
        F.max_by("state", order).alias("_last_state"),
        F.sum(F.when(~F.col("_first_in_chunk"), F.col("_chg_l")).otherwise(F.lit(0))).alias("_inner_chg"),
    )
    summary = summary.withColumn(
        "_prev_state", F.last("_last_state", ignorenulls=True).over(_chunks_before())
    ).withColumn("_first_chg", (~F.col("_first_state").eqNullSafe(F.col("_prev_state"))).cast("int"))
    carry = summary.select(
        *KC,
        "_first_chg",
        F.coalesce(F.sum(F.col("_inner_chg") + F.col("_first_chg")).over(_chunks_before()), F.lit(0)).alias(
            "_runs_before"
        ),
    )
    df = df.join(F.broadcast(carry), KC, "left")
    chg = F.when(F.col("_first_in_chunk"), F.col("_first_chg")).otherwise(F.col("_chg_l"))
    df = df.withColumn("_chg", chg)
    df = df.withColumn(
        "session_seq", (F.col("_runs_before") + F.sum("_chg").over(_cupto())).cast("int")
    ).withColumn("_run_start", F.col("_chg") == 1)
    return df.drop("_first_in_chunk", "_chg_l", "_first_chg", "_runs_before", "_chg")
