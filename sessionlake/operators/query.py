"""Reading sessions back: range filter, ordering, paging, last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STORED_COLUMNS = ["start", "end", "is_active", "app_id", "workspace"]
TIE_KEYS = ("stream_key", "session_seq")


def columns(sessions: DataFrame, keys: bool = True) -> DataFrame:
    """The stored columns (plus the row keys unless ``keys=False``)."""
    return sessions.select(*(list(TIE_KEYS) if keys else []), *STORED_COLUMNS)


def filter_range(
    sessions: DataFrame, from_: int | None = None, to: int | None = None, mode: str = "contain"
) -> DataFrame:
    """``start >= from AND end <= to`` (containment, both inclusive, each optional).

    ``mode="overlap"`` keeps sessions that intersect ``[from, to]`` instead.
    Only given bounds become predicates, so they push down to the Parquet scan.
    When the table carries the ``day`` partition column (``start div 86400``),
    implied day bounds prune partitions: ``start >= from`` gives
    ``day >= from div 86400`` and ``end <= to`` with ``end >= start`` gives
    ``day <= to div 86400``.
    """
    df = sessions
    has_day = "day" in df.columns
    if mode not in ("contain", "overlap"):
        raise ValueError("mode must be 'contain' or 'overlap'")
    if from_ is not None:
        f = int(from_)
        if mode == "contain":
            df = df.filter(F.col("start") >= F.lit(f))
            if has_day:
                df = df.filter(F.col("day") >= F.lit(f // 86400))
        else:
            df = df.filter(F.col("end") >= F.lit(f))
    if to is not None:
        t = int(to)
        df = df.filter(F.col("end") <= F.lit(t) if mode == "contain" else F.col("start") <= F.lit(t))
        if has_day:
            df = df.filter(F.col("day") <= F.lit(t // 86400))
    return df


def _direction(col: Column, order: str) -> Column:
    if order not in ("asc", "desc"):
        raise ValueError(f"order must be 'asc' or 'desc', got {order!r}")
    return col.asc() if order == "asc" else col.desc()


def sort_keys(sort_by_duration: str | None = None, sort_by_start: str | None = None) -> list[Column]:
    """O1: duration first, then start; with neither, start ascending; then the tie keys."""
    keys = []
    if sort_by_duration:
        keys.append(_direction(F.col("end") - F.col("start"), sort_by_duration))
    if sort_by_start:
        keys.append(_direction(F.col("start"), sort_by_start))
    if not keys:
        keys.append(F.col("start").asc())
    keys += [F.col(k).asc() for k in TIE_KEYS]
    return keys


def order_sessions(
    sessions: DataFrame, sort_by_duration: str | None = None, sort_by_start: str | None = None
) -> DataFrame:
    """O1: a total order (range-partitioned sort)."""
    return sessions.orderBy(*sort_keys(sort_by_duration, sort_by_start))


def limit_offset(
    sessions: DataFrame,
    limit: int | None = None,
    offset: int | None = None,
    sort_by_duration: str | None = None,
    sort_by_start: str | None = None,
    per_stream: bool = False,
) -> DataFrame:
    """O2: ``LIMIT coalesce(n, -1) OFFSET coalesce(m, 0)``; a negative or absent limit means all.

    Global paging sorts then skips/limits (Spark plans a TakeOrdered when the
    limit is small). ``per_stream=True`` pages every stream on its own with
    ``row_number``; the upper bound lets Spark apply a partial group limit
    before the shuffle, so a heavy stream ships only ``offset + limit`` rows.
    """
    keys = sort_keys(sort_by_duration, sort_by_start)
    skip = max(int(offset or 0), 0)
    take = None if limit is None or int(limit) < 0 else int(limit)
    if per_stream:
        w = Window.partitionBy("stream_key").orderBy(*keys)
        df = sessions.withColumn("_rn", F.row_number().over(w))
        if take is not None:
            df = df.filter(F.col("_rn") <= F.lit(skip + take))
        if skip:
            df = df.filter(F.col("_rn") > F.lit(skip))
        return df.withColumn("position", (F.col("_rn") - F.lit(skip)).cast("long")).drop("_rn")
    df = sessions.orderBy(*keys)
    if skip:
        df = df.offset(skip)
    if take is not None:
        df = df.limit(take)
    return df


def query_filtered(
    sessions: DataFrame,
    from_: int | None = None,
    to: int | None = None,
    limit: int | None = None,
    offset: int | None = None,
    sort_by_duration: str | None = None,
    sort_by_start: str | None = None,
    per_stream: bool = False,
) -> DataFrame:
    """P1 + O1 + O2."""
    return limit_offset(
        filter_range(sessions, from_, to), limit, offset, sort_by_duration, sort_by_start, per_stream
    )


def query_last(sessions: DataFrame, n: int, per_stream: bool = False) -> DataFrame:
    """O3: the ``n`` sessions with the latest start (per stream with ``per_stream``)."""
    return limit_offset(sessions, n, None, sort_by_start="desc", per_stream=per_stream)


def max_key(sessions: DataFrame) -> DataFrame:
    """Newest row id per stream."""
    return sessions.groupBy("stream_key").agg(F.max("session_seq").alias("max_session_seq"))


def last_per_stream(sessions: DataFrame) -> DataFrame:
    """The most recent saved session of each stream.

    ``max_by`` over a struct is a plain hash aggregate with a map-side partial
    step: no sort, and a heavy stream sends one row per map task.
    """
    cols = [c for c in sessions.columns if c != "stream_key"]
    best = F.max_by(F.struct(*cols), F.col("session_seq")).alias("_last")
    return sessions.groupBy("stream_key").agg(best).select("stream_key", "_last.*")
