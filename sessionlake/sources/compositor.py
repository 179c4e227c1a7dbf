"""Compositor events to core events (S9), with the window table as an as-of lookup.

The reference keeps a ``HashMap<window id, window>`` in one process. Here the
map is never built: window updates (opened/changed, listed in a WindowsChanged,
closed) and focus lookups are unioned and ordered per ``(stream_key,
window_id)``; a lookup reads the latest update before it with
``last(..., ignorenulls)`` - an as-of join without a range join. Every other
emission is map-only. The only shuffle is on ``(stream_key, window_id)``;
windows with very many rows are split into time chunks (``with_known``).

Rules: WindowsChanged upserts each listed window (never evicts) and emits a
focus for each focused one in list order; WindowOpenedOrChanged upserts and
emits nothing; WindowClosed removes; WindowFocusChanged(id) emits the stored
app of a known, open window (NULL app = focus lost) and nothing for an unknown
or closed one; WindowFocusChanged(NULL) emits focus lost; WorkspacesChanged
emits the first focused workspace; WorkspaceActivated emits only if focused.
A workspace id outside INT goes to the reject output instead of crashing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.operators.sessionize import HOT_KEY_ROWS, ROWS_PER_CHUNK

INT_MAX = 2**31 - 1
WK = ["stream_key", "window_id"]
ORDER = ["ts_us", "seq", "pos"]

OUT_COLUMNS = ["stream_key", "seq", "pos", "ts_us", "kind", "app_id", "workspace"]


def _out(df: DataFrame, pos, kind, app, ws) -> DataFrame:
    return df.select(
        "stream_key",
        "seq",
        F.lit(pos).cast("int").alias("pos") if not hasattr(pos, "alias") else pos.cast("int").alias("pos"),
        "ts_us",
        F.lit(kind).alias("kind"),
        app.cast("string").alias("app_id"),
        ws.cast("int").alias("workspace"),
    )


def _upto(*keys: str):
    return Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_known(rows: DataFrame, hot_key_rows: int | None, rows_per_chunk: int) -> DataFrame:
    """``_known`` = latest window update (``upd``) at or before each row of its window.

    One window of one user can hold a large share of all rows (a terminal that
    is focused all day). A partial aggregate counts rows per window; the hot
    ones (more than ``hot_key_rows``, a table of at most ``rows / hot_key_rows``
    rows, so it is broadcast) are cut into event-time chunks of about
    ``rows_per_chunk`` rows. Inside a chunk the lookup is the same running
    ``last``; a row with no update earlier in its chunk takes the carry: the
    latest update of all earlier chunks, from a one-row-per-chunk summary (an
    aggregate that needs no shuffle, then a window over the chunk rows) joined
    back by broadcast. The hot rows are evaluated twice (summary and rows);
    with a single carry level that is cheaper than writing a checkpoint.
    Without hot windows the plan is the plain window.
    """
    plain = lambda df: df.withColumn("_known", F.last("upd", ignorenulls=True).over(_upto(*WK)))
    if hot_key_rows is None:
        return plain(rows)
    stats = rows.groupBy(*WK).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts_us").alias("_t0"), F.max("ts_us").alias("_t1")
    )
    width = F.ceil((F.col("_t1") - F.col("_t0") + 1) * F.lit(int(rows_per_chunk)) / F.col("_n"))
    hot = (
        stats.filter(F.col("_n") > F.lit(int(hot_key_rows)))
        .select(*WK, "_t0", "_t1", F.greatest(width, F.lit(1)).cast("long").alias("_width"))
        .persist()
    )
    if hot.count() == 0:
        hot.unpersist()
        return plain(rows)
    n_chunks = hot.select(F.sum(F.floor((F.col("_t1") - F.col("_t0")) / F.col("_width")) + 1)).first()[0]
    parts = max(1, min(int(n_chunks), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tagged = rows.join(F.broadcast(hot.drop("_t1")), WK, "left")
    cold = tagged.filter(F.col("_width").isNull()).drop("_t0", "_width")
    chunk = F.floor((F.col("ts_us") - F.col("_t0")) / F.col("_width")).cast("long")
    hot_rows = (
        tagged.filter(F.col("_width").isNotNull())
        .withColumn("chunk", chunk)
        .drop("_t0", "_width")
        .repartition(parts, *WK, "chunk")
    )
    order_if = F.when(F.col("upd").isNotNull(), F.struct(*ORDER))
    summary = hot_rows.groupBy(*WK, "chunk").agg(F.max_by("upd", order_if).alias("_last"))
    before = Window.partitionBy(*WK).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*WK, "chunk", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = F.last("upd", ignorenulls=True).over(_upto(*WK, "chunk"))
    hot_known = (
        hot_rows.join(F.broadcast(carry), [*WK, "chunk"], "left")
        .withColumn("_known", F.coalesce(inside, F.col("_carry")))
        .drop("chunk", "_carry")
    )
    return plain(cold).unionByName(hot_known)


def normalize_compositor(
    events: DataFrame,
    hot_key_rows: int | None = HOT_KEY_ROWS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Compositor rows -> (core event rows, rejected rows with reason).

    Input columns: stream_key, seq, ts_us, kind, window_id, app_id, workspace_id,
    focused, windows ARRAY<STRUCT<id, app_id, is_focused>>, workspaces
    ARRAY<STRUCT<id, is_focused>>. Output: stream_key, seq, pos (order inside one
    input event), ts_us, kind (focus, workspace), app_id, workspace.
    ``hot_key_rows`` / ``rows_per_chunk``: see ``with_known`` (None: no split).
    """
    kind = F.col("kind")
    nul_s = F.lit(None).cast("string")
    nul_i = F.lit(None).cast("int")

    # window updates with their position inside the source event
    listed = events.filter(kind == "WindowsChanged").select(
        "stream_key", "seq", "ts_us", F.posexplode("windows").alias("pos", "w")
    )
    upd_listed = listed.select(
        "stream_key",
        "seq",
        "pos",
        "ts_us",
        F.col("w.id").alias("window_id"),
        F.struct(F.lit(True).alias("alive"), F.col("w.app_id").alias("app_id")).alias("upd"),
        F.lit(False).alias("is_lookup"),
    )
    upd_single = events.filter(kind.isin("WindowOpenedOrChanged", "WindowClosed")).select(
        "stream_key",
        "seq",
        F.lit(0).alias("pos"),
        "ts_us",
        "window_id",
        F.struct(
            (kind == "WindowOpenedOrChanged").alias("alive"),
            F.when(kind == "WindowOpenedOrChanged", F.col("app_id")).alias("app_id"),
        ).alias("upd"),
        F.lit(False).alias("is_lookup"),
    )
    lookups = events.filter((kind == "WindowFocusChanged") & F.col("window_id").isNotNull()).select(
        "stream_key",
        "seq",
        F.lit(0).alias("pos"),
        "ts_us",
        "window_id",
        F.lit(None).cast("struct<alive:boolean,app_id:string>").alias("upd"),
        F.lit(True).alias("is_lookup"),
    )
    asof = with_known(upd_listed.unionByName(upd_single).unionByName(lookups), hot_key_rows, rows_per_chunk)
    asof = asof.filter(F.col("is_lookup") & F.coalesce(F.col("_known.alive"), F.lit(False)))
    focus_lookup = _out(asof, 0, "focus", F.col("_known.app_id"), nul_i)

    focus_listed = _out(
        listed.filter(F.col("w.is_focused")), F.col("pos"), "focus", F.col("w.app_id"), nul_i
    )
    focus_lost = _out(
        events.filter((kind == "WindowFocusChanged") & F.col("window_id").isNull()), 0, "focus", nul_s, nul_i
    )
    # first focused workspace of a WorkspacesChanged
    first_ws = F.filter("workspaces", lambda x: x["is_focused"])[0]["id"]
    ws_changed = events.filter(kind == "WorkspacesChanged").withColumn("_ws", first_ws).filter(
        F.col("_ws").isNotNull()
    )
    ws_activated = events.filter((kind == "WorkspaceActivated") & F.coalesce(F.col("focused"), F.lit(False))).withColumn(
        "_ws", F.col("workspace_id")
    )
    ws_all = ws_changed.unionByName(ws_activated)
    in_range = (F.col("_ws") >= 0) & (F.col("_ws") <= F.lit(INT_MAX))
    ws_out = _out(ws_all.filter(in_range), 0, "workspace", nul_s, F.col("_ws"))
    rejects = ws_all.filter(~in_range).select(
        "stream_key", "seq", "ts_us", "kind", F.lit("workspace id out of range").alias("reject")
    )
    core = focus_lookup.unionByName(focus_listed).unionByName(focus_lost).unionByName(ws_out)
    return core, rejects
