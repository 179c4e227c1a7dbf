"""Map the shared ``events`` table onto the sessionizer's inputs.

The mapping is a fixed rule so the Spark job and the DuckDB oracle derive the
same rows (FIXTURES.md section 3). All columns come from ``events``; the work
grows with that table.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import schema
from sessionlake.functions.scalar import to_seconds, ts_micros

# Fixed values of the check fixture.
HIDDEN_APPS = ("purchase_2",)
HORIZON = 1706659200  # 2024-01-31 00:00:00 UTC
CHECK_INTERVAL = 21600
CHECK_MIN_DURATION = 7200
# Group rules: (priority, group_id, app_ids, workspaces); empty list = any.
GROUP_RULES = [
    (1, "work", ["click_0", "click_1"], []),
    (2, "side", [], [3]),
    (3, "views", ["view_0", "view_1", "view_2"], [1]),
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def session_events(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """events -> (stream_key, seq, ts_us, t, kind, app_id, workspace [, extra columns])."""
    et = F.col("event_type")
    k = F.col("_k")
    focus_type = et.isin("click", "view", "purchase")
    kind = (
        F.when(focus_type, F.lit("focus"))
        .when((et == "error") & (k % 2 == 0), F.lit("idle_on"))
        .when(et == "error", F.lit("focus"))
        .when(k % 2 == 0, F.lit("idle_off"))
        .otherwise(F.lit("workspace"))
    )
    out = (
        events.select(
            F.col("user_id").alias("stream_key"),
            F.col("event_id").alias("seq"),
            ts_micros(events, "ts").alias("ts_us"),
            et,
            _k().alias("_k"),
            *extra,
        )
        .select(
            "stream_key",
            "seq",
            "ts_us",
            to_seconds("ts_us").alias("t"),
            kind.alias("kind"),
            F.when(focus_type, F.concat(et, F.lit("_"), (k % 3).cast("string"))).alias("app_id"),
            F.when((et == "signup") & (k % 2 == 1), (k % 4)).cast("int").alias("workspace"),
            *extra,
            *(["_k"] if extra else []),
        )
    )
    return out


def load_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_events(read_table(spark, sf_dir, "events"))


def group_rules(spark: SparkSession) -> DataFrame:
    """The rule table: a parameter of the grouping query, not data."""
    return spark.createDataFrame(GROUP_RULES, schema=schema.GROUP_RULES)


def compositor_events(events: DataFrame) -> DataFrame:
    """events -> compositor event rows (FIXTURES.md section 3, second table)."""
    et = F.col("event_type")
    k = F.col("_k")
    eid = F.col("seq")
    app = F.concat(F.lit("app_"), (eid % 5).cast("string"))
    win = (k % 20).cast("long")
    base = events.select(
        F.col("user_id").alias("stream_key"),
        F.col("event_id").alias("seq"),
        ts_micros(events, "ts").alias("ts_us"),
        et,
        _k().alias("_k"),
    )
    kind = (
        F.when(et == "click", F.lit("WindowOpenedOrChanged"))
        .when(et == "view", F.lit("WindowFocusChanged"))
        .when((et == "purchase") & (k % 3 == 0), F.lit("WindowClosed"))
        .when((et == "purchase") & (k % 3 == 1), F.lit("WindowFocusChanged"))
        .when(et == "purchase", F.lit("WorkspaceActivated"))
        .when(et == "error", F.lit("WindowsChanged"))
        .otherwise(F.lit("WorkspacesChanged"))
    )
    window_id = (
        F.when(et.isin("click", "view"), win)
        .when((et == "purchase") & (k % 3 == 0), win)
        .otherwise(F.lit(None).cast("long"))
    )
    app_id = F.when((et == "click") & (k % 10 != 0), app)
    workspace_id = F.when((et == "purchase") & (k % 3 == 2), (k % 4).cast("long"))
    focused = F.when((et == "purchase") & (k % 3 == 2), k % 2 == 0)
    windows = F.when(
        et == "error",
        F.array(
            F.struct(win.alias("id"), app.alias("app_id"), F.lit(True).alias("is_focused")),
            F.struct(((k + 1) % 20).cast("long").alias("id"), app.alias("app_id"), F.lit(False).alias("is_focused")),
        ),
    )
    workspaces = F.when(
        et == "signup",
        F.transform(
            F.array(*[F.lit(i).cast("long") for i in range(4)]),
            lambda i: F.struct(i.alias("id"), (i == (k % 4)).alias("is_focused")),
        ),
    )
    return base.select(
        "stream_key",
        "seq",
        "ts_us",
        to_seconds("ts_us").alias("t"),
        kind.alias("kind"),
        window_id.alias("window_id"),
        app_id.alias("app_id"),
        workspace_id.alias("workspace_id"),
        focused.alias("focused"),
        windows.alias("windows"),
        workspaces.alias("workspaces"),
    )


# Envelope lines made from events. Fixed rule on ``value`` so a few rows become
# pings, handshakes, ticks and bad lines; every row becomes exactly one line.
OVERSIZE_PAD = 70000  # characters, over the 64 KiB message limit
# (padded from a column so the optimizer cannot fold it into a 70 KB literal)


# JSON of the wrong shape: unknown and double tags, values of another type.
UNKNOWN_LINES = [
    '{"Event":{"Nope":1}}',
    '{"Event":{"WorkspaceChanged":"3"}}',
    '{"Event":{"WorkspaceChanged":3.7}}',
    '{"Event":{"ActiveWindowChanged":5}}',
    '{"Event":{"ActiveWindowChanged":{"x":1}}}',
    '{"Event":{"Idle":"true"}}',
    '{"Event":{"Idle":1}}',
    '{"Event":{"Idle":true,"WorkspaceChanged":3}}',
    '{"Event":{"Idle":true},"Ping":null}',
    '{"Handshake":{"protocol_version":"1","backend_name":"x"}}',
    '{"Handshake":{"protocol_version":1,"backend_name":7}}',
    '{"Handshake":{"protocol_version":-1,"backend_name":"x"}}',
    '{"Event":{"WorkspaceChanged":null}}',
    '"Pong"',
    "17",
    "null",
]


def envelopes(events: DataFrame) -> DataFrame:
    """events -> (stream_key, source, seq, ts, line); source = one of two producers per user."""
    df = session_events(events, extra=("ts", "value"))
    v = F.col("value")
    kind = F.col("kind")
    event_line = (
        F.when(
            kind == "focus",
            F.when(
                F.col("app_id").isNull(), F.lit('{"Event":{"ActiveWindowChanged":null}}')
            ).otherwise(F.concat(F.lit('{"Event":{"ActiveWindowChanged":"'), F.col("app_id"), F.lit('"}}'))),
        )
        .when(kind == "workspace", F.concat(F.lit('{"Event":{"WorkspaceChanged":'), F.col("workspace").cast("string"), F.lit("}}")))
        .when(kind == "idle_on", F.lit('{"Event":{"Idle":true}}'))
        .otherwise(F.lit('{"Event":{"Idle":false}}'))
    )
    line = (
        F.when(v < 0.5, F.lit('"Ping"'))
        .when(
            v < 1.0,
            F.concat(
                F.lit('{"Handshake":{"protocol_version":'),
                (F.col("_k") % 3).cast("string"),
                F.lit(',"backend_name":"compositor"}}'),
            ),
        )
        .when(v < 1.2, F.lit("{bad"))
        .when(v < 1.4, F.element_at(F.array(*map(F.lit, UNKNOWN_LINES)), (F.col("seq") % len(UNKNOWN_LINES) + 1).cast("int")))
        .when(
            v < 1.5,
            F.concat(F.lit('{"Event":{"ActiveWindowChanged":"'), F.lpad(F.col("kind"), OVERSIZE_PAD, "x"), F.lit('"}}')),
        )
        .when(v < 1.7, F.lit('{"Event":"Tick"}'))
        .otherwise(event_line)
    )
    source = F.concat(F.lit("u"), F.col("stream_key").cast("string"), F.lit("-b"), (F.col("seq") % 2).cast("string"))
    return df.select("stream_key", source.alias("source"), "seq", "ts", line.alias("line"))
