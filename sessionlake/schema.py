"""Explicit schemas of every table and stream; nothing is inferred."""

from pyspark.sql import types as T

# One row per input event. kind: focus, workspace, idle_on, idle_off
# (logged mode also: tick, flush). app_id NULL on a focus row = focus lost.
SESSION_EVENTS = T.StructType(
    [
        T.StructField("stream_key", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("app_id", T.StringType(), True),
        T.StructField("workspace", T.IntegerType(), True),
    ]
)

# The stored session row: state flattened to three columns.
SESSIONS = T.StructType(
    [
        T.StructField("stream_key", T.LongType(), False),
        T.StructField("session_seq", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("end", T.LongType(), False),
        T.StructField("is_active", T.BooleanType(), False),
        T.StructField("app_id", T.StringType(), True),
        T.StructField("workspace", T.IntegerType(), True),
    ]
)

# Stored table: SESSIONS plus the day partition column (start div 86400).
SESSIONS_STORED = T.StructType(SESSIONS.fields + [T.StructField("day", T.LongType(), False)])

# Versioned change rows used by the upsert path.
SESSION_CHANGES = T.StructType(SESSIONS.fields + [T.StructField("version", T.LongType(), False)])

STATE = T.StructType(
    [
        T.StructField("is_active", T.BooleanType(), False),
        T.StructField("app_id", T.StringType(), True),
        T.StructField("workspace", T.IntegerType(), True),
    ]
)

GROUP_RULES = T.StructType(
    [
        T.StructField("priority", T.IntegerType(), False),
        T.StructField("group_id", T.StringType(), False),
        T.StructField("app_ids", T.ArrayType(T.StringType(), False), False),
        T.StructField("workspaces", T.ArrayType(T.IntegerType(), False), False),
    ]
)

SETTINGS = T.StructType(
    [
        T.StructField("stream_key", T.LongType(), False),
        T.StructField("flush_interval", T.LongType(), False),
        T.StructField("min_session_duration", T.LongType(), False),
        T.StructField("hidden_applications", T.ArrayType(T.StringType(), False), False),
    ]
)

ENVELOPES = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("line", T.StringType(), True),
    ]
)

ENVELOPES_KEYED = T.StructType([T.StructField("stream_key", T.LongType(), False)] + ENVELOPES.fields)

# As they come out of a producer's log: a line without an arrival time has neither.
ENVELOPES_LANDED = T.StructType(
    [
        T.StructField("stream_key", T.LongType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("seq", T.LongType(), True),
        T.StructField("ts", T.TimestampType(), True),
        T.StructField("line", T.StringType(), True),
    ]
)

WINDOW_REC = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("app_id", T.StringType(), True),
        T.StructField("is_focused", T.BooleanType(), True),
    ]
)
WORKSPACE_REC = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("is_focused", T.BooleanType(), True),
    ]
)

COMPOSITOR_EVENTS = T.StructType(
    [
        T.StructField("stream_key", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("window_id", T.LongType(), True),
        T.StructField("app_id", T.StringType(), True),
        T.StructField("workspace_id", T.LongType(), True),
        T.StructField("focused", T.BooleanType(), True),
        T.StructField("windows", T.ArrayType(WINDOW_REC), True),
        T.StructField("workspaces", T.ArrayType(WORKSPACE_REC), True),
    ]
)
