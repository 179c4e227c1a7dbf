"""Small builders for hand-written test inputs (the reference's unit-test scripts)."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("stream_key", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("t", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("app_id", T.StringType()),
        T.StructField("workspace", T.IntegerType()),
    ]
)


def parse_script(script: str, key: int = 1):
    """'@1 F(firefox) W(1) I+ I- F(-) T !' -> rows (kind, t, app, ws) in order."""
    rows, now = [], 0
    for tok in script.split():
        if tok.startswith("@"):
            now = int(tok[1:])
        elif tok.startswith("F("):
            app = tok[2:-1]
            rows.append(("focus", now, None if app == "-" else app, None))
        elif tok.startswith("W("):
            rows.append(("workspace", now, None, int(tok[2:-1])))
        elif tok == "I+":
            rows.append(("idle_on", now, None, None))
        elif tok == "I-":
            rows.append(("idle_off", now, None, None))
        elif tok == "T":
            rows.append(("tick", now, None, None))
        elif tok == "!":
            rows.append(("flush", now, None, None))
        else:
            raise ValueError(tok)
    return rows


def event_rows(rows, key: int = 1):
    """Script rows -> session event tuples (stream_key, seq, ts_us, t, kind, app_id, workspace)."""
    return [(key, i, t * 1_000_000, t, kind, app, ws) for i, (kind, t, app, ws) in enumerate(rows)]


def sessions_df(spark, sessions, key: int = 1):
    """[(start, end, app|None, ws|None)] -> a sessions DataFrame (app None = idle)."""
    from sessionlake.schema import SESSIONS

    data = [
        (key, i + 1, s, e, app is not None, app, ws) for i, (s, e, app, ws) in enumerate(sessions)
    ]
    return spark.createDataFrame(data, SESSIONS)


def run_machine(script: str, interval: int = 15, min_dur: int = 0, hidden=()):
    """Feed a logged script to the pure state machine; return [(start, end, state)] and responses."""
    from sessionlake.streaming.machine import SessionMachine

    m = SessionMachine(interval, min_dur, hidden)
    responses = [m.event(kind, t, app, ws) for kind, t, app, ws in parse_script(script)]
    sessions = [(start, end, st) for _seq, start, end, st in m.take_all()]
    return sessions, responses
