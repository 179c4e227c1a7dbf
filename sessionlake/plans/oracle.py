"""DuckDB SQL used as the independent oracle for the named queries.

The sessionizer oracle does not reuse the window-function closed form. It is a
recursive CTE that steps through each user's events one by one, like the
reference's state machine: step ``ph = 1 -> 0`` applies an event, step
``ph = 0 -> 1`` applies the 1 Hz ticks up to the next event (only the last due
tick of that stretch can change the saved list, so it jumps there).

Every builder returns plain SQL text over the pre-registered views (``events``).
"""

from __future__ import annotations


def _sql_list(values) -> str:
    vals = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"({vals})" if vals else "(NULL)"


def mapped_events_cte() -> str:
    """CTE ``se``: events -> session events (FIXTURES.md section 3 mapping)."""
    return """
se_raw AS (
  SELECT user_id AS stream_key, event_id AS seq, epoch_us(ts) AS ts_us,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type
  FROM events
),
se AS (
  SELECT stream_key, seq, ts_us, (ts_us - (ts_us % 1000000)) // 1000000 AS t,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'focus'
         WHEN event_type = 'error' AND k % 2 = 0 THEN 'idle_on'
         WHEN event_type = 'error' THEN 'focus'
         WHEN k % 2 = 0 THEN 'idle_off'
         ELSE 'workspace' END AS kind,
    CASE WHEN event_type IN ('click', 'view', 'purchase')
         THEN event_type || '_' || CAST(k % 3 AS VARCHAR) END AS app_id,
    CAST(CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN k % 4 END AS INTEGER) AS workspace
  FROM se_raw
)"""


def machine_ctes(interval: int, min_dur: int, horizon: int, hidden=(), mode: str = "interval") -> str:
    """CTEs ``ev`` and ``st``: the event-by-event state machine.

    ``st`` has one row per (stream_key, n, ph). Columns: current session
    (has_cur, c_start, c_act, c_app, c_ws), workspace ``ws``, saved old state
    (has_old, o_*), last flush ``lf``, newest saved session (sseq, s_start,
    s_end, s_*), the response of the event step ``resp``, the accepted flush
    range of the step (fl_lo, fl_hi) and whether its first flush merged.
    """
    I, M, H = int(interval), int(min_dur), int(horizon)
    hid = _sql_list(hidden)
    boundary = mode == "boundary"
    # flush time x of a step (NULL = no flush)
    logged = mode == "logged"
    if logged:
        event_flush = f"""CASE WHEN x.kind = 'idle_on' AND x.has_cur AND x.c_act THEN x.t
              WHEN x.kind = 'tick' AND x.has_cur AND x.t - x.lf >= {I} THEN x.t
              WHEN x.kind = 'flush' AND x.has_cur THEN x.t END"""
        tick_flush = "CAST(NULL AS BIGINT)"
        first_tick = "CAST(NULL AS BIGINT)"
    elif boundary:
        event_flush = """CASE WHEN x.has_cur AND (
                 (x.kind = 'focus' AND NOT x.hidden)
              OR (x.kind = 'idle_on' AND x.c_act)
              OR (x.kind = 'idle_off' AND NOT x.c_act AND x.has_old)) THEN x.t END"""
        tick_flush = f"CASE WHEN x.has_cur AND x.end_t = {H} + 1 THEN {H} END"
        first_tick = "CAST(NULL AS BIGINT)"
    else:
        event_flush = "CASE WHEN x.kind = 'idle_on' AND x.has_cur AND x.c_act THEN x.t END"
        first_tick = f"CASE WHEN x.has_cur THEN greatest(x.t, x.lf + {I}) END"
        tick_flush = f"""CASE WHEN x.has_cur AND greatest(x.t, x.lf + {I}) <= x.end_t - 1
               THEN greatest(x.t, x.lf + {I})
                    + ((x.end_t - 1 - greatest(x.t, x.lf + {I})) // {I}) * {I} END"""
    acc_lo_tick = (
        "z.d0" if M == 0 else f"z.d0 + ((greatest(z.d0, z.c_start + {M} + 1) - z.d0 + {I} - 1) // {I}) * {I}"
    )
    return f"""
ev AS (
  SELECT stream_key, seq, t, kind, app_id, workspace,
         row_number() OVER (PARTITION BY stream_key ORDER BY ts_us, seq) AS n,
         coalesce(lead(t) OVER (PARTITION BY stream_key ORDER BY ts_us, seq), {H} + 1) AS end_t
  FROM se
),
st AS (
  SELECT DISTINCT stream_key, CAST(0 AS BIGINT) AS n, 1 AS ph, CAST(NULL AS BIGINT) AS seq,
    FALSE AS has_cur, CAST(NULL AS BIGINT) AS c_start, CAST(NULL AS BOOLEAN) AS c_act,
    CAST(NULL AS VARCHAR) AS c_app, CAST(NULL AS INTEGER) AS c_ws, CAST(NULL AS INTEGER) AS ws,
    FALSE AS has_old, CAST(NULL AS BOOLEAN) AS o_act, CAST(NULL AS VARCHAR) AS o_app,
    CAST(NULL AS INTEGER) AS o_ws, CAST(0 AS BIGINT) AS lf,
    0 AS sseq, CAST(NULL AS BIGINT) AS s_start, CAST(NULL AS BIGINT) AS s_end,
    CAST(NULL AS BOOLEAN) AS s_act, CAST(NULL AS VARCHAR) AS s_app, CAST(NULL AS INTEGER) AS s_ws,
    CAST(NULL AS VARCHAR) AS resp, CAST(NULL AS BIGINT) AS fl_lo, CAST(NULL AS BIGINT) AS fl_hi,
    CAST(NULL AS BOOLEAN) AS fl_merged, FALSE AS opened, 0 AS segno, CAST(NULL AS BIGINT) AS fx,
    CAST(NULL AS INTEGER) AS fseg, FALSE AS ok
  FROM ev
  UNION ALL
  SELECT y.stream_key, y.n, y.ph, y.seq,
    -- current session after the step
    CASE WHEN y.ph = 1 THEN y.has_cur ELSE y.has_cur OR y.opens END,
    CASE WHEN y.ph = 0 AND y.opens THEN y.t ELSE y.c_start END,
    CASE WHEN y.ph = 0 AND y.opens THEN y.n_act ELSE y.c_act END,
    CASE WHEN y.ph = 0 AND y.opens THEN y.n_app ELSE y.c_app END,
    CASE WHEN y.ph = 0 AND y.opens THEN y.n_ws ELSE y.c_ws END,
    CASE WHEN y.ph = 0 AND y.kind = 'workspace' THEN y.workspace ELSE y.ws END,
    -- old session: set by idle_on on an active session
    y.has_old OR y.saves_old,
    CASE WHEN y.saves_old THEN y.c_act ELSE y.o_act END,
    CASE WHEN y.saves_old THEN y.c_app ELSE y.o_app END,
    CASE WHEN y.saves_old THEN y.c_ws ELSE y.o_ws END,
    CASE WHEN y.ph = 1 AND y.fx IS NOT NULL THEN y.fx
         WHEN y.ph = 0 AND y.kind = 'tick' AND y.fx IS NOT NULL THEN y.fx ELSE y.lf END,
    -- saved sessions: flush at fx
    y.sseq + CASE WHEN y.ok AND NOT y.same THEN 1 ELSE 0 END,
    CASE WHEN y.ok AND NOT y.same THEN y.c_start ELSE y.s_start END,
    CASE WHEN y.ok THEN y.fx ELSE y.s_end END,
    CASE WHEN y.ok AND NOT y.same THEN y.c_act ELSE y.s_act END,
    CASE WHEN y.ok AND NOT y.same THEN y.c_app ELSE y.s_app END,
    CASE WHEN y.ok AND NOT y.same THEN y.c_ws ELSE y.s_ws END,
    y.resp,
    CASE WHEN y.ok THEN y.acc_lo END,
    CASE WHEN y.ok THEN y.fx END,
    CASE WHEN y.ok THEN y.same END,
    y.opens, y.segno + CASE WHEN y.opens THEN 1 ELSE 0 END, y.fx,
    CASE WHEN y.fx IS NOT NULL AND y.has_cur THEN y.segno END, y.ok
  FROM (
    SELECT z.*,
      z.fx IS NOT NULL AND z.has_cur AND ({M} = 0 OR z.fx - z.c_start > {M}) AS ok,
      coalesce(z.sseq > 0 AND z.s_act = z.c_act AND z.s_app IS NOT DISTINCT FROM z.c_app
               AND z.s_ws IS NOT DISTINCT FROM z.c_ws, FALSE) AS same,
      -- first accepted grid point of a tick step (equals fx for a single flush)
      CASE WHEN z.ph = 1 AND z.d0 IS NOT NULL
           THEN {acc_lo_tick}
           ELSE z.fx END AS acc_lo
    FROM (
      SELECT x.stream_key, x.n2 AS n, 1 - x.ph AS ph, x.seq2 AS seq, x.t, x.kind, x.workspace,
        x.has_cur, x.c_start, x.c_act, x.c_app, x.c_ws, x.ws, x.has_old, x.o_act, x.o_app,
        x.o_ws, x.lf, x.sseq, x.s_start, x.s_end, x.s_act, x.s_app, x.s_ws, x.segno,
        CASE WHEN x.ph = 1 THEN {event_flush} ELSE {tick_flush} END AS fx,
        CASE WHEN x.ph = 1 THEN NULL ELSE {first_tick} END AS d0,
        -- does the event open a new current session, and with which state
        x.ph = 1 AND (
             (x.kind = 'focus' AND NOT x.hidden)
          OR (x.kind = 'idle_on' AND (NOT x.has_cur OR x.c_act))
          OR (x.kind = 'idle_off' AND x.has_cur AND NOT x.c_act AND x.has_old)) AS opens,
        CASE WHEN x.kind = 'focus' THEN x.app_id IS NOT NULL
             WHEN x.kind = 'idle_on' THEN FALSE ELSE x.o_act END AS n_act,
        CASE WHEN x.kind = 'focus' THEN x.app_id
             WHEN x.kind = 'idle_on' THEN NULL ELSE x.o_app END AS n_app,
        CASE WHEN x.kind = 'focus' THEN CASE WHEN x.app_id IS NOT NULL THEN x.ws END
             WHEN x.kind = 'idle_on' THEN NULL ELSE x.o_ws END AS n_ws,
        x.ph = 1 AND x.kind = 'idle_on' AND x.has_cur AND x.c_act AS saves_old,
        CASE WHEN x.ph = 0 THEN NULL
             WHEN x.kind = 'focus' THEN CASE WHEN x.hidden THEN 'Ignored' ELSE 'SessionCreated' END
             WHEN x.kind = 'workspace' THEN 'Handled'
             WHEN x.kind = 'idle_on' THEN CASE WHEN NOT x.has_cur THEN 'Handled'
                                               WHEN NOT x.c_act THEN 'Ignored'
                                               ELSE 'SessionIdled(true)' END
             ELSE CASE WHEN NOT x.has_cur OR x.c_act THEN 'Ignored'
                       WHEN x.has_old THEN 'SessionIdled(false)'
                       ELSE 'Handled' END END AS resp
      FROM (
        SELECT s.*, e.n AS n2, e.seq AS seq2, e.t, e.kind, e.app_id, e.workspace, e.end_t,
               coalesce(e.kind = 'focus' AND e.app_id IN {hid}, FALSE) AS hidden
        FROM st s JOIN ev e ON e.stream_key = s.stream_key AND e.n = s.n + s.ph
      ) x
    ) z
  ) y
)"""


def ticked_events_cte(horizon: int, every: int = 3600, flushes: int = 7 * 3600) -> str:
    """CTE ``se`` with explicit tick rows added: every ``every`` s from the first full
    period after a stream's first event through the horizon, and flush rows every ``flushes`` s (logged mode input)."""
    base = mapped_events_cte().replace("\nse AS (", "\nse_ev AS (")
    rows = lambda kind, every, seq: f"""
  SELECT stream_key, CAST({seq} AS BIGINT) AS seq, g * 1000000 + 999999 AS ts_us, g AS t,
         '{kind}' AS kind, CAST(NULL AS VARCHAR) AS app_id, CAST(NULL AS INTEGER) AS workspace
  FROM (SELECT stream_key, unnest(generate_series(t0 - (t0 % {every}) + {every}, {int(horizon)}, {every})) AS g
        FROM (SELECT stream_key, min(t) AS t0 FROM se_ev GROUP BY stream_key))"""  # noqa: E731
    return (
        base
        + f""",
se AS (
  SELECT stream_key, seq, ts_us, t, kind, app_id, workspace FROM se_ev
  UNION ALL{rows("tick", every, 2**62)}
  UNION ALL{rows("flush", flushes, 2**62 + 1)}
)"""
    )


SESSIONS_CTE = """,
sessions AS (
  SELECT stream_key, CAST(sseq AS INTEGER) AS session_seq, min(s_start) AS start, max(s_end) AS "end",
         any_value(s_act) AS is_active, any_value(s_app) AS app_id, any_value(s_ws) AS workspace
  FROM st WHERE sseq > 0
  GROUP BY stream_key, sseq
)"""


def sessions_ctes(interval: int, min_dur: int, horizon: int, hidden=(), mode: str = "interval") -> str:
    """All CTEs up to ``sessions`` (stream_key, session_seq, start, end, state)."""
    base = ticked_events_cte(horizon) if mode == "logged" else mapped_events_cte()
    return base + "," + machine_ctes(interval, min_dur, horizon, hidden, mode) + SESSIONS_CTE


def with_sessions(select_sql: str, interval: int, min_dur: int, horizon: int, hidden=(), mode="interval") -> str:
    return "WITH RECURSIVE " + sessions_ctes(interval, min_dur, horizon, hidden, mode) + "\n" + select_sql
