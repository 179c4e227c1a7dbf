"""Named queries: a Spark plan and an independent DuckDB oracle for each.

Every query reads the shared test tables (``events``) through the fixture
mapping and runs over the whole table. ``QUERIES[name](spark, sf_dir)`` returns a
DataFrame; ``ORACLE[name]`` is SQL over the same parquet files (DuckDB views).
Column names and types agree between the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.config import SessionConfig
from sessionlake.fixtures import (
    CHECK_INTERVAL,
    CHECK_MIN_DURATION,
    GROUP_RULES,
    HIDDEN_APPS,
    HORIZON,
    group_rules,
    load_session_events,
)
from sessionlake.functions.scalar import flatten_state
from sessionlake.operators import analytics as A
from sessionlake.operators import audit as U
from sessionlake.operators import query as Q
from sessionlake.operators import report as R
from sessionlake.operators import sessionize as X
from sessionlake.plans import oracle as O

I, M, H = CHECK_INTERVAL, CHECK_MIN_DURATION, HORIZON
CFG = SessionConfig(I, M, HIDDEN_APPS)
CFG_DEFAULT = SessionConfig(15, 5, HIDDEN_APPS)
CFG_BOUNDARY = SessionConfig(I, 5, HIDDEN_APPS, flush="boundary")

# Fixed query parameters (epoch seconds).
RANGE_FROM = 1704412800  # 2024-01-05 00:00:00 UTC
RANGE_TO = 1705622400  # 2024-01-19 00:00:00 UTC
FROM_ONLY = 1705017600  # 2024-01-12 00:00:00 UTC
TO_ONLY = 1704844800  # 2024-01-10 00:00:00 UTC
REPORT_OFFSET = 3600  # UTC+01:00
APP_FOR_TOTAL = "click_0"
APP_FOR_FILTER = "view_1"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _events(spark, sf) -> DataFrame:
    return load_session_events(spark, sf)


def _sessions(spark, sf, cfg: SessionConfig = CFG) -> DataFrame:
    return X.sessionize(_events(spark, sf), cfg, H)


# ---------------------------------------------------------------- SQL helpers


def _with_sessions(select_sql: str, interval=I, min_dur=M, mode="interval") -> str:
    return O.with_sessions(select_sql, interval, min_dur, H, HIDDEN_APPS, mode)


def _with_machine(select_sql: str, interval=I, min_dur=M, mode="interval", extra: str = "") -> str:
    return (
        "WITH RECURSIVE "
        + O.mapped_events_cte()
        + ","
        + O.machine_ctes(interval, min_dur, H, HIDDEN_APPS, mode)
        + extra
        + "\n"
        + select_sql
    )


def _hidden_sql(kind="kind", app="app_id") -> str:
    apps = ", ".join(f"'{a}'" for a in HIDDEN_APPS)
    return f"coalesce({kind} = 'focus' AND {app} IN ({apps}), FALSE)"


def _human_sql(d: str) -> str:
    return f"""(CASE WHEN ({d}) < 0 THEN '' WHEN ({d}) = 0 THEN '0s' ELSE
      (CASE WHEN ({d}) // 3600 > 0 THEN CAST(({d}) // 3600 AS VARCHAR) || 'h' ELSE '' END) ||
      (CASE WHEN (({d}) % 3600) // 60 > 0 THEN CAST((({d}) % 3600) // 60 AS VARCHAR) || 'm' ELSE '' END) ||
      (CASE WHEN ({d}) % 60 > 0 THEN CAST(({d}) % 60 AS VARCHAR) || 's' ELSE '' END) END)"""


def _state_label_sql() -> str:
    return (
        "CASE WHEN NOT is_active THEN 'idle' WHEN workspace IS NULL THEN app_id "
        "ELSE app_id || ' (' || CAST(workspace AS VARCHAR) || ')' END"
    )


SESSION_COLS_SQL = 'stream_key, session_seq, start, "end", is_active, app_id, workspace'

# event rows of the machine: post-event state, with the event's kind
_EVENT_STEPS = """,
steps AS (
  SELECT s.*, e.kind, e.app_id AS ev_app,
         lag(s.has_cur) OVER w AS b_has, lag(s.c_act) OVER w AS b_act,
         lag(s.c_app) OVER w AS b_app, lag(s.c_ws) OVER w AS b_ws
  FROM st s JOIN ev e ON e.stream_key = s.stream_key AND e.n = s.n
  WINDOW w AS (PARTITION BY s.stream_key ORDER BY s.n, s.ph)
)"""

# segments of the machine: opener steps, their last flush and the session they fed
_SEGMENTS = (
    _EVENT_STEPS
    + """,
op AS (
  SELECT stream_key, seq, segno, t_open AS start, kind, c_act, c_app, c_ws
  FROM (SELECT s.*, e.t AS t_open FROM steps s JOIN ev e ON e.stream_key = s.stream_key AND e.n = s.n
        WHERE s.ph = 0 AND s.opened)
),
fl AS (
  SELECT stream_key, fseg, max(fx) AS flush_t, bool_or(ok) AS kept,
         CAST(max(CASE WHEN ok THEN sseq END) AS INTEGER) AS session_seq
  FROM st WHERE fseg IS NOT NULL GROUP BY stream_key, fseg
),
segs AS (
  SELECT op.stream_key, op.seq, op.start,
         coalesce(lead(op.start) OVER w, {H} + 1) AS end_t,
         lead(op.kind) OVER w AS next_kind,
         fl.flush_t, coalesce(fl.kept, FALSE) AS kept, fl.session_seq,
         op.c_act AS is_active, op.c_app AS app_id, op.c_ws AS workspace
  FROM op LEFT JOIN fl ON fl.stream_key = op.stream_key AND fl.fseg = op.segno
  WINDOW w AS (PARTITION BY op.stream_key ORDER BY op.segno)
)""".replace("{H}", str(H))
)


# ---------------------------------------------------------------- X1 and its steps


@register("sessionize_interval", _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions"))
def sessionize_interval(spark, sf):
    return _sessions(spark, sf)


@register(
    "sessionize_default",
    _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions", interval=15, min_dur=5),
)
def sessionize_default(spark, sf):
    return _sessions(spark, sf, CFG_DEFAULT)


_NO_HORIZON = _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions").replace(
    f", {H} + 1) AS end_t", ", max(t) OVER (PARTITION BY stream_key) + 1) AS end_t"
)


@register("sessionize_no_horizon", _NO_HORIZON)
def sessionize_no_horizon(spark, sf):
    """X1 with each stream's own last second as its horizon."""
    return X.sessionize(_events(spark, sf), CFG)


@register("sessionize_no_horizon_hot_split", _NO_HORIZON)
def sessionize_no_horizon_hot_split(spark, sf):
    return X.sessionize(_events(spark, sf), CFG, hot_key_rows=40, rows_per_chunk=12)


@register(
    "sessionize_boundary",
    _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions", min_dur=5, mode="boundary"),
)
def sessionize_boundary(spark, sf):
    return _sessions(spark, sf, CFG_BOUNDARY)


@register("sessionize_hot_split", _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions"))
def sessionize_hot_split(spark, sf):
    """X1 with thresholds so low that most streams take the chunked hot-stream plan."""
    return X.sessionize(_events(spark, sf), CFG, H, hot_key_rows=40, rows_per_chunk=12)


@register(
    "fill_workspace",
    _with_machine("SELECT stream_key, seq, kind, ws FROM steps WHERE ph = 0", extra=_EVENT_STEPS),
)
def fill_workspace(spark, sf):
    ev = X.prepare_events(_events(spark, sf))
    return X.fill_workspace(ev).select("stream_key", "seq", "kind", "ws")


@register(
    "event_states",
    _with_machine(
        f"""SELECT stream_key, seq, kind,
           CASE WHEN b_has THEN b_act END AS before_active,
           CASE WHEN b_has THEN b_app END AS before_app,
           CASE WHEN b_has THEN b_ws END AS before_ws,
           CASE WHEN has_cur THEN c_act END AS after_active,
           CASE WHEN has_cur THEN c_app END AS after_app,
           CASE WHEN has_cur THEN c_ws END AS after_ws
        FROM steps WHERE ph = 0 AND kind <> 'workspace' AND NOT {_hidden_sql('kind', 'ev_app')}""",
        extra=_EVENT_STEPS,
    ),
)
def event_states(spark, sf):
    st = X.event_states(_events(spark, sf), CFG)
    return st.select(
        "stream_key",
        "seq",
        "kind",
        F.col("before.is_active").alias("before_active"),
        F.col("before.app_id").alias("before_app"),
        F.col("before.workspace").alias("before_ws"),
        F.col("after.is_active").alias("after_active"),
        F.col("after.app_id").alias("after_app"),
        F.col("after.workspace").alias("after_ws"),
    )


_SEG_COLS_SQL = "stream_key, seq, start, end_t, next_kind, flush_t, kept, is_active, app_id, workspace"


@register("segments", _with_machine(f"SELECT {_SEG_COLS_SQL} FROM segs", extra=_SEGMENTS))
def segments(spark, sf):
    s = X.segments(_events(spark, sf), CFG, H)
    return s.select(
        "stream_key",
        "seq",
        "start",
        "end_t",
        "next_kind",
        "flush_t",
        "kept",
        F.col("state.is_active").alias("is_active"),
        F.col("state.app_id").alias("app_id"),
        F.col("state.workspace").alias("workspace"),
    )


@register(
    "drop_hidden",
    "WITH " + O.mapped_events_cte() + f"\nSELECT stream_key, seq, kind, app_id FROM se WHERE NOT {_hidden_sql()}",
)
def drop_hidden(spark, sf):
    return X.drop_hidden(_events(spark, sf), HIDDEN_APPS).select("stream_key", "seq", "kind", "app_id")


@register(
    "min_duration",
    _with_machine("SELECT stream_key, seq, start, flush_t FROM segs WHERE kept", extra=_SEGMENTS),
)
def min_duration(spark, sf):
    return X.min_duration(X.segments(_events(spark, sf), CFG, H)).select("stream_key", "seq", "start", "flush_t")


@register(
    "run_islands",
    _with_machine("SELECT stream_key, seq, start, flush_t, session_seq FROM segs WHERE kept", extra=_SEGMENTS),
)
def run_islands(spark, sf):
    segs = X.run_islands(X.min_duration(X.segments(_events(spark, sf), CFG, H)))
    return segs.select("stream_key", "seq", "start", "flush_t", "session_seq")


@register(
    "merge_runs",
    _with_machine(
        """SELECT stream_key, session_seq, min(start) AS start, max(flush_t) AS "end",
                  any_value(is_active) AS is_active, any_value(app_id) AS app_id,
                  any_value(workspace) AS workspace, count(*) AS segments
           FROM segs WHERE kept GROUP BY stream_key, session_seq""",
        extra=_SEGMENTS,
    ),
)
def merge_runs(spark, sf):
    segs = X.run_islands(X.min_duration(X.segments(_events(spark, sf), CFG, H)))
    return X.merge_runs(segs, with_counts=True)


@register(
    "response_log",
    _with_machine("SELECT stream_key, seq, kind, resp AS response FROM steps WHERE ph = 0", extra=_EVENT_STEPS),
)
def response_log(spark, sf):
    return U.response_log(_events(spark, sf), CFG)


@register(
    "flush_log",
    _with_machine(
        f"""SELECT stream_key, CAST(sseq AS INTEGER) AS session_seq, g AS flush_t,
                  (g > fl_lo) OR fl_merged AS merged
           FROM (SELECT stream_key, sseq, fl_lo, fl_merged,
                        unnest(generate_series(fl_lo, fl_hi, {I})) AS g
                 FROM st WHERE fl_lo IS NOT NULL)"""
    ),
)
def flush_log(spark, sf):
    return U.flush_log(_events(spark, sf), CFG, H)


@register(
    "flatten_state",
    _with_machine(
        f"""SELECT stream_key, seq, CASE WHEN has_cur THEN c_act END AS is_active,
                  CASE WHEN has_cur AND c_act THEN c_app END AS app_id,
                  CASE WHEN has_cur AND c_act THEN c_ws END AS workspace
           FROM steps WHERE ph = 0 AND kind <> 'workspace' AND NOT {_hidden_sql('kind', 'ev_app')}""",
        extra=_EVENT_STEPS,
    ),
)
def flatten_state_q(spark, sf):
    st = X.event_states(_events(spark, sf), CFG).select("stream_key", "seq", F.col("after").alias("state"))
    return flatten_state(st)


@register(
    "event_seconds",
    "WITH " + O.mapped_events_cte() + "\nSELECT stream_key, seq, ts_us, t FROM se",
)
def event_seconds(spark, sf):
    return _events(spark, sf).select("stream_key", "seq", "ts_us", "t")


# ---------------------------------------------------------------- analytics


def _sum_sql(cond: str, alias: str) -> str:
    return f'CAST(coalesce(sum(CASE WHEN {cond} THEN "end" - start END), 0) AS BIGINT) AS {alias}'


@register(
    "total_screen_time",
    _with_sessions(f"SELECT stream_key, {_sum_sql('is_active', 'total_screen_time')} FROM sessions GROUP BY stream_key"),
)
def total_screen_time(spark, sf):
    return A.total_screen_time(_sessions(spark, sf))


@register(
    "idle_time",
    _with_sessions(f"SELECT stream_key, {_sum_sql('NOT is_active', 'idle_time')} FROM sessions GROUP BY stream_key"),
)
def idle_time(spark, sf):
    return A.idle_time(_sessions(spark, sf))


@register(
    "screen_time_app",
    _with_sessions(
        f"SELECT stream_key, {_sum_sql(f'is_active AND app_id = {chr(39)}{APP_FOR_TOTAL}{chr(39)}', 'screen_time_app')} "
        "FROM sessions GROUP BY stream_key"
    ),
)
def screen_time_app(spark, sf):
    return A.screen_time_app(_sessions(spark, sf), APP_FOR_TOTAL)


@register(
    "time_for_each_state",
    _with_sessions(
        'SELECT stream_key, is_active, app_id, workspace, CAST(sum("end" - start) AS BIGINT) AS total_time '
        "FROM sessions GROUP BY stream_key, is_active, app_id, workspace"
    ),
)
def time_for_each_state(spark, sf):
    return A.time_for_each_state(_sessions(spark, sf))


@register("active_only", _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions WHERE is_active"))
def active_only(spark, sf):
    return A.active_only(_sessions(spark, sf))


@register("idle_only", _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions WHERE NOT is_active"))
def idle_only(spark, sf):
    return A.idle_only(_sessions(spark, sf))


@register(
    "for_app",
    _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions WHERE is_active AND app_id = '{APP_FOR_FILTER}'"),
)
def for_app(spark, sf):
    return A.for_app(_sessions(spark, sf), APP_FOR_FILTER)


@register("duration", _with_sessions(f'SELECT {SESSION_COLS_SQL}, "end" - start AS duration FROM sessions'))
def duration(spark, sf):
    return A.with_duration(_sessions(spark, sf))


@register("session_columns", _with_sessions('SELECT start, "end", is_active, app_id, workspace FROM sessions'))
def session_columns(spark, sf):
    return Q.columns(_sessions(spark, sf), keys=False)


def _group_case_sql() -> str:
    parts = []
    for _prio, gid, apps, wss in sorted(GROUP_RULES):
        cond = ["is_active"]
        if apps:
            cond.append("app_id IN (" + ", ".join(f"'{a}'" for a in apps) + ")")
        if wss:
            cond.append("coalesce(workspace IN (" + ", ".join(str(w) for w in wss) + "), FALSE)")
        parts.append(f"WHEN {' AND '.join(cond)} THEN '{gid}'")
    return "CASE " + " ".join(parts) + " END"


_GROUPED = f", grouped AS (SELECT *, {_group_case_sql()} AS group_id FROM sessions)"


def _grouped(spark, sf):
    return A.assign_group(_sessions(spark, sf), group_rules(spark))


@register("assign_group", O.with_sessions("SELECT * FROM grouped", I, M, H, HIDDEN_APPS).replace(
    "\nSELECT * FROM grouped", _GROUPED + "\nSELECT * FROM grouped"))
def assign_group(spark, sf):
    return _grouped(spark, sf)


@register(
    "group_totals",
    O.with_sessions("", I, M, H, HIDDEN_APPS)
    + _GROUPED
    + """
SELECT stream_key, group_id, count(*) AS sessions, CAST(sum("end" - start) AS BIGINT) AS total_time
FROM grouped GROUP BY stream_key, group_id""",
)
def group_totals(spark, sf):
    return A.group_totals(_grouped(spark, sf))


@register(
    "group_sessions_list",
    O.with_sessions("", I, M, H, HIDDEN_APPS)
    + _GROUPED
    + f"""
SELECT {SESSION_COLS_SQL}, group_id,
       CAST(row_number() OVER (PARTITION BY stream_key, group_id ORDER BY session_seq) AS INTEGER) AS position
FROM grouped""",
)
def group_sessions_list(spark, sf):
    return A.group_sessions(_grouped(spark, sf)).select(*[c.strip().strip('"') for c in SESSION_COLS_SQL.split(",")], "group_id", "position")


@register(
    "assign_group_by_join",
    O.with_sessions("SELECT * FROM grouped", I, M, H, HIDDEN_APPS).replace("\nSELECT * FROM grouped", _GROUPED + "\nSELECT * FROM grouped"),
)
def assign_group_by_join(spark, sf):
    """J1 as it runs for rule tables that are too long for a literal list."""
    return A.assign_group(_sessions(spark, sf), group_rules(spark), max_literal_rules=0)


@register(
    "group_matches",
    _with_sessions(
        """SELECT stream_key, session_seq,
             coalesce(is_active AND app_id IN ('click_0', 'view_1') AND workspace IN (1, 3), FALSE) AS both_lists,
             coalesce(is_active AND workspace IN (1, 3), FALSE) AS workspaces_only,
             is_active AS no_list FROM sessions"""
    ),
)
def group_matches(spark, sf):
    """One rule's match on every session, with both lists, one and none."""
    apps, wss = F.array(F.lit("click_0"), F.lit("view_1")), F.array(F.lit(1), F.lit(3))
    none, no_ws = F.array().cast("array<string>"), F.array().cast("array<int>")
    return _sessions(spark, sf).select(
        "stream_key",
        "session_seq",
        A.group_matches(apps, wss).alias("both_lists"),
        A.group_matches(none, wss).alias("workspaces_only"),
        A.group_matches(none, no_ws).alias("no_list"),
    )


# ---------------------------------------------------------------- query path


@register(
    "filter_range",
    _with_sessions(f'SELECT {SESSION_COLS_SQL} FROM sessions WHERE start >= {RANGE_FROM} AND "end" <= {RANGE_TO}'),
)
def filter_range(spark, sf):
    return Q.filter_range(_sessions(spark, sf), RANGE_FROM, RANGE_TO)


@register("filter_from_only", _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions WHERE start >= {FROM_ONLY}"))
def filter_from_only(spark, sf):
    return Q.filter_range(_sessions(spark, sf), FROM_ONLY, None)


@register("filter_to_only", _with_sessions(f'SELECT {SESSION_COLS_SQL} FROM sessions WHERE "end" <= {TO_ONLY}'))
def filter_to_only(spark, sf):
    return Q.filter_range(_sessions(spark, sf), None, TO_ONLY)


def _paged_sql(order: str, lo: int, hi: int) -> str:
    return _with_sessions(
        f"""SELECT {SESSION_COLS_SQL}, rn - {lo} AS position FROM (
              SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY {order}) AS rn FROM sessions)
            WHERE rn > {lo} AND rn <= {hi}"""
    )


@register("order_duration_asc", _paged_sql('"end" - start ASC, session_seq ASC', 0, 3))
def order_duration_asc(spark, sf):
    return Q.limit_offset(_sessions(spark, sf), limit=3, sort_by_duration="asc", per_stream=True)


@register(
    "order_duration_desc",
    _with_sessions(
        f'SELECT {SESSION_COLS_SQL} FROM sessions ORDER BY "end" - start DESC, stream_key, session_seq LIMIT 50'
    ),
)
def order_duration_desc(spark, sf):
    return Q.limit_offset(_sessions(spark, sf), limit=50, sort_by_duration="desc")


@register("order_start_desc_page", _paged_sql("start DESC, session_seq ASC", 1, 3))
def order_start_desc_page(spark, sf):
    return Q.limit_offset(_sessions(spark, sf), limit=2, offset=1, sort_by_start="desc", per_stream=True)


@register(
    "query_last",
    _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions ORDER BY start DESC, stream_key, session_seq LIMIT 20"),
)
def query_last(spark, sf):
    return Q.query_last(_sessions(spark, sf), 20)


@register("query_last_per_user", _paged_sql("start DESC, session_seq ASC", 0, 2))
def query_last_per_user(spark, sf):
    return Q.query_last(_sessions(spark, sf), 2, per_stream=True)


@register(
    "max_key",
    _with_sessions("SELECT stream_key, max(session_seq) AS max_session_seq FROM sessions GROUP BY stream_key"),
)
def max_key(spark, sf):
    return Q.max_key(_sessions(spark, sf))


@register(
    "last_per_stream",
    _with_sessions(
        f"""SELECT {SESSION_COLS_SQL} FROM (
              SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY session_seq DESC) AS rn FROM sessions)
            WHERE rn = 1"""
    ),
)
def last_per_stream(spark, sf):
    return Q.last_per_stream(_sessions(spark, sf))


# ---------------------------------------------------------------- reports


def _fmt_sql(secs: str, fmt: str) -> str:
    return f"strftime(make_timestamp(({secs} + {REPORT_OFFSET}) * 1000000), '{fmt}')"


@register(
    "timeline",
    _with_sessions(
        f"""SELECT stream_key, session_seq, start, "end", position, new_day,
               CASE WHEN new_day THEN {_fmt_sql('start', '%a, %d %B %Y')} END AS day_heading,
               {_fmt_sql('start', '%H:%M')} AS local_time,
               {_human_sql('"end" - start')} AS duration_text,
               CASE WHEN NOT is_active THEN 'Idle' WHEN workspace IS NULL THEN app_id
                    ELSE app_id || ', ' || CAST(workspace AS VARCHAR) END AS label
        FROM (
          SELECT *, coalesce(lag((start + {REPORT_OFFSET}) // 86400) OVER (PARTITION BY stream_key ORDER BY rn)
                             <> (start + {REPORT_OFFSET}) // 86400, TRUE) AS new_day, rn AS position
          FROM (SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY start, session_seq) AS rn
                FROM sessions WHERE start >= {RANGE_FROM} AND "end" <= {RANGE_TO})
          WHERE rn <= 50)"""
    ),
)
def timeline(spark, sf):
    return R.timeline(_sessions(spark, sf), RANGE_FROM, RANGE_TO, limit=50, offset_seconds=REPORT_OFFSET)


def _report_sql(order: str) -> str:
    return _with_sessions(
        f"""SELECT stream_key, 'state' AS kind, label, seconds,
               row_number() OVER (PARTITION BY stream_key ORDER BY {order}) AS position,
               {_human_sql('seconds')} AS duration_text
        FROM (SELECT stream_key, {_state_label_sql()} AS label, CAST(sum("end" - start) AS BIGINT) AS seconds
              FROM sessions GROUP BY stream_key, is_active, app_id, workspace)
        UNION ALL
        SELECT stream_key, 'total', 'Total screen time', a, NULL, {_human_sql('a')} FROM tot
        UNION ALL
        SELECT stream_key, 'total', 'Idle time', i, NULL, {_human_sql('i')} FROM tot"""
    ).replace(
        "\nSELECT stream_key, 'state'",
        f""",
tot AS (SELECT stream_key, {_sum_sql('is_active', 'a')}, {_sum_sql('NOT is_active', 'i')}
        FROM sessions GROUP BY stream_key)
SELECT stream_key, 'state'""",
        1,
    )


@register("time_report_by_time", _report_sql("seconds ASC, label ASC"))
def time_report_by_time(spark, sf):
    return R.time_report(_sessions(spark, sf), ascending=True, by_time=True)


@register("time_report_by_label", _report_sql("label DESC, label DESC"))
def time_report_by_label(spark, sf):
    return R.time_report(_sessions(spark, sf), ascending=False, by_time=False)


# ---------------------------------------------------------------- checks


@register(
    "check_sessions",
    _with_machine(
        """SELECT stream_key, seq, start, flush_t AS "end", is_active, app_id, workspace,
             concat_ws(';',
               CASE WHEN start IS NULL THEN 'start is null' END,
               CASE WHEN flush_t IS NULL THEN 'end is null' END,
               CASE WHEN is_active IS NULL THEN 'is_active is null' END,
               CASE WHEN flush_t < start THEN 'end before start' END,
               CASE WHEN is_active AND app_id IS NULL THEN 'active without app_id' END,
               CASE WHEN NOT is_active AND app_id IS NOT NULL THEN 'idle with app_id' END,
               CASE WHEN NOT is_active AND workspace IS NOT NULL THEN 'idle with workspace' END) AS violation
           FROM segs""",
        extra=_SEGMENTS,
    ),
)
def check_sessions(spark, sf):
    """V1 over every segment taken as a candidate session (end = its last flush)."""
    s = X.segments(_events(spark, sf), CFG, H)
    cand = s.select(
        "stream_key",
        "seq",
        "start",
        F.col("flush_t").alias("end"),
        F.col("state.is_active").alias("is_active"),
        F.col("state.app_id").alias("app_id"),
        F.col("state.workspace").alias("workspace"),
    )
    return U.check_sessions(cand)


# ---------------------------------------------------------------- F1 time parsing

from sessionlake.fixtures import compositor_events, envelopes, read_table  # noqa: E402
from sessionlake.functions.scalar import epoch_to_ntz  # noqa: E402
from sessionlake.functions.timeparse import DATE_FORMATS, TIME_FORMATS, parse_time_column  # noqa: E402
from sessionlake.sources import compositor as C  # noqa: E402
from sessionlake.sources import envelopes as EN  # noqa: E402
from sessionlake.sources import store as ST  # noqa: E402

PARSE_TODAY = "2024-01-31"
PARSE_TODAY_EPOCH = 1706659200  # PARSE_TODAY 00:00 UTC
_N_FORMATS = 2 + len(DATE_FORMATS) * len(TIME_FORMATS) + len(DATE_FORMATS) + len(TIME_FORMATS)
_SEPARATORS = [" ", "T", "_", "+"]


def _time_texts(df: DataFrame) -> DataFrame:
    """Render each event's second in one of the accepted formats (format id = seq mod count)."""
    off = REPORT_OFFSET
    local = epoch_to_ntz(F.col("t") + F.lit(off))
    fid = F.pmod(F.col("seq"), F.lit(_N_FORMATS)).cast("int")
    rfc = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))
    text = F.when(fid == 0, F.col("t").cast("string")).when(fid == 1, rfc)
    i = 2
    for d in DATE_FORMATS:
        for tf in TIME_FORMATS:
            sep = _SEPARATORS[i % 4]
            text = text.when(fid == i, F.date_format(local, f"{d}'{sep}'{tf}") if sep != " " else F.date_format(local, f"{d} {tf}"))
            i += 1
    for d in DATE_FORMATS:
        text = text.when(fid == i, F.date_format(local, d))
        i += 1
    for tf in TIME_FORMATS:
        text = text.when(fid == i, F.date_format(local, tf))
        i += 1
    return df.select("stream_key", "seq", fid.alias("fmt_id"), text.alias("text"))


def _expected_time_sql() -> str:
    off = REPORT_OFFSET
    cases = ["WHEN 0 THEN t", "WHEN 1 THEN t"]
    i = 2
    for _d in DATE_FORMATS:
        for tf in TIME_FORMATS:
            exact = "ss" in tf
            cases.append(f"WHEN {i} THEN {'t' if exact else 't - (t % 60)'}")
            i += 1
    for _d in DATE_FORMATS:
        cases.append(f"WHEN {i} THEN ((t + {off}) // 86400) * 86400 - {off}")
        i += 1
    for tf in TIME_FORMATS:
        tod = f"((t + {off}) % 86400)"
        tod = tod if "ss" in tf else f"({tod} - {tod} % 60)"
        cases.append(f"WHEN {i} THEN {PARSE_TODAY_EPOCH} - {off} + {tod}")
        i += 1
    return (
        "WITH "
        + O.mapped_events_cte()
        + f"\nSELECT stream_key, seq, CAST(seq % {_N_FORMATS} AS INTEGER) AS fmt_id,"
        + f" CAST(CASE seq % {_N_FORMATS} {' '.join(cases)} END AS BIGINT) AS parsed FROM se"
    )


@register("parse_time_column", _expected_time_sql())
def parse_time_column_q(spark, sf):
    texts = _time_texts(_events(spark, sf))
    return texts.select(
        "stream_key", "seq", "fmt_id", parse_time_column("text", REPORT_OFFSET, PARSE_TODAY).alias("parsed")
    )


# ---------------------------------------------------------------- S6-S8 envelopes

_ENV_SQL = (
    "WITH "
    + O.mapped_events_cte().replace(
        "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type",
        "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, value",
    ).replace("  FROM se_raw\n)", "  , value, k FROM se_raw\n)")
    + """,
env AS (
  SELECT stream_key, 'u' || CAST(stream_key AS VARCHAR) || '-b' || CAST(seq % 2 AS VARCHAR) AS source, seq, ts_us,
    CASE WHEN value < 0.5 THEN 'Ping' WHEN value < 1.0 THEN 'Handshake'
         WHEN value < 1.5 THEN NULL ELSE 'Event' END AS msg_type,
    CASE WHEN value < 1.5 THEN NULL WHEN value < 1.7 THEN 'tick' ELSE kind END AS kind,
    CASE WHEN value >= 1.7 AND kind = 'focus' THEN app_id END AS app_id,
    CASE WHEN value >= 1.7 AND kind = 'workspace' THEN workspace END AS workspace,
    CASE WHEN value >= 0.5 AND value < 1.0 THEN CAST(k % 3 AS BIGINT) END AS protocol_version,
    CASE WHEN value >= 0.5 AND value < 1.0 THEN 'compositor' END AS backend_name,
    CASE WHEN value >= 1.0 AND value < 1.2 THEN 'malformed json'
         WHEN value >= 1.2 AND value < 1.4 THEN 'unknown message'
         WHEN value >= 1.4 AND value < 1.5 THEN 'message too large' END AS reject
  FROM se
)"""
)
_ENV_COLS = "stream_key, source, seq, msg_type, kind, app_id, workspace, protocol_version, backend_name"


def _parsed(spark, sf) -> DataFrame:
    return EN.parse_envelopes(envelopes(read_table(spark, sf, "events")))


@register("parse_envelopes", _ENV_SQL + f"\nSELECT {_ENV_COLS} FROM env WHERE reject IS NULL")
def parse_envelopes(spark, sf):
    good, _bad = EN.split_quarantine(_parsed(spark, sf))
    return good.select(*[c.strip() for c in _ENV_COLS.split(",")])


@register("quarantine", _ENV_SQL + "\nSELECT stream_key, source, seq, reject FROM env WHERE reject IS NOT NULL")
def quarantine(spark, sf):
    _good, bad = EN.split_quarantine(_parsed(spark, sf))
    return bad.select("stream_key", "source", "seq", "reject")


@register(
    "accept_sources",
    _ENV_SQL
    + """,
hs AS (SELECT source, arg_max(protocol_version, CAST(ts_us AS HUGEINT) * 1000000000 + seq) AS pv
       FROM env WHERE reject IS NULL AND msg_type = 'Handshake' GROUP BY source)
SELECT stream_key, source, seq, msg_type, kind FROM env
WHERE reject IS NULL AND source IN (SELECT source FROM hs WHERE pv <= 1)""",
)
def accept_sources(spark, sf):
    good, _bad = EN.split_quarantine(_parsed(spark, sf))
    return EN.accept_sources(good, enforce=True).select("stream_key", "source", "seq", "msg_type", "kind")


def _from_log_sql() -> str:
    """The machine over the events of accepted producers."""
    env = _ENV_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace("\nse AS (", "\nse_all AS (").replace("  FROM se\n)", "  FROM se_all\n)")
    return (
        env
        + """,
hs AS (SELECT source, arg_max(protocol_version, CAST(ts_us AS HUGEINT) * 1000000000 + seq) AS pv
       FROM env WHERE reject IS NULL AND msg_type = 'Handshake' GROUP BY source),
se AS (SELECT stream_key, seq, ts_us, (ts_us - (ts_us % 1000000)) // 1000000 AS t, kind, app_id, workspace FROM env
       WHERE msg_type = 'Event' AND kind <> 'tick' AND source IN (SELECT source FROM hs WHERE pv <= 1)),"""
        + O.machine_ctes(I, M, H, HIDDEN_APPS)
        + O.SESSIONS_CTE
        + f"\nSELECT {SESSION_COLS_SQL} FROM sessions"
    )


@register("sessions_from_log", _from_log_sql())
def sessions_from_log(spark, sf):
    """S6 -> S7 -> S8 -> X7 -> X1: the producers' logs as text files, read back, to sessions."""
    from sessionlake.config import saved, storage_root
    from sessionlake.sources import message_log as ML

    root = storage_root(spark, "message-log")
    ML.write_message_lines(envelopes(read_table(spark, sf, "events")), root)
    good, _bad = EN.split_quarantine(EN.parse_envelopes(ML.read_message_lines(spark, root)))
    good = saved(good, "log-messages")  # S8 and X1 read the messages several times; lines are read and parsed once
    return X.sessionize(EN.to_session_events(EN.accept_sources(good)), CFG, H)


# ---------------------------------------------------------------- S9 / J3 compositor


@register(
    "normalize_compositor",
    """WITH raw AS (
  SELECT user_id AS stream_key, event_id AS seq, epoch_us(ts) AS ts_us, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ce AS (SELECT *, 'app_' || CAST(seq % 5 AS VARCHAR) AS app, CAST(k % 20 AS BIGINT) AS win,
              row_number() OVER (PARTITION BY stream_key ORDER BY ts_us, seq) AS n FROM raw),
upd AS (
  SELECT stream_key, win AS window_id, n * 10 AS ord, TRUE AS alive,
         CASE WHEN k % 10 <> 0 THEN app END AS app_id FROM ce WHERE event_type = 'click'
  UNION ALL SELECT stream_key, win, n * 10, FALSE, NULL FROM ce WHERE event_type = 'purchase' AND k % 3 = 0
  UNION ALL SELECT stream_key, win, n * 10, TRUE, app FROM ce WHERE event_type = 'error'
  UNION ALL SELECT stream_key, CAST((k + 1) % 20 AS BIGINT), n * 10 + 1, TRUE, app FROM ce WHERE event_type = 'error'
),
look AS (SELECT stream_key, seq, ts_us, win AS window_id, n * 10 AS ord FROM ce WHERE event_type = 'view'),
hit AS (SELECT l.stream_key, l.seq, l.ts_us, u.alive, u.app_id
        FROM look l ASOF JOIN upd u
          ON l.stream_key = u.stream_key AND l.window_id = u.window_id AND l.ord >= u.ord)
SELECT stream_key, seq, 0 AS pos, ts_us, 'focus' AS kind, app_id, CAST(NULL AS INTEGER) AS workspace
FROM hit WHERE alive
UNION ALL SELECT stream_key, seq, 0, ts_us, 'focus', app, NULL FROM ce WHERE event_type = 'error'
UNION ALL SELECT stream_key, seq, 0, ts_us, 'focus', NULL, NULL FROM ce WHERE event_type = 'purchase' AND k % 3 = 1
UNION ALL SELECT stream_key, seq, 0, ts_us, 'workspace', NULL, CAST(k % 4 AS INTEGER)
  FROM ce WHERE event_type = 'purchase' AND k % 3 = 2 AND k % 2 = 0
UNION ALL SELECT stream_key, seq, 0, ts_us, 'workspace', NULL, CAST(k % 4 AS INTEGER)
  FROM ce WHERE event_type = 'signup'""",
)
def normalize_compositor(spark, sf):
    core, _rejects = C.normalize_compositor(compositor_events(read_table(spark, sf, "events")))
    return core


@register("normalize_compositor_hot_split", ORACLE["normalize_compositor"])
def normalize_compositor_hot_split(spark, sf):
    """S9/J3 with thresholds so low that most windows take the chunked as-of lookup."""
    core, _rejects = C.normalize_compositor(
        compositor_events(read_table(spark, sf, "events")), hot_key_rows=3, rows_per_chunk=2
    )
    return core


# ---------------------------------------------------------------- S1-S5 storage

_STORED_SQL = f'SELECT {SESSION_COLS_SQL}, CAST(start // 86400 AS BIGINT) AS day FROM sessions'


def _new_table(spark, name: str) -> str:
    from sessionlake.config import storage_root

    return storage_root(spark, name)


@register("create_and_read_sessions", _with_sessions(_STORED_SQL))
def create_and_read_sessions(spark, sf):
    path = _new_table(spark, "sessions")
    ST.create_sessions(spark, path)
    ST.create_sessions(spark, path)  # idempotent
    ST.append_sessions(_sessions(spark, sf), path)
    return ST.read_sessions(spark, path)


@register("append_sessions", _with_sessions(_STORED_SQL))
def append_sessions(spark, sf):
    """Two appends (active, then idle sessions) read back as one table."""
    path = _new_table(spark, "sessions")
    ST.create_sessions(spark, path)
    s = _sessions(spark, sf)
    ST.append_sessions(A.active_only(s), path)
    ST.append_sessions(A.idle_only(s), path)
    return ST.read_sessions(spark, path)


UPDATE_SHIFT = 60  # seconds added to the end of the replaced session


@register(
    "upsert_last",
    _with_sessions(
        f"""SELECT stream_key, session_seq, start,
                   "end" + CASE WHEN session_seq = max(session_seq) OVER (PARTITION BY stream_key)
                                THEN {UPDATE_SHIFT} ELSE 0 END AS "end", is_active, app_id, workspace
            FROM sessions"""
    ),
)
def upsert_last(spark, sf):
    """Each stream's newest session replaced by a copy whose end is one minute later."""
    s = _sessions(spark, sf)
    updates = Q.last_per_stream(s).select(
        "stream_key", "start", (F.col("end") + F.lit(UPDATE_SHIFT)).alias("end"), "is_active", "app_id", "workspace"
    )
    return ST.update_last(s, updates)


@register(
    "update_by_key",
    _with_sessions(
        """SELECT stream_key, session_seq, start, "end", is_active,
                  CASE WHEN session_seq = 2 AND is_active THEN app_id || '*' ELSE app_id END AS app_id,
                  CASE WHEN session_seq = 2 AND NOT is_active THEN 0 ELSE workspace END AS workspace
           FROM sessions"""
    ),
)
def update_by_key(spark, sf):
    """Every stream's second session edited; copies under unknown keys change nothing."""
    s = _sessions(spark, sf)
    edits = s.filter(F.col("session_seq") == 2).select(
        *ST.KEY,
        "start",
        "end",
        "is_active",
        F.when(F.col("is_active"), F.concat(F.col("app_id"), F.lit("*"))).otherwise(F.col("app_id")).alias("app_id"),
        F.when(~F.col("is_active"), F.lit(0)).otherwise(F.col("workspace")).cast("int").alias("workspace"),
    )
    unknown = s.select(
        "stream_key", (F.col("session_seq") + F.lit(1_000_000)).alias("session_seq"), *ST.DATA_COLUMNS
    )
    return ST.update_by_key(s, edits.unionByName(unknown))


# ---------------------------------------------------------------- X2 logged mode

from sessionlake.streaming import logged as LG  # noqa: E402

_LOG_COLS = ["stream_key", "seq", "ts_us", "t", "kind", "app_id", "workspace"]


def _logged(spark, sf) -> DataFrame:
    """The event log plus explicit ticks (hourly, due every 6 h) and flushes (every 7 h) of each stream."""
    ev = _events(spark, sf).select(*_LOG_COLS)
    return ev.unionByName(LG.hourly_ticks(ev, H)).unionByName(LG.hourly_ticks(ev, H, 7 * 3600, LG.FLUSH))


@register("sessionize_logged", _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions", mode="logged"))
def sessionize_logged(spark, sf):
    """A log with explicit tick and flush rows."""
    return LG.sessionize_logged(_logged(spark, sf), CFG)


@register(
    "response_log_logged",
    "WITH RECURSIVE "
    + O.ticked_events_cte(H)
    + ","
    + O.machine_ctes(I, M, H, HIDDEN_APPS, "logged")
    + """
SELECT s.stream_key, e.t, s.seq, e.kind,
  CASE WHEN e.kind NOT IN ('tick', 'flush') THEN s.resp WHEN NOT s.has_cur THEN 'Ignored' WHEN s.fx IS NULL THEN 'Handled'
       WHEN NOT s.ok THEN 'Ignored' WHEN s.fl_merged THEN 'Flushed(merged)' ELSE 'Flushed' END AS response
FROM st s JOIN ev e ON e.stream_key = s.stream_key AND e.n = s.n WHERE s.ph = 0""",
)
def response_log_logged(spark, sf):
    """S10 for X2: replies to events, ticks and flushes."""
    rows = LG.response_log_logged(_logged(spark, sf), CFG)
    return rows.select("stream_key", F.floor(F.col("ts_us") / 1_000_000).alias("t"), "seq", "kind", "response")


# ---------------------------------------------------------------- X3 streaming

from pyspark.sql import types as T  # noqa: E402

from sessionlake.streaming import stream as SX  # noqa: E402

STREAM_CHUNK = 5 * 86400  # one input file per producer per 5 days of event time
STREAM_FILE_ROWS = 1_000_000  # rows of such a file; a slice with more has several
_STREAM_INPUT = T.StructType(
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


def _write_stream_input(spark, sf, root: str, producers: int = 2) -> list[str]:
    """Land the event log as files of two producers (split by seq), which arrive in event-time order.

    One job writes a folder per producer and 5-day slice; the files' times are then set by slice, as
    the file source reads them in that order. A heartbeat past the horizon ends each
    producer's input so the watermark can close the last seconds.
    """
    from sessionlake.sources.store import set_arrival

    ev = _events(spark, sf).select(*_LOG_COLS, F.pmod(F.col("seq"), F.lit(producers)).alias("producer"), F.floor(F.col("t") / STREAM_CHUNK).alias("slice"))
    # rows are dealt by slice, else each task that reads events would write a file of each, and the batches would grow with the files
    rows, low, high = _events(spark, sf).select(F.count(F.lit(1)), F.min("t"), F.max("t")).first()
    slices = 1 if low is None else producers * (high // STREAM_CHUNK - low // STREAM_CHUNK + 1)
    parts = -(-rows // (slices * STREAM_FILE_ROWS)) or 1
    ev = ev.repartition(slices * parts, "producer", "slice", F.pmod(F.xxhash64("seq"), F.lit(parts)))
    ev.write.option("maxRecordsPerFile", STREAM_FILE_ROWS).partitionBy("producer", "slice").parquet(root)
    end_s = H + 10 * 86400
    beat = spark.createDataFrame([(None, 0, end_s * 1_000_000, end_s, SX.HEARTBEAT, None, None)], _STREAM_INPUT)
    dirs = [f"{root}/producer={p}" for p in range(producers)]
    for d in dirs:
        beat.coalesce(1).write.parquet(f"{d}/slice={end_s // STREAM_CHUNK}")
        set_arrival(spark, d, "slice")
    return dirs


@register("sessionize_stream", _with_sessions(f"SELECT {SESSION_COLS_SQL} FROM sessions"))
def sessionize_stream(spark, sf):
    """X3 + X7 + X8: two producer streams -> keyed state -> upsert log -> compacted sessions."""
    from sessionlake.config import storage_root

    root = storage_root(spark, "stream")
    dirs = _write_stream_input(spark, sf, f"{root}/input")
    streams = [spark.readStream.schema(_STREAM_INPUT).option("maxFilesPerTrigger", 4).parquet(d).select(*_LOG_COLS) for d in dirs]
    merged = EN.merge_sources(*streams)
    # a trigger may end within a slice, so rows may be as late as a slice is long
    upserts = SX.sessionize_stream(merged, CFG, horizon=H, watermark_delay="6 days")
    SX.run_to_completion(spark, upserts, f"{root}/upserts", f"{root}/checkpoint")
    return SX.read_compacted(spark, f"{root}/upserts")
