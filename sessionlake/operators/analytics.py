"""Session predicates and aggregates.

All aggregates are keyed by ``stream_key`` (the reference holds one user per
database); ``by=()`` gives one global row instead. Spark runs them as a partial
(map-side) hash aggregate, one shuffle on the group keys, and a final aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _duration() -> Column:
    return F.col("end") - F.col("start")


# ---------------------------------------------------------------- predicates


def with_duration(sessions: DataFrame) -> DataFrame:
    """``duration = end - start``."""
    return sessions.withColumn("duration", _duration())


def active_only(sessions: DataFrame) -> DataFrame:
    """Active sessions."""
    return sessions.filter(F.col("is_active"))


def idle_only(sessions: DataFrame) -> DataFrame:
    """Idle sessions."""
    return sessions.filter(~F.col("is_active"))


def for_app(sessions: DataFrame, app_id: str) -> DataFrame:
    """P5: active sessions of one app, any workspace."""
    return sessions.filter(F.col("is_active") & (F.col("app_id") == F.lit(app_id)))


def group_matches(app_ids: Column, workspaces: Column) -> Column:
    """A rule matches an active session when each non-empty list contains its value.

    An absent workspace never matches a non-empty workspace list; idle never matches.
    """
    app_ok = (F.size(app_ids) == 0) | F.coalesce(F.array_contains(app_ids, F.col("app_id")), F.lit(False))
    ws_ok = (F.size(workspaces) == 0) | F.coalesce(
        F.array_contains(workspaces, F.col("workspace")), F.lit(False)
    )
    return F.col("is_active") & app_ok & ws_ok


# ---------------------------------------------------------------- sums (A1-A4)


def _sum0(expr: Column) -> Column:
    return F.coalesce(F.sum(expr), F.lit(0)).cast("long")


def _agg(sessions: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return sessions.groupBy(*by).agg(*aggs) if by else sessions.agg(*aggs)


def total_screen_time(sessions: DataFrame, by: Sequence[str] = ("stream_key",)) -> DataFrame:
    """A1: sum of active durations; 0 when there is none."""
    return _agg(sessions, by, _sum0(F.when(F.col("is_active"), _duration())).alias("total_screen_time"))


def idle_time(sessions: DataFrame, by: Sequence[str] = ("stream_key",)) -> DataFrame:
    """A3: sum of idle durations; 0 when there is none."""
    return _agg(sessions, by, _sum0(F.when(~F.col("is_active"), _duration())).alias("idle_time"))


def screen_time_app(sessions: DataFrame, app_id: str, by: Sequence[str] = ("stream_key",)) -> DataFrame:
    """A2: time of one app over all workspaces; 0 when absent.

    The predicate sits inside the sum (not a filter) so every key gets a row.
    """
    hit = F.col("is_active") & (F.col("app_id") == F.lit(app_id))
    return _agg(sessions, by, _sum0(F.when(hit, _duration())).alias("screen_time_app"))


def time_for_each_state(sessions: DataFrame, by: Sequence[str] = ("stream_key",)) -> DataFrame:
    """A4: time per state; idle is one group, workspaces apart."""
    return sessions.groupBy(*by, "is_active", "app_id", "workspace").agg(_sum0(_duration()).alias("total_time"))


# ---------------------------------------------------------------- groups

_ANY_APP = "\u0000any"
_ANY_WS = -(2**31)


def assign_group_literal(sessions: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """J1 for a rule list given in code: ``(group_id, app_ids, workspaces)`` in priority order.

    Becomes one ``CASE WHEN`` chain: first matching rule wins, no match -> NULL.
    """
    expr = None
    for group_id, apps, wss in rules:
        apps_c = F.array(*[F.lit(a) for a in apps]).cast("array<string>")
        wss_c = F.array(*[F.lit(w) for w in wss]).cast("array<int>")
        cond = group_matches(apps_c, wss_c)
        expr = F.when(cond, F.lit(group_id)) if expr is None else expr.when(cond, F.lit(group_id))
    return sessions.withColumn("group_id", expr if expr is not None else F.lit(None).cast("string"))


#: Rules that are few enough for a CASE expression on every session.
MAX_LITERAL_RULES = 500


def assign_group(
    sessions: DataFrame, rules: DataFrame, salt_buckets: int = 16, max_literal_rules: int = MAX_LITERAL_RULES
) -> DataFrame:
    """J1 for a rule table (priority, group_id, app_ids, workspaces): first match by priority, else NULL.

    A rule list is a setting: up to ``max_literal_rules`` rows of it (counted first) become
    the ``CASE`` of `assign_group_literal`, which moves no session at all. A longer table is joined.
    """
    few = rules.select("priority", "group_id", "app_ids", "workspaces").limit(max_literal_rules + 1).collect()
    if len(few) > max_literal_rules:
        return assign_group_join(sessions, rules, salt_buckets)
    ordered = sorted(few, key=lambda r: (r.priority, r.group_id))
    return assign_group_literal(sessions, [(r.group_id, r.app_ids, r.workspaces) for r in ordered])


def assign_group_join(sessions: DataFrame, rules: DataFrame, salt_buckets: int = 16) -> DataFrame:
    """J1 by joins, for rule tables of any length.

    The theta join on P6 is rewritten as an equi join: each rule is exploded into
    match keys (app or ANY, workspace or ANY) and each active session probes its
    four keys. Wildcard keys are shared by every session, so they are salted
    across ``salt_buckets`` to keep one key from landing in one task. Spark
    decides broadcast vs shuffle from the rule table's size estimate. The winner
    per session is ``min_by(group_id, priority)``, joined back by the session's key; idle sessions
    match nothing, so they take no part in the probing. Sessions keep their row when
    nothing matches (group NULL).
    """
    n = int(salt_buckets)
    app_key = F.explode(
        F.when(F.size("app_ids") == 0, F.array(F.lit(_ANY_APP))).otherwise(F.col("app_ids"))
    )
    keyed = rules.select(
        "priority",
        "group_id",
        app_key.alias("app_key"),
        F.when(F.size("workspaces") == 0, F.array(F.lit(_ANY_WS))).otherwise(F.col("workspaces")).alias("_wss"),
    ).select("priority", "group_id", "app_key", F.explode(F.col("_wss").cast("array<int>")).alias("ws_key"))
    # replicate rule rows over all salts (rules are few; sessions are many)
    keyed = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    cols = sessions.columns
    probes = F.array(
        F.struct(F.col("app_id").alias("a"), F.col("workspace").alias("w")),
        F.struct(F.col("app_id").alias("a"), F.lit(_ANY_WS).alias("w")),
        F.struct(F.lit(_ANY_APP).alias("a"), F.col("workspace").alias("w")),
        F.struct(F.lit(_ANY_APP).alias("a"), F.lit(_ANY_WS).alias("w")),
    )
    key = ["stream_key", "session_seq"]
    probe = sessions.filter("is_active").select(*key, F.explode(probes).alias("_p")).select(
        *key,
        F.col("_p.a").alias("app_key"),
        F.col("_p.w").alias("ws_key"),
        F.pmod(F.xxhash64("stream_key", "session_seq"), F.lit(n)).cast("int").alias("salt"),
    )
    found = probe.join(keyed, ["app_key", "ws_key", "salt"]).groupBy(*key).agg(
        F.min_by("group_id", F.struct("priority", "group_id")).alias("group_id")
    )
    return sessions.join(found, key, "left").select(*cols, "group_id")


def group_totals(grouped: DataFrame, by: Sequence[str] = ("stream_key", "group_id")) -> DataFrame:
    """A5 summary: sessions and time per group (NULL group kept)."""
    return grouped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"), _sum0(_duration()).alias("total_time")
    )


def group_sessions(grouped: DataFrame) -> DataFrame:
    """A5: sessions by group, with ``position``: the place in input order among the stream's sessions of the group.

    Each session keeps its own row; nothing is collected into a per-group list. A group is
    numbered inside its stream, as a stream's sessions are a list of their own.
    """
    order = Window.partitionBy("stream_key", "group_id").orderBy("session_seq")
    return grouped.withColumn("position", F.row_number().over(order))
