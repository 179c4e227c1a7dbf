"""Column expressions (F1-F6, S11). All JVM-side, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- time

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ts_micros(df: DataFrame, col: str = "ts") -> Column:
    """Microseconds since the epoch for a TIMESTAMP or TIMESTAMP_NTZ column.

    NTZ values are read as UTC wall clock, so the result does not depend on
    the session time zone.
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{col}`)")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(col))
    if isinstance(dtype, T.LongType | T.IntegerType):
        return F.col(col).cast("long") * F.lit(1_000_000)
    raise TypeError(f"column {col} has unsupported type {dtype}")


def to_seconds(micros: Column | str) -> Column:
    """Clock value: whole epoch seconds (floor)."""
    x = _c(micros).cast("long")
    return ((x - F.pmod(x, F.lit(1_000_000))) / F.lit(1_000_000)).cast("long")


def epoch_to_ntz(seconds: Column | str) -> Column:
    """Epoch seconds to a TIMESTAMP_NTZ wall clock (UTC), independent of the session zone."""
    return F.expr(f"timestampadd(SECOND, 0, {_EPOCH_NTZ})") + F.make_dt_interval(
        secs=_c(seconds).cast("decimal(18,6)")
    )


# ---------------------------------------------------------------- state


def state(is_active: Column, app_id: Column, workspace: Column) -> Column:
    return F.struct(
        is_active.cast("boolean").alias("is_active"),
        app_id.cast("string").alias("app_id"),
        workspace.cast("int").alias("workspace"),
    )


def idle_state() -> Column:
    return state(F.lit(False), F.lit(None), F.lit(None))


def nest_state(df: DataFrame, name: str = "state") -> DataFrame:
    """Flat (is_active, app_id, workspace) columns to one struct column."""
    return df.withColumn(
        name, state(F.col("is_active"), F.col("app_id"), F.col("workspace"))
    ).drop("is_active", "app_id", "workspace")


def flatten_state(df: DataFrame, name: str = "state") -> DataFrame:
    """Struct state column to the three stored columns. Idle drops app and workspace."""
    s = F.col(name)
    return df.withColumns(
        {
            "is_active": s["is_active"],
            "app_id": F.when(s["is_active"], s["app_id"]),
            "workspace": F.when(s["is_active"], s["workspace"]),
        }
    ).drop(name)


# ---------------------------------------------------------------- labels


def state_label(is_active="is_active", app_id="app_id", workspace="workspace") -> Column:
    """Display text of a state: ``app (ws)``, ``app`` or ``idle``."""
    a, app, ws = _c(is_active), _c(app_id), _c(workspace)
    return (
        F.when(~a, F.lit("idle"))
        .when(ws.isNull(), app)
        .otherwise(F.concat(app, F.lit(" ("), ws.cast("string"), F.lit(")")))
    )


def timeline_label(is_active="is_active", app_id="app_id", workspace="workspace") -> Column:
    """Timeline text: ``app, ws``, ``app`` or ``Idle``."""
    a, app, ws = _c(is_active), _c(app_id), _c(workspace)
    return (
        F.when(~a, F.lit("Idle"))
        .when(ws.isNull(), app)
        .otherwise(F.concat(app, F.lit(", "), ws.cast("string")))
    )


# ---------------------------------------------------------------- durations (F2)


def human_duration(seconds: Column | str) -> Column:
    """``1h2m3s`` with zero parts left out; ``0s`` for 0; empty text when negative."""
    s = _c(seconds).cast("long")
    h = F.floor(s / 3600)
    m = F.floor((s % 3600) / 60)
    r = s % 60
    parts = F.concat(
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.lit("")),
        F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.lit("")),
        F.when(r > 0, F.concat(r.cast("string"), F.lit("s"))).otherwise(F.lit("")),
    )
    return F.when(s < 0, F.lit("")).when(s == 0, F.lit("0s")).otherwise(parts)


# ---------------------------------------------------------------- local time


def local_day(seconds: Column | str, offset_seconds: int = 0) -> Column:
    """``Fri, 05 January 2024`` at a fixed UTC offset."""
    return F.date_format(epoch_to_ntz(_c(seconds) + F.lit(offset_seconds)), "EEE, dd MMMM yyyy")


def local_time(seconds: Column | str, offset_seconds: int = 0) -> Column:
    """``14:30`` at a fixed UTC offset."""
    return F.date_format(epoch_to_ntz(_c(seconds) + F.lit(offset_seconds)), "HH:mm")


def local_date_key(seconds: Column | str, offset_seconds: int = 0) -> Column:
    """Local day number (days since epoch) at a fixed offset."""
    return F.floor((_c(seconds) + F.lit(offset_seconds)) / F.lit(86400)).cast("long")
