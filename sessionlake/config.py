"""Settings of the session state machine and the Spark session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the reference's default configuration.
DEFAULT_FLUSH_INTERVAL = 15
DEFAULT_MIN_SESSION_DURATION = 5
# Largest accepted message line in bytes.
MAX_MESSAGE_SIZE = 64 * 1024
# Highest producer protocol version the server understands.
PROTOCOL_VERSION = 1


@dataclass(frozen=True)
class SessionConfig:
    """Configuration of the sessionizer.

    flush_interval: seconds between automatic flushes of the open session.
    min_session_duration: a flushed session is kept only if ``end - start`` is
        greater than this; 0 turns the filter off.
    hidden_applications: focus events of these apps are ignored.
    flush: ``"interval"`` reproduces the flush-on-tick behaviour (a focus change
        between flushes loses the tail); ``"boundary"`` closes every segment at
        the next state change, nothing is lost.
    """

    flush_interval: int = DEFAULT_FLUSH_INTERVAL
    min_session_duration: int = DEFAULT_MIN_SESSION_DURATION
    hidden_applications: tuple[str, ...] = field(default_factory=tuple)
    flush: str = "interval"

    def __post_init__(self):
        if self.flush not in ("interval", "boundary"):
            raise ValueError(f"flush must be 'interval' or 'boundary', got {self.flush!r}")
        if self.flush_interval <= 0:
            raise ValueError("flush_interval must be positive")
        if self.min_session_duration < 0:
            raise ValueError("min_session_duration must be >= 0")
        object.__setattr__(self, "hidden_applications", tuple(self.hidden_applications))


def get_spark(master: str | None = None, app_name: str = "sessionlake", **conf) -> SparkSession:
    """Build (or reuse) a session with the settings the jobs are written for.

    On a cluster pass no master and let spark-submit decide. The UI stays off.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update(conf)
    for k, v in defaults.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only local runs without it (tests) get a fresh folder under the system temp dir.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder; a machine-local one is not safe on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="sessionlake-ckpt-")
    spark.sparkContext.setCheckpointDir(conf_dir)
    return spark.sparkContext.getCheckpointDir() or conf_dir


def storage_root(spark: SparkSession, name: str) -> str:
    """A new folder for written tables under the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "sessionlake", f"{name}-{uuid.uuid4().hex[:12]}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written under the shared checkpoint folder and read from there: lineage ends here."""
    path = storage_root(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
