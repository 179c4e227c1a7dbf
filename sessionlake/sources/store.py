"""The session table on Parquet: create (S2), append (S3), read (S1), upserts.

Layout: one Parquet dataset partitioned by ``day = start div 86400`` so range
queries prune whole days (see ``operators.query.filter_range``). Rows are
identified by ``(stream_key, session_seq)``. Writes are appends of new files;
updates are expressed as DataFrame transformations (union + pick the newest
version per key) and written as a new snapshot, never in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import schema
from sessionlake.config import storage_root

KEY = ["stream_key", "session_seq"]
DATA_COLUMNS = ["start", "end", "is_active", "app_id", "workspace"]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, jpath


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return bool(fs.exists(jpath))


def set_arrival(spark: SparkSession, path: str, column: str) -> None:
    """Give the files under the folders ``column=n`` of ``path`` times that grow with n, a second apart."""
    fs, jpath = _fs(spark, path)
    folders = [s.getPath() for s in fs.listStatus(jpath) if s.getPath().getName().startswith(f"{column}=")]
    folders.sort(key=lambda p: int(p.getName().partition("=")[2]))
    for n, folder in enumerate(folders, 1):
        for file in fs.listStatus(folder):
            fs.setTimes(file.getPath(), 1_000_000_000_000 + n * 1000, -1)


def with_day(sessions: DataFrame) -> DataFrame:
    """Add the partition column ``day = start div 86400`` (floor)."""
    start = F.col("start")
    return sessions.withColumn("day", ((start - F.pmod(start, F.lit(86400))) / F.lit(86400)).cast("long"))


def create_sessions(spark: SparkSession, path: str) -> bool:
    """Create an empty session table at ``path`` if none is there. Idempotent.

    Returns True when it created the table.
    """
    if table_exists(spark, path):
        return False
    empty = spark.createDataFrame([], schema.SESSIONS_STORED)
    empty.write.mode("errorifexists").partitionBy("day").parquet(path)
    return True


def append_sessions(sessions: DataFrame, path: str, files_per_day: int = 1) -> None:
    """S3: append session rows (new files; existing files untouched).

    Rows are dealt by day, so an append adds ``files_per_day`` files a day and not one for each
    task and day; days that hold very many rows get more.
    """
    cols = [f.name for f in schema.SESSIONS.fields]
    rows = with_day(sessions.select(*cols))
    salt = F.pmod(F.xxhash64(*KEY), F.lit(int(files_per_day)))
    rows.repartition("day", salt).write.mode("append").partitionBy("day").parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Scan the table with its explicit schema; filters on ``day``/``start`` prune and push down."""
    return spark.read.schema(schema.SESSIONS_STORED).parquet(path)


def compact_versions(versions: DataFrame) -> DataFrame:
    """Keep the newest version of every ``(stream_key, session_seq)``.

    ``max_by(struct(row), version)`` is a hash aggregate with a map-side
    partial step, so duplicates collapse before the shuffle.
    """
    newest = F.max_by(F.struct(*DATA_COLUMNS), F.col("version")).alias("_row")
    return versions.groupBy(*KEY).agg(newest).select(*KEY, "_row.*")


def update_by_key(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace all data fields of the rows named by ``(stream_key, session_seq)``.

    Keys absent from ``base`` change nothing (left join from the base). When an
    update batch names a key twice, the one with the highest ``version`` (or the
    last in ``seq`` order if given) wins.
    """
    upd = updates
    if "version" in upd.columns:
        upd = compact_versions(upd)
    upd = upd.select(*KEY, *[F.col(c).alias(f"_u_{c}") for c in DATA_COLUMNS], F.lit(True).alias("_hit"))
    joined = base.join(upd, KEY, "left")
    out = joined.select(
        *KEY,
        *[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) for c in DATA_COLUMNS],
        *[c for c in base.columns if c not in KEY + DATA_COLUMNS],
    )
    return out


def update_last(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace all fields of the newest session of each stream named in ``updates``.

    ``updates``: (stream_key, start, end, is_active, app_id, workspace), one per
    stream. The target key is ``max(session_seq)`` of that stream (A6); streams
    without sessions change nothing.
    """
    from sessionlake.operators.query import max_key

    keyed = updates.join(max_key(base), "stream_key", "inner").withColumnRenamed(
        "max_session_seq", "session_seq"
    )
    return update_by_key(base, keyed.select(*KEY, *DATA_COLUMNS))


def _rewrite_days(spark: SparkSession, path: str, update) -> None:
    """Replace the rows of the days that ``update`` (stored rows -> changed keys, new rows of given rows) touches.

    The new rows are written to the shared folder first, then each touched day is overwritten from
    there; days that no row is left in are removed. Other days' files stay as they are.
    """
    base = read_sessions(spark, path)
    keys, change = update(base)
    keys = keys.select(*KEY).distinct()
    old_days = base.join(keys, KEY, "left_semi").select("day").distinct()
    cols = [f.name for f in schema.SESSIONS.fields]
    moved = with_day(change(base.join(keys, KEY, "left_semi")).select(*cols))
    days = old_days.unionByName(moved.select("day").distinct()).distinct()
    kept = base.join(days, "day", "left_semi").join(keys, KEY, "left_anti").select(*cols, "day")
    scratch = storage_root(spark, "rewritten-days")
    moved.select(*cols, "day").unionByName(kept).repartition("day").write.parquet(scratch)
    gone = [r.day for r in old_days.collect()]  # a number for each touched day
    new = spark.read.parquet(scratch)
    left = {r.day for r in new.select("day").distinct().collect()}
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for day in gone:
        if day not in left:
            fs, jpath = _fs(spark, f"{path.rstrip('/')}/day={day}")
            fs.delete(jpath, True)


def store_update_by_key(spark: SparkSession, path: str, updates: DataFrame) -> None:
    """S5 on a stored table: replace the rows named by ``(stream_key, session_seq)``; unknown keys change nothing."""
    _rewrite_days(spark, path, lambda base: (updates, lambda rows: update_by_key(rows, updates)))


def store_update_last(spark: SparkSession, path: str, updates: DataFrame) -> None:
    """S4 on a stored table: replace the newest session of each stream named in ``updates``."""

    def update(base: DataFrame):
        from sessionlake.operators.query import max_key

        keyed = updates.join(max_key(base), "stream_key").withColumnRenamed("max_session_seq", "session_seq")
        return keyed, lambda rows: update_by_key(rows, keyed.select(*KEY, *DATA_COLUMNS))

    _rewrite_days(spark, path, update)


def upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert new keys and replace existing ones, newest ``version`` wins.

    ``base`` rows count as version -1 unless they carry their own version.
    """
    b = base if "version" in base.columns else base.withColumn("version", F.lit(-1).cast("long"))
    cols = KEY + DATA_COLUMNS + ["version"]
    return compact_versions(b.select(*cols).unionByName(changes.select(*cols)))
