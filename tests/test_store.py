"""Session table: create/append/read, update by key, update last, versioned upserts."""

from pyspark.sql import types as T

from helpers import sessions_df
from sessionlake.sources import store


def test_create_is_idempotent_and_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.create_sessions(spark, path) is True
    assert store.create_sessions(spark, path) is False
    s = sessions_df(spark, [(10, 15, "firefox", 1), (20, 35, None, None)])
    store.append_sessions(s, path)
    back = sorted(tuple(r) for r in store.read_sessions(spark, path).drop("day").collect())
    assert back == sorted(tuple(r) for r in s.collect())


def test_update_by_key(spark):
    base = sessions_df(spark, [(10, 15, "a", 1), (20, 35, "b", 2)])
    upd = spark.createDataFrame(
        [(1, 1, 11, 16, True, "c", None), (1, 99, 0, 1, False, None, None)], base.schema
    )
    got = sorted((r.session_seq, r.start, r.end, r.app_id, r.workspace) for r in store.update_by_key(base, upd).collect())
    assert got == [(1, 11, 16, "c", None), (2, 20, 35, "b", 2)]


def test_update_last(spark):
    base = sessions_df(spark, [(10, 15, "a", 1), (20, 35, "b", 2)])
    upd = spark.createDataFrame([(1, 20, 40, True, "b", 2)], "stream_key long, start long, end long, is_active boolean, app_id string, workspace int")
    got = sorted((r.session_seq, r.end) for r in store.update_last(base, upd).collect())
    assert got == [(1, 15), (2, 40)]


def test_upsert_newest_version_wins(spark):
    base = sessions_df(spark, [(10, 15, "a", 1)])
    changes = spark.createDataFrame(
        [(1, 1, 10, 20, True, "a", 1, 1), (1, 1, 10, 30, True, "a", 1, 2), (1, 2, 30, 40, False, None, None, 1)],
        T.StructType(base.schema.fields + [T.StructField("version", T.LongType())]),
    )
    got = sorted((r.session_seq, r.end) for r in store.upsert(base, changes).collect())
    assert got == [(1, 30), (2, 40)]


def test_updates_of_a_stored_table(spark, tmp_path):
    """S4 and S5 change the table on disk, day by day; other days' files stay."""
    import os

    from sessionlake.sources import store as ST

    path = str(tmp_path / "sessions")
    cols = "stream_key long, session_seq int, start long, end long, is_active boolean, app_id string, workspace int"
    rows = [(k, i, (i - 1) * 86400 + k, (i - 1) * 86400 + k + 50, True, "a", None) for k in (1, 2) for i in (1, 2, 3)]
    ST.create_sessions(spark, path)
    ST.append_sessions(spark.createDataFrame(rows, cols).repartition(4), path)
    files = lambda day: sorted(f for f in os.listdir(f"{path}/day={day}") if f.endswith(".parquet"))
    assert [len(files(d)) for d in (0, 1, 2)] == [1, 1, 1]
    untouched = files(0)
    upd = spark.createDataFrame([(1, 2, 90_000, 90_500, True, "b", 3), (9, 9, 0, 1, True, "x", None)], cols)
    ST.store_update_by_key(spark, path, upd)
    last = spark.createDataFrame([(2, 500_000, 500_100, False, None, None), (7, 1, 2, False, None, None)], "stream_key long, start long, end long, is_active boolean, app_id string, workspace int")
    ST.store_update_last(spark, path, last)
    want = {(r[0], r[1]): r for r in rows}
    want[1, 2] = (1, 2, 90_000, 90_500, True, "b", 3)
    want[2, 3] = (2, 3, 500_000, 500_100, False, None, None)
    got = ST.read_sessions(spark, path).select(*[c.split()[0] for c in cols.split(", ")]).collect()
    assert sorted(map(tuple, got)) == sorted(want.values()) and files(0) == untouched
    ST.store_update_last(spark, path, last.selectExpr("1L AS stream_key", "start", "end", "is_active", "app_id", "workspace").limit(1))
    assert not os.path.isdir(f"{path}/day=2") or files(2) == []
