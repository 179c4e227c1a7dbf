"""The reference's analytics and database tests (FIXTURES.md section 2) on Spark."""

from pyspark.sql import functions as F

from helpers import sessions_df
from sessionlake.operators import analytics as A
from sessionlake.operators import query as Q


def one(df, col):
    return df.collect()[0][col]


def test_total_screen_time(spark):
    s = sessions_df(spark, [(1, 13, "tg", None), (13, 25, "firefox", None), (25, 37, None, None), (37, 49, "tg", None)])
    assert one(A.total_screen_time(s), "total_screen_time") == 36


def test_total_screen_time_empty_is_zero(spark):
    s = sessions_df(spark, [(1, 13, "tg", None)]).filter("false")
    assert one(A.total_screen_time(s, by=()), "total_screen_time") == 0


def test_screen_time_app(spark):
    s = sessions_df(
        spark,
        [(1, 17, "Loupe", None), (17, 31, "firefox", None), (31, 51, "tg", None), (51, 55, "Loupe", None),
         (55, 61, "alacritty", None)],
    )
    assert one(A.screen_time_app(s, "Loupe"), "screen_time_app") == 20
    assert one(A.screen_time_app(s, "absent"), "screen_time_app") == 0


def test_idle_time(spark):
    s = sessions_df(spark, [(1, 41, "kitty", None), (41, 57, "firefox", None), (57, 81, None, None), (81, 119, "kitty", None)])
    assert one(A.idle_time(s), "idle_time") == 24


def test_time_for_each_state(spark):
    s = sessions_df(spark, [(1, 29, "kitty", None), (29, 45, "tg", None), (45, 67, "kitty", None), (67, 99, "firefox", None)])
    got = {r.app_id: r.total_time for r in A.time_for_each_state(s).collect()}
    assert got == {"kitty": 50, "firefox": 32, "tg": 16}


def test_group_sessions(spark):
    s = sessions_df(spark, [(0, 10, "firefox", 1), (10, 20, "code", 2), (20, 30, "steam", 3), (30, 40, None, None)])
    rules = spark.createDataFrame(
        [(1, "dev", ["code"], [2]), (2, "browser", ["firefox"], [])],
        "priority int, group_id string, app_ids array<string>, workspaces array<int>",
    )
    got = {r.group_id: r.sessions for r in A.group_totals(A.assign_group(s, rules), by=("group_id",)).collect()}
    assert got == {"dev": 1, "browser": 1, None: 2}
    lit = A.assign_group_literal(s, [("dev", ["code"], [2]), ("browser", ["firefox"], [])])
    assert sorted((r.session_seq, r.group_id) for r in lit.collect()) == [(1, "browser"), (2, "dev"), (3, None), (4, None)]


def _db(spark):
    return sessions_df(spark, [(10, 15, "firefox", 1), (20, 35, "chromium", 2), (30, 32, "steam", 3)])


def names(df):
    return [r.app_id for r in df.collect()]


def test_filter_range_is_containment(spark):
    assert names(Q.filter_range(_db(spark), 15, 33)) == ["steam"]


def test_order_by_duration(spark):
    assert names(Q.limit_offset(_db(spark), sort_by_duration="asc")) == ["steam", "firefox", "chromium"]
    assert names(Q.limit_offset(_db(spark), sort_by_duration="desc")) == ["chromium", "firefox", "steam"]


def test_start_desc_limit_offset(spark):
    assert names(Q.limit_offset(_db(spark), limit=2, offset=1, sort_by_start="desc")) == ["chromium", "firefox"]
    per = Q.limit_offset(_db(spark), limit=2, offset=1, sort_by_start="desc", per_stream=True).orderBy("position")
    assert names(per) == ["chromium", "firefox"]


def test_negative_limit_means_all(spark):
    assert len(names(Q.limit_offset(_db(spark), limit=-1))) == 3


def test_query_last(spark):
    assert names(Q.query_last(_db(spark), 2)) == ["steam", "chromium"]
    assert sorted(names(Q.query_last(_db(spark), 2, per_stream=True))) == ["chromium", "steam"]


def test_last_per_stream_and_max_key(spark):
    assert one(Q.max_key(_db(spark)), "max_session_seq") == 3
    assert one(Q.last_per_stream(_db(spark)), "app_id") == "steam"


def test_range_filter_pushes_to_parquet(spark, tmp_path):
    from sessionlake.sources import store

    path = str(tmp_path / "sessions")
    store.create_sessions(spark, path)
    store.append_sessions(_db(spark), path)
    df = Q.filter_range(store.read_sessions(spark, path), 15, 33)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(start,15)" in plan
    assert "PartitionFilters" in plan and "day" in plan
    assert names(df) == ["steam"]


def test_every_check_rule_fires(spark):
    from sessionlake.operators.audit import split_checked

    cols = "stream_key long, start long, end long, is_active boolean, app_id string, workspace int"
    rows = [
        (0, 1, 2, True, "a", 1),
        (1, None, 2, True, "a", 1),
        (2, 1, None, True, "a", 1),
        (3, 1, 2, None, "a", 1),
        (4, 3, 2, True, "a", 1),
        (5, 1, 2, True, None, 1),
        (6, 1, 2, False, "a", None),
        (7, 1, 2, False, None, 1),
    ]
    good, bad = split_checked(spark.createDataFrame(rows, cols))
    assert [r.stream_key for r in good.collect()] == [0]
    want = ["start is null", "end is null", "is_active is null", "end before start", "active without app_id", "idle with app_id", "idle with workspace"]
    assert [r.violation for r in bad.orderBy("stream_key").collect()] == want
