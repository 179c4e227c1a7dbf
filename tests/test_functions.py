"""Scalar functions: durations, labels, local time, flexible time parsing."""

import pytest
from pyspark.sql import functions as F

from sessionlake.functions.scalar import human_duration, local_day, local_time, state_label, timeline_label
from sessionlake.functions.timeparse import parse_time_column


@pytest.mark.parametrize(
    "secs,text", [(0, "0s"), (59, "59s"), (3600, "1h"), (3661, "1h1m1s"), (7260, "2h1m"), (-5, ""), (-3600, "")]
)
def test_human_duration(spark, secs, text):
    assert spark.range(1).select(human_duration(F.lit(secs)).alias("d")).first().d == text


def test_labels(spark):
    rows = spark.createDataFrame(
        [(True, "kitty", 2), (True, "kitty", None), (False, None, None)],
        "is_active boolean, app_id string, workspace int",
    ).select(state_label().alias("s"), timeline_label().alias("t")).collect()
    assert [(r.s, r.t) for r in rows] == [("kitty (2)", "kitty, 2"), ("kitty", "kitty"), ("idle", "Idle")]


def test_local_day_and_time(spark):
    r = spark.range(1).select(
        local_day(F.lit(1704412800), 0).alias("d"), local_time(F.lit(1704412800 + 52200), 3600).alias("t")
    ).first()
    assert r.d == "Fri, 05 January 2024"
    assert r.t == "15:30"


CASES = [
    ("1704449400", 1704449400),
    ("  1704449400 ", 1704449400),
    ("2024-01-05T10:10:00Z", 1704449400),
    ("2024-01-05T11:10:00+01:00", 1704449400),
    ("2024-01-05 11:10", 1704449400),
    ("2024-01-05T11:10:00", 1704449400),
    ("2024/01/05+11:10:00", 1704449400),
    ("2024.01.05_11:10 AM", 1704449400),
    ("01-05-2024 11:10:00 PM", 1704492600),
    ("01/05/2024 11:10", 1704449400),
    ("2024-01-05", 1704409200),
    ("01/05/2024", 1704409200),
    ("11:10", 1706695800),
    ("nonsense", None),
    ("2024-13-05", None),
    ("1.5", None),
]


def test_parse_time_column(spark):
    df = spark.createDataFrame([(s,) for s, _ in CASES], "s string")
    got = [r.p for r in df.select(parse_time_column("s", 3600, "2024-01-31").alias("p")).collect()]
    assert got == [e for _, e in CASES]


def test_fractions_of_any_length_and_rejects(spark):
    from sessionlake.functions.timeparse import split_times

    texts = [f"2024-01-05T10:00:00.{'123456789'[:n]}Z" for n in range(1, 10)] + ["2024-01-05T11:00:00.5+01:00", None, "soon"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    good, bad = split_times(df, "text", "sec")
    assert {r.sec for r in good.collect()} == {1704448800, None}
    assert [(r.i, r.reject) for r in bad.collect()] == [(11, "unknown time format")]


def test_a_text_is_parsed_once(spark):
    df = spark.createDataFrame([(s,) for s, _ in CASES], "s string").select(parse_time_column("s", 3600, "2024-01-31").alias("p"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp(") == 1, plan


def test_shapes_at_the_edges(spark):
    texts = ["-2024-01-05", "+12024-01-05", "+2024-01-05", "01-05--2024", "01-05-+12024", "2024-01-05t10:00:00z", "2024-01-05T10:00:00", "2024-01-05 10:00 PM", "2024-01-05 13:00 pm", "1:00", "10:00pm", "99999999999999999999"]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    got = [r.p for r in df.select(parse_time_column("s", 0, "2024-01-31").alias("p")).collect()]
    assert got == [-126038160000, 317273932800, None, -126038160000, 317273932800, 1704448800, 1704448800, 1704492000, None, None, None, None]
