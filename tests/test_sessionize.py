"""X1 (window closed form) against the event-by-event machine; X2 on the golden scripts; plan shape."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import EVENT_SCHEMA, event_rows, parse_script
from sessionlake.config import SessionConfig
from sessionlake.operators.sessionize import sessionize
from sessionlake.streaming.logged import due_ticks, response_log_logged, sessionize_logged
from sessionlake.streaming.machine import SessionMachine

APPS = ["a", "b", "c", "hid"]


def random_script(rng: random.Random, n: int):
    rows, t = [], rng.randint(0, 40)
    for _ in range(n):
        t += rng.choice([0, 0, 1, 2, 3, 5, 8, 13, 21, 40])
        r = rng.random()
        if r < 0.45:
            rows.append(("focus", t, rng.choice(APPS + [None]), None))
        elif r < 0.6:
            rows.append(("workspace", t, None, rng.randint(0, 3)))
        elif r < 0.8:
            rows.append(("idle_on", t, None, None))
        else:
            rows.append(("idle_off", t, None, None))
    return rows


def machine_sessions(rows, interval, min_dur, hidden, horizon):
    m = SessionMachine(interval, min_dur, hidden)
    for kind, t, app, ws in rows:
        m.event_with_ticks(kind, t, app, ws)
    m.ticks_through(horizon)
    return [(start, end, st) for _seq, start, end, st in m.take_all()]


@pytest.mark.parametrize("interval,min_dur", [(1, 0), (5, 5), (15, 10), (7, 0)])
def test_closed_form_equals_state_machine(spark, interval, min_dur):
    rng = random.Random(interval * 100 + min_dur)
    hidden = ("hid",)
    horizon = 2000
    data, expected = [], {}
    for key in range(120):
        rows = random_script(rng, rng.randint(1, 40))
        data += event_rows(rows, key)
        expected[key] = machine_sessions(rows, interval, min_dur, hidden, horizon)
    df = spark.createDataFrame(data, EVENT_SCHEMA)
    out = sessionize(df, SessionConfig(interval, min_dur, hidden), horizon).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.stream_key, r.session_seq)):
        got.setdefault(r.stream_key, []).append((r.start, r.end, (r.is_active, r.app_id, r.workspace)))
    for key in range(120):
        assert got.get(key, []) == expected[key], key


GOLDEN_LOGGED = [
    ("@1 F(firefox) @11 T ! F(kitty) @21 T ! F(alacritty) @31 T !", 15, 0, ()),
    ("@1 F(Terraria) @6 T ! I+ @11 T ! I- @16 T !", 15, 0, ()),
    ("@1 F(tg) T @16 T ! @31 T ! @46 T !", 15, 0, ()),
    ("@1 F(steam) @6 T ! F(kitty) @7 T F(steam) @12 T !", 15, 0, ()),
    ("@1 F(X) @999999 T !", 15, 5, ("X",)),
    ("@1 F(firefox) @21 T ! F(zen) @26 T !", 15, 10, ()),
]


def test_logged_mode_on_golden_scripts(spark):
    """X2 on Spark equals the machine on every script."""
    from helpers import run_machine

    for script, interval, min_dur, hidden in GOLDEN_LOGGED:
        rows = event_rows(parse_script(script), key=7)
        df = spark.createDataFrame(rows, EVENT_SCHEMA)
        got = [
            (r.start, r.end, (r.is_active, r.app_id, r.workspace))
            for r in sorted(sessionize_logged(df, SessionConfig(interval, min_dur, hidden)).collect(),
                            key=lambda r: r.session_seq)
        ]
        expected, _ = run_machine(script, interval, min_dur, hidden)
        assert got == expected, script


@pytest.mark.parametrize("interval,min_dur", [(15, 0), (7, 12)])
def test_logged_mode_on_random_logs(spark, interval, min_dur):
    """X2 and its replies (S10) equal the machine's, with bursts, equal seconds, gaps and silent streams."""
    rng = random.Random(interval)
    data, sessions, replies = [], {}, {}
    for key in range(40):
        now, machine, rows = rng.choice([0, 1, 10_000]), SessionMachine(interval, min_dur, ("hid",)), []
        for _ in range(rng.randint(1, 120)):
            now += rng.choice([0, 0, 1, 1, 2, 5, 30, 400])
            kind = rng.choice(["tick"] * 6 + ["flush", "focus", "focus", "idle_on", "idle_off", "workspace"])
            rows.append((kind, now, rng.choice(["a", "b", "hid", None]) if kind == "focus" else None, rng.randint(1, 2) if kind == "workspace" else None))
        replies[key] = [machine.event(*r) for r in rows]
        sessions[key] = [(n, start, end, *st) for n, start, end, st in machine.take_all()]
        data += event_rows(rows, key)
    df, config = spark.createDataFrame(data, EVENT_SCHEMA), SessionConfig(interval, min_dur, ("hid",))
    got = {}
    for r in sorted(map(tuple, sessionize_logged(df, config).collect()), key=lambda r: r[:2]):
        got.setdefault(r[0], []).append(r[1:])
    assert {k: v for k, v in sessions.items() if v} == got
    answers = {}
    for r in sorted(response_log_logged(df, config).collect(), key=lambda r: (r.stream_key, r.ts_us, r.seq)):
        answers.setdefault(r.stream_key, []).append(r.response)
    assert answers == replies


def test_due_ticks_are_the_chain(spark):
    rng = random.Random(1)
    data, want = [], set()
    for key in range(6):
        seconds, last = sorted(rng.sample(range(5000), rng.choice([1, 3, 600]))), 0
        data += [(key, t) for t in seconds]
        for t in seconds:
            if t - last >= 10:
                want.add((key, t))
                last = t
    assert set(map(tuple, due_ticks(spark.createDataFrame(data, "stream_key long, t long"), 10).collect())) == want


def test_one_shuffle_one_sort(spark):
    """X1's physical plan: one Exchange on stream_key, one Sort shared by all windows."""
    df = spark.createDataFrame(event_rows(parse_script("@1 F(a) @5 F(b) @9 I+ @12 I-")), EVENT_SCHEMA)
    plan = sessionize(df, SessionConfig(5, 0), 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_hidden_focus_is_ignored(spark):
    rows = event_rows(parse_script("@1 F(a) @10 F(hid) @20 F(b)"))
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    out = sessionize(df, SessionConfig(1, 0, ("hid",)), 30).orderBy("session_seq").collect()
    # the hidden app's time is credited to a, up to the last tick before b
    assert [(r.start, r.end, r.app_id) for r in out] == [(1, 19, "a"), (20, 30, "b")]


@pytest.mark.parametrize("interval,min_dur,rows_per_chunk", [(1, 0, 3), (5, 5, 7), (15, 10, 2)])
def test_hot_stream_plan_equals_plain_plan(spark, interval, min_dur, rows_per_chunk):
    """Streams above the hot threshold go through the chunked prefix scans; same sessions."""
    rng = random.Random(7 + interval + rows_per_chunk)
    data, expected = [], {}
    for key in range(60):
        rows = random_script(rng, rng.randint(1, 60))
        data += event_rows(rows, key)
        expected[key] = machine_sessions(rows, interval, min_dur, ("hid",), 2500)
    df = spark.createDataFrame(data, EVENT_SCHEMA)
    cfg = SessionConfig(interval, min_dur, ("hid",))
    out = sessionize(df, cfg, 2500, hot_key_rows=10, rows_per_chunk=rows_per_chunk).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.stream_key, r.session_seq)):
        got.setdefault(r.stream_key, []).append((r.start, r.end, (r.is_active, r.app_id, r.workspace)))
    for key in range(60):
        assert got.get(key, []) == expected[key], key


def test_hot_stream_intermediates_equal_plain(spark):
    """event_states, segments and run islands agree between the two plans."""
    from sessionlake.operators import sessionize as X

    rng = random.Random(99)
    data = []
    for key in range(30):
        data += event_rows(random_script(rng, rng.randint(5, 80)), key)
    df = spark.createDataFrame(data, EVENT_SCHEMA)
    cfg = SessionConfig(5, 3, ("hid",))

    def rows(frame, cols):
        return sorted(tuple(r) for r in frame.select(*cols).collect())

    st_cols = ["stream_key", "seq", "ws", "before", "after", "old_state"]
    assert rows(X.event_states(df, cfg, hot_key_rows=None), st_cols) == rows(
        X.event_states(df, cfg, hot_key_rows=20, rows_per_chunk=4), st_cols
    )
    seg_cols = ["stream_key", "seq", "start", "end_t", "next_kind", "flush_t", "grid_t1", "kept", "state"]
    plain = X.segments(df, cfg, 3000, hot_key_rows=None)
    hot = X.segments(df, cfg, 3000, hot_key_rows=20, rows_per_chunk=4)
    assert rows(plain, seg_cols) == rows(hot, seg_cols)
    isl = ["stream_key", "seq", "session_seq", "_run_start"]
    assert rows(X.run_islands(X.min_duration(plain)), isl) == rows(X.run_islands(X.min_duration(hot)), isl)


def test_hot_check_reads_key_and_time_only(spark):
    """The hot-stream check runs on every input: its scan must prune to two columns."""
    from conftest import SF_SMALL
    from sessionlake.fixtures import load_session_events
    from sessionlake.operators import skew
    from sessionlake.operators.sessionize import prepare_events

    plan = skew.hot_streams(prepare_events(load_session_events(spark, SF_SMALL)))._jdf.queryExecution()
    scans = [line for line in plan.executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert len(scans) == 1
    assert scans[0].split("ReadSchema: ")[1].strip() == "struct<ts:timestamp_ntz,user_id:bigint>"


def test_chunked_plan_reads_checkpoints_in_place(spark):
    """After the one shuffle on (stream_key, chunk), hot rows are never shuffled or re-sorted:
    checkpoints keep partitioning and order, and the only other exchanges move chunk summaries."""
    import re

    from sessionlake.operators import skew

    rng = random.Random(5)
    data = []
    for key in range(6):
        data += event_rows(random_script(rng, 80), key)
    df = spark.createDataFrame(data, EVENT_SCHEMA)
    cfg = SessionConfig(5, 3, ("hid",))
    cuts = []

    def check(frame):
        cut_df = orig_cut(frame)
        plan = cut_df.groupBy(*skew.KC).count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan, plan
        window = cut_df.withColumn("_x", F.row_number().over(skew._cw()))
        plan = window._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan, plan
        cuts.append(1)
        return cut_df

    orig_cut = skew.cut
    skew.cut = check
    try:
        sessionize(df, cfg, 3000, hot_key_rows=10, rows_per_chunk=15).collect()
    finally:
        skew.cut = orig_cut
    assert len(cuts) == 3
    plan = sessionize(df, cfg, 3000, hot_key_rows=10, rows_per_chunk=15)._jdf.queryExecution().executedPlan()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.toString())
    # exchanges of the final job: the plain streams (stream_key), the per-chunk summaries
    # (stream_key) and the per-session aggregate - none on (stream_key, chunk)
    assert shuffles and not [s for s in shuffles if re.search(r"\bchunk#", s)], shuffles


def test_one_answer_whatever_the_row_count(spark):
    """Without a horizon, and in the columns of segments, the plain and the split plan agree."""
    from sessionlake.config import SessionConfig
    from sessionlake.operators import sessionize as X

    rows = [(1, 0, "focus", 1000, "a", None), (1, 1, "focus", 1500, "b", None), (1, 2, "workspace", 2000, None, 1)]
    rows += [(2, 3, "focus", 100, "a", None), (2, 4, "focus", 900, "purchase_2", None)]
    ev = spark.createDataFrame([(k, q, t * 1_000_000, t, kind, a, w) for k, q, kind, t, a, w in rows], "stream_key long, seq long, ts_us long, t long, kind string, app_id string, workspace int")
    cfg = SessionConfig(15, 0, ("purchase_2",))
    plain, split = (sorted(tuple(r) for r in X.sessionize(ev, cfg, hot_key_rows=n, rows_per_chunk=1).collect()) for n in (None, 1))
    assert plain == split and [r[:4] for r in plain] == [(1, 1, 1000, 1495), (1, 2, 1500, 1990), (2, 1, 100, 895)]
    columns = [X.segments(ev, cfg, None, n, 1).columns for n in (None, 100, 1)]
    assert columns[0] == columns[1] == columns[2] and "chunk" in columns[0]


def test_a_logged_log_is_sorted_once_and_not_written_for_its_ticks(spark, monkeypatch):
    from sessionlake.streaming import logged as LG

    data = [(k, i, t * 1_000_000, t, kind, "a" if kind == "focus" else None, None) for k in range(3) for i, (t, kind) in enumerate([(10, "focus"), (40, "idle_on"), (90, "idle_off")])]
    events = spark.createDataFrame(data, "stream_key long, seq long, ts_us long, t long, kind string, app_id string, workspace int")
    ticks = LG.hourly_ticks(events, 2000, 5)
    assert ticks.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # not as many as the few streams fill
    names, saved = [], LG.saved
    monkeypatch.setattr(LG, "saved", lambda df, name: names.append(name) or saved(df, name))
    assert sessionize_logged(events.unionByName(ticks), SessionConfig(15, 0, ())).count() and names == []
    assert response_log_logged(events.unionByName(ticks), SessionConfig(15, 0, ())).count() and len(names) == 1


def test_ticks_of_a_stream_are_one_chain_over_all_batches(spark):
    data = [(k, t) for k in (None, 1, 2) for t in range(0, 3000, 2)]
    df = spark.createDataFrame(data, "stream_key long, t long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, due_ticks(df, 15).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(k, t) for k in (1, 2) for t in range(16, 3000, 16)]
