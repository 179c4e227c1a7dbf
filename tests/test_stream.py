"""Every key is a user's, runs don't mix, a restart goes on."""

import pathlib
import random
import shutil
import types

import pandas as pd
import pytest

from sessionlake.config import SessionConfig
from sessionlake.operators.sessionize import sessionize
from sessionlake.streaming import stream as SX
from sessionlake.streaming.machine import SessionMachine

SCHEMA = "stream_key long, seq long, ts_us long, t long, kind string, app_id string, workspace int"
CFG = SessionConfig(15, 0, ())


def rows(key, at=0):
    script = [(0, "focus", "a"), (40, "idle_on", None), (90, "idle_off", None), (200, "focus", "b")]
    base = 1_000_000 + at
    return [(key, i + at, (t + base) * 1_000_000, t + base, kind, app, None) for i, (t, kind, app) in enumerate(script)]


def land(spark, path, data, horizon):
    beat = (None, 0, (horizon + 200_000) * 1_000_000, horizon + 200_000, SX.HEARTBEAT, None, None)
    if data:
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    if horizon:
        spark.createDataFrame([beat], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, checkpoint, horizon, **given):
    events = spark.readStream.schema(SCHEMA).parquet(path)
    SX.run_to_completion(spark, SX.sessionize_stream(events, CFG, horizon=horizon, **given), out, checkpoint)
    return sorted(tuple(r) for r in SX.read_compacted(spark, out).collect())


def test_every_key_comes_through_and_runs_stay_apart(spark, tmp_path):
    d = str(tmp_path)
    data = rows(-1) + rows(7)
    land(spark, f"{d}/in", data, 1_000_300)
    got = run(spark, f"{d}/in", f"{d}/out", f"{d}/cp", 1_000_300)
    want = sorted(tuple(r) for r in sessionize(spark.createDataFrame(data, SCHEMA), CFG, 1_000_300).collect())
    assert got == want and {r[0] for r in got} == {-1, 7}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with pytest.raises(ValueError):
        run(spark, f"{d}/in", f"{d}/out", f"{d}/other", 1_000_300)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert sorted(tuple(r) for r in SX.read_compacted(spark, f"{d}/out").collect()) == want


def test_a_new_checkpoint_at_an_old_path_is_refused(spark, tmp_path):
    d = str(tmp_path)
    land(spark, f"{d}/in", rows(1), 1_000_300)
    want = run(spark, f"{d}/in", f"{d}/out", f"{d}/cp", 1_000_300)
    assert want and SX.run_id(spark, f"{d}/cp")
    shutil.rmtree(f"{d}/cp")
    with pytest.raises(ValueError):
        run(spark, f"{d}/in", f"{d}/out", f"{d}/cp", 1_000_300)
    assert sorted(tuple(r) for r in SX.read_compacted(spark, f"{d}/out").collect()) == want


def test_folders_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SX, "FAN", 3)
    d, data, given = str(tmp_path), [], {"watermark_delay": "10 seconds", "bucket_seconds": 60}
    for k in range(6):
        data += rows(k % 3, 300 * k)
        land(spark, f"{d}/in", rows(k % 3, 300 * k), 0)
        run(spark, f"{d}/in", f"{d}/out", f"{d}/cp", 1_003_000, **given)
    land(spark, f"{d}/in", [], 1_003_000)
    got = run(spark, f"{d}/in", f"{d}/out", f"{d}/cp", 1_003_000, **given)
    assert got == sorted(tuple(r) for r in sessionize(spark.createDataFrame(data, SCHEMA), CFG, 1_003_000).collect())
    folders = [p.name for p in pathlib.Path(f"{d}/out").glob("run_id=*/level=*/batch_id=*")]
    assert len(folders) <= 6 and any(pathlib.Path(f"{d}/out").glob("run_id=*/level=2"))


class Handle:
    """State and timers of one key, kept here; what a test asks of them is counted."""

    def __init__(self):
        self.value, self.map, self.timers, self.written = None, {}, set(), 0

    def getValueState(self, *_):
        return types.SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def getMapState(self, *_):
        def put(k, v):
            self.written += len(v[0])
            self.map[k] = v

        return types.SimpleNamespace(getValue=self.map.get, updateValue=put, removeKey=self.map.pop)

    registerTimer = lambda self, ms: self.timers.add(ms)
    deleteTimer = lambda self, ms: self.timers.remove(ms)


def drive(handle, cfg, batches, horizon, bucket=60):
    """Feed (rows, watermark after them) one after the other; the changes and the number of wake-ups."""
    p = SX.SessionProcessor(cfg, horizon, bucket)
    p.init(handle)
    now, out, wakes = [0], {}, 0
    values = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: now[0])
    for new, watermark in batches:
        if new:
            frame = pd.DataFrame(new, columns=["ts_us", "seq", "kind", "app_id", "workspace"])
            assert not list(p.handleInputRows((1,), iter([frame]), values))
        now[0] = watermark * 1000
        while due := sorted(t for t in handle.timers if t <= now[0]):
            handle.timers.remove(due[0])
            wakes += 1
            for df in p.handleExpiredTimer((1,), values, None):
                out |= {r.session_seq: (r.start, r.end, r.app_id) for r in df.itertuples()}
    return out, wakes


@pytest.mark.parametrize("seed", range(20))
def test_any_batching_gives_the_machines_sessions(seed):
    rng = random.Random(seed)
    cfg = SessionConfig(15, rng.choice([0, 20]), ())
    events = sorted((rng.randrange(3000) * 1_000_000 + rng.randrange(10**6), i, rng.choice(["focus", "focus", "idle_on", "idle_off", "workspace"])) for i in range(60))
    events = [(ts, i, kind, rng.choice(["a", "b"]) if kind == "focus" else None, 1 if kind == "workspace" else None) for ts, i, kind in events]
    machine = SessionMachine(15, cfg.min_session_duration)
    for ts, _, kind, app, ws in events:
        machine.event_with_ticks(kind, ts // 1_000_000, app, ws)
    machine.ticks_through(3600)
    want = {n: (start, end, st[1]) for n, start, end, st in machine.take_all()}
    batches, at = [], 0
    while at < len(events):  # rows come at most 200 s out of order, the watermark stays behind them
        n = rng.randint(1, 12)
        part, at = events[at : at + n], at + n
        rng.shuffle(part)
        batches.append((part, min(events[at][0] // 1_000_000 if at < len(events) else 3000, part[-1][0] // 1_000_000)))
    low = [min([w, *(r[0] // 1_000_000 for later, _ in batches[k + 1 :] for r in later)]) for k, (_, w) in enumerate(batches)]
    got, _ = drive(Handle(), cfg, [(rows, w) for (rows, _), w in zip(batches, low, strict=True)] + [([], 10_000)], 3600)
    assert got == want


def test_no_wake_up_without_a_due_flush_and_no_buffer_rewritten():
    handle = Handle()
    batches = [([(k * 100 * 1_000_000, k, "workspace", None, 1)], 0) for k in range(100)]
    assert drive(handle, CFG, batches, None) == ({}, 0)
    assert handle.written == 100  # each row lies in a bucket of its own and is written once
    assert drive(handle, CFG, [([], 100_000)], None) == ({}, 100) and not handle.timers  # nothing is open: no timer is left
    handle = Handle()
    cfg = SessionConfig(15, 1000, ())
    out, wakes = drive(handle, cfg, [([(0, 0, "focus", "a", None)], 0), ([], 60), *(([], t) for t in range(70, 1000, 10))], None)
    assert out == {} and wakes == 1 and len(handle.timers) == 1  # flushes that save nothing have no timer
    out, wakes = drive(handle, cfg, [([], 1100)], None)
    assert out and wakes >= 1


def test_restart_from_the_checkpoint(spark, tmp_path):
    d = str(tmp_path)
    first, second = rows(3), rows(3, 1000)
    land(spark, f"{d}/in", first, 0)
    events = spark.readStream.schema(SCHEMA).parquet(f"{d}/in")
    SX.run_to_completion(spark, SX.sessionize_stream(events, CFG, horizon=1_001_500), f"{d}/out", f"{d}/cp")
    land(spark, f"{d}/in", second, 1_001_500)
    got = run(spark, f"{d}/in", f"{d}/out", f"{d}/cp", 1_001_500)
    assert got == sorted(tuple(r) for r in sessionize(spark.createDataFrame(first + second, SCHEMA), CFG, 1_001_500).collect())


def test_an_arrival_is_one_entry_and_a_watermark_one_replay(monkeypatch):
    handle = Handle()
    batch = [(k * 100 * 1_000_000, k, "workspace", None, 1) for k in range(60)]  # each row in a bucket of its own
    loads, load = [], SX.SessionProcessor._load
    monkeypatch.setattr(SX.SessionProcessor, "_load", lambda self: loads.append(1) or load(self))
    assert drive(handle, CFG, [(batch, 0)], None) == ({}, 0)
    assert handle.written == 60 and len(handle.map) == len(handle.timers) == 1
    drive(handle, CFG, [([], 3000)], None)  # half of the entry is complete, the rest waits under its first bucket
    assert handle.written == 90 and len(handle.map) == len(handle.timers) == 1
    handle, loads[:] = Handle(), []
    assert drive(handle, CFG, [([row], 0) for row in batch] + [([], 100_000)], None) == ({}, 60)
    assert len(loads) == 61  # a row's arrival reads the state, and the first timer of a watermark


def test_the_streams_input_has_a_file_per_producer_and_slice(spark, tmp_path):
    from sessionlake.plans import catalog

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(16).write.parquet(f"{tmp_path}/events.parquet")
    catalog._write_stream_input(spark, str(tmp_path), f"{tmp_path}/input")
    folders = list(pathlib.Path(f"{tmp_path}/input").glob("producer=*/slice=*"))
    assert len(folders) > 4 and all(len(list(d.glob("*.parquet"))) == 1 for d in folders)


@pytest.mark.parametrize("seed", range(20))
def test_streams_of_a_group_get_their_machines_sessions(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(SX, "RUN_ROWS", 4)
        monkeypatch.setattr(SX, "ENTRY_ROWS", 10)
    cfg, users = SessionConfig(rng.choice([7, 15, 59]), rng.choice([0, 20]), ()), ["", "-1", "7", str(2**60 + 1), "11"]
    kinds = ["focus", "focus", "idle_on", "idle_off", "workspace"]
    events = sorted((rng.randrange(3000) * 1_000_000 + rng.randrange(10**6), i, rng.choice(kinds), rng.choice(users)) for i in range(240))
    events = [(ts, i, kind, rng.choice(["a", "b"]) if kind == "focus" else None, 1 if kind == "workspace" else None, user) for ts, i, kind, user in events]
    want = {}
    for user in users:
        machine = SessionMachine(cfg.flush_interval, cfg.min_session_duration)
        for ts, _, kind, app, ws, _ in (e for e in events if e[-1] == user):
            machine.event_with_ticks(kind, ts // 1_000_000, app, ws)
        machine.ticks_through(3600)
        want |= {(user, n): (start, end, st[1]) for n, start, end, st in machine.take_all()}
    batches, at = [], 0
    while at < len(events):
        n = rng.randint(1, 40)
        part, at = events[at : at + n], at + n
        rng.shuffle(part)
        batches.append((part, min(r[0] for r in events[at:] or [(3000 * 10**6,)]) // 1_000_000))
    handle = Handle()
    got = drive_group(handle, cfg, [*batches, ([], 3000), ([], 10_000)], 3600)
    assert got == want and not handle.map and not handle.timers


def drive_group(handle, cfg, batches, horizon, bucket=60):
    p = SX.SessionProcessor(cfg, horizon, bucket)
    p.init(handle)
    now, out = [0], {}
    values = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: now[0])
    for new, watermark in batches:
        if new:
            assert not list(p.handleInputRows((1,), iter([pd.DataFrame(new, columns=["ts_us", "seq", "kind", "app_id", "workspace", "stream_key"])]), values))
            assert max(len(v[0]) for v in handle.map.values()) <= max(SX.ENTRY_ROWS, SX.RUN_ROWS)
        now[0] = watermark * 1000
        while due := sorted(t for t in handle.timers if t <= now[0]):
            handle.timers.remove(due[0])
            for df in p.handleExpiredTimer((1,), values, None):
                out |= {("" if pd.isna(r.stream_key) else str(r.stream_key), r.session_seq): (r.start, r.end, r.app_id) for r in df.itertuples()}
    return out


def test_state_calls_do_not_grow_with_the_streams():
    def calls(users):
        handle, made = Handle(), []
        for name in ("getValueState", "getMapState"):
            state = getattr(handle, name)()
            counted = {k: (lambda *a, f=f: made.append(1) or f(*a)) for k, f in vars(state).items()}
            setattr(handle, name, lambda *_, c=counted: types.SimpleNamespace(**c))
        handle.registerTimer = lambda ms: made.append(1) or handle.timers.add(ms)
        batch = [(k * 10_000_000, k, "focus", "ab"[k % 2], None, str(u)) for k in range(6) for u in range(users)]
        out = drive_group(handle, SessionConfig(15, 0, ()), [(batch, 0), ([], 60), ([], 10_000)], 3600)
        assert {name for name, _ in out} == {str(u) for u in range(users)}
        return len(made)

    assert calls(500) <= calls(5) + 5


def test_a_flush_at_the_end_of_a_bucket_leaves_its_timer():
    handle, cfg = Handle(), SessionConfig(119, 0, ())
    batches = [([(0, 0, "focus", "a", None)], 60), ([(100_000_000, 1, "focus", "b", None)], 60), ([], 10_000)]
    out, _ = drive(handle, cfg, batches, 3600)
    assert not handle.map and out == {1: (100, 3570, "b")}  # the row of second 100 is applied before the flush at 119


def test_streams_share_groups_and_a_null_key_is_one(spark, tmp_path):
    d, data = str(tmp_path), [r for key in (None, -1, 2**60 + 1, *range(40)) for r in rows(key)]
    land(spark, f"{d}/in", data, 1_000_300)
    events = spark.readStream.schema(SCHEMA).parquet(f"{d}/in")
    SX.run_to_completion(spark, SX.sessionize_stream(events, CFG, horizon=1_000_300, groups=3), f"{d}/out", f"{d}/cp")
    got = {tuple(r) for r in SX.read_compacted(spark, f"{d}/out").collect()}
    assert got == {tuple(r) for r in sessionize(spark.createDataFrame(data, SCHEMA), CFG, 1_000_300).collect()}
    assert {r[0] for r in got} == {None, -1, 2**60 + 1, *range(40)}
