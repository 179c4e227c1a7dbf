"""Places and times of lines in batches, byte ranges and streams; a log becomes sessions."""

import random

from sessionlake.config import MAX_MESSAGE_SIZE, SessionConfig
from sessionlake.operators.sessionize import sessionize
from sessionlake.sources import envelopes as EN
from sessionlake.sources import message_log as ML
from sessionlake.streaming import stream as SX

CFG = SessionConfig(15, 0, ())


def append(root, key, source, name, data):
    folder = root / f"stream_key={key}" / f"source={source}"
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "ab") as f:
        f.write(data)


def line(second, message):
    return f"{second * 1_000_000 + 5}\t{message}\n".encode()


def focus(app):
    return f'{{"Event":{{"ActiveWindowChanged":"{app}"}}}}'


def test_lines_have_their_place_and_time(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for key, source in [(7, "a"), (7, "b"), (-1, "a b")]:
        at = 0
        for name in ("0001.log", "0002.log", "0010.log"):
            for _ in range(rng.randint(0, 20)):
                text = "x" * rng.randint(0, 30) + rng.choice(["", "é", "\t", "\r"])
                raw = line(at, text)
                append(tmp_path, key, source, name, raw)
                want.append((key, source, at, at * 1_000_000 + 5, text.rstrip("\r")))
                at += len(raw)
    got = ML.read_message_lines(spark, str(tmp_path)).selectExpr("stream_key", "source", "seq", "unix_micros(ts)", "line").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    for step in (1, 7, 64):  # a line is read by the task in whose bytes it begins
        reader = ML.LogReader({"path": str(tmp_path), "rangeBytes": step})
        batches = [b for part in reader.partitions() for b in reader.read(part)]
        assert sorted((r["stream_key"], r["source"], r["seq"], r["line"]) for b in batches for r in b.to_pylist()) == sorted((k, s, q, x) for k, s, q, _, x in want)


def test_odd_lines(spark, tmp_path):
    big = '"' + "x" * (3 * MAX_MESSAGE_SIZE) + '"'
    append(tmp_path, 1, "a", "0.log", line(1, '"Ping"') + line(2, big) + b'"Ping"\n' + b'soon\t"Ping"\n\n' + line(3, '"Ping"') + line(4, '"Ping"')[:-1])
    rows = ML.read_message_lines(spark, str(tmp_path), range_bytes=100_000)
    good, bad = EN.split_quarantine(EN.parse_envelopes(rows))
    assert sorted(r.ts.second for r in good.collect()) == [1, 3]  # the last line's end hasn't arrived
    assert sorted(r.reject for r in bad.collect()) == ["malformed json"] * 3 + ["message too large"]
    assert max(len(r.line or "") for r in rows.collect()) <= ML.KEPT


def test_no_log_yet(spark, tmp_path):
    assert ML.read_message_lines(spark, str(tmp_path / "nothing")).collect() == []


def events(stream):
    good, _ = EN.split_quarantine(EN.parse_envelopes(stream))
    return EN.to_session_events(good)


def test_a_growing_log_becomes_sessions(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        lines = ML.read_message_lines(spark, str(root), streaming=True)
        SX.run_to_completion(spark, SX.sessionize_stream(events(lines), CFG, horizon=900, watermark_delay="100 seconds", bucket_seconds=60), out, checkpoint)

    half = line(250, focus("b"))
    append(root, 1, "a", "0.log", line(10, focus("a")) + line(100, '{"Event":{"Idle":true}}') + half[:9])
    append(root, 2, "a", "0.log", line(20, focus("c")))
    run()
    append(root, 1, "a", "0.log", half[9:])
    append(root, 1, "b", "0.log", line(240, '{"Event":{"WorkspaceChanged":3}}'))
    run()
    append(root, 1, "a", "1.log", line(400, focus("a")))
    append(root, 3, "late", "0.log", line(10_000, '"Ping"') + line(10_000, focus("z")))
    run()
    append(root, 3, "late", "1.log", line(10_001, focus("y")))
    run()  # what the watermark of the run before has closed comes with the next data
    got = sorted(map(tuple, SX.read_compacted(spark, out).collect()))
    want = sessionize(events(ML.read_message_lines(spark, str(root))).filter("stream_key < 3"), CFG, 900)
    assert got == sorted(map(tuple, want.collect())) and len({r[0] for r in got}) == 2


def envelope_rows(spark, users):
    data = [(u, f"u{u} \t%{b}", 10 * u + b, i * 60, text) for u in range(users) for b in range(2) for i, text in enumerate(['"Ping"', focus("a"), "x\ty"])]
    df = spark.createDataFrame(data, "stream_key long, source string, seq long, s long, line string")
    return data, df.selectExpr("stream_key", "source", "seq", "timestamp_seconds(s) as ts", "line")


def test_many_producers_share_few_files(spark, tmp_path):
    data, df = envelope_rows(spark, 40)
    ML.write_message_lines(df, str(tmp_path))
    assert len(list(tmp_path.rglob("*.txt"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ML.read_message_lines(spark, str(tmp_path)).selectExpr("stream_key", "source", "seq", "unix_seconds(ts) s", "line").collect()
    assert sorted((r.stream_key, r.source, r.s, r.line) for r in rows) == sorted((k, x, s, text) for k, x, _, s, text in data)
    places = sorted((r.stream_key, r.source, r.seq, r.s) for r in rows)
    assert [p[3] for p in places] == [0, 60, 120] * 80 and len({r.seq for r in rows}) == len(rows)
    for step in (1, 50, 1 << 20):
        reader = ML.LogReader({"path": str(tmp_path), "rangeBytes": step})
        got = [r["seq"] for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
        assert sorted(got) == sorted(r.seq for r in rows)


def test_small_files_are_read_together_and_collectors_lines_may_be_bad(spark, tmp_path):
    for k in range(100):
        append(tmp_path, k, "a", "0.log", line(1, '"Ping"'))
    assert len(ML.LogReader({"path": str(tmp_path)}).partitions()) == 1
    (tmp_path / "collector=c").mkdir()
    big = b'"' + b"x" * (3 * MAX_MESSAGE_SIZE) + b'"'
    (tmp_path / "collector=c" / "0.log").write_bytes(b"5\tb\t7\t\"Ping\"\n\t\t7\t\"Ping\"\nx\n\n5\tb\tsoon\t1\n5\tb\t8\t" + big + b"\n5\tb\t9\tnot yet")
    rows = ML.read_message_lines(spark, str(tmp_path))
    got = [tuple(r) for r in rows.filter("source is null or source = 'b'").selectExpr("stream_key", "source", "unix_micros(ts)", "left(line, 6)").orderBy("seq").collect()]
    assert got == [(5, "b", 7, '"Ping"'), (None, None, 7, '"Ping"'), (None, None, None, None), (None, None, None, None), (5, "b", None, None), (5, "b", 8, '"xxxxx')]
    assert max(len(r.line or "") for r in rows.collect()) <= ML.KEPT
    offsets = ML.LogStream({"path": str(tmp_path)})
    assert offsets.latestOffset()["collector/c"] == (tmp_path / "collector=c" / "0.log").stat().st_size - len(b"5\tb\t9\tnot yet")
    assert sum(b.num_rows for part in offsets.partitions({}, offsets.latestOffset()) for b in offsets.read(part)) == 106
