"""Envelope parsing and quarantine (S6-S8) and compositor normalization."""

from sessionlake.sources import compositor as C
from sessionlake.sources import envelopes as EN
from sessionlake.sources.message_log import read_message_lines

LINES = [
    '"Ping"',
    '{"Handshake":{"protocol_version":1,"backend_name":"compositor"}}',
    '{"Event":{"ActiveWindowChanged":"kitty"}}',
    '{"Event":{"ActiveWindowChanged":null}}',
    '{"Event":{"WorkspaceChanged":3}}',
    '{"Event":{"Idle":true}}',
    '{"Event":{"Idle":false}}',
    '{"Event":"Tick"}',
    "{bad",
    '{"Event":{"Nope":1}}',
    '{"Event":{"ActiveWindowChanged":"' + "x" * 70000 + '"}}',
]


def _env(spark, lines, source="s"):
    rows = [(1, source, i, i, line) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "stream_key long, source string, seq long, t long, line string")
    return df.selectExpr("stream_key", "source", "seq", "timestamp_seconds(t) AS ts", "line")


def test_parse_and_quarantine(spark):
    parsed = EN.parse_envelopes(_env(spark, LINES)).orderBy("seq").collect()
    got = [(r.msg_type, r.kind, r.app_id, r.workspace, r.protocol_version, r.reject) for r in parsed]
    assert got == [
        ("Ping", None, None, None, None, None),
        ("Handshake", None, None, None, 1, None),
        ("Event", "focus", "kitty", None, None, None),
        ("Event", "focus", None, None, None, None),
        ("Event", "workspace", None, 3, None, None),
        ("Event", "idle_on", None, None, None, None),
        ("Event", "idle_off", None, None, None, None),
        ("Event", "tick", None, None, None, None),
        (None, None, None, None, None, "malformed json"),
        (None, None, None, None, None, "unknown message"),
        (None, None, None, None, None, "message too large"),
    ]
    good, bad = EN.split_quarantine(EN.parse_envelopes(_env(spark, LINES)))
    assert good.count() == 8 and bad.count() == 3


def test_values_of_the_wrong_type_are_unknown_messages(spark):
    from sessionlake.fixtures import UNKNOWN_LINES

    lines = [*UNKNOWN_LINES, '{"Event":{"WorkspaceChanged":99999999999}}', '{"Handshake":{"protocol_version":1}}', "[1]"]
    assert {r.reject for r in EN.parse_envelopes(_env(spark, lines)).collect()} == {"unknown message"}
    big = EN.parse_envelopes(_env(spark, ['{"Handshake":{"protocol_version":4294967295,"backend_name":"x","more":1}}'])).first()
    assert (big.msg_type, big.protocol_version, big.backend_name) == ("Handshake", 4294967295, "x")


def test_message_lines_from_text(spark, tmp_path):
    folder = tmp_path / "stream_key=7" / "source=b0"
    folder.mkdir(parents=True)
    (folder / "log").write_text("".join(f"{i * 1_000_000}\t{x}\n" for i, x in enumerate(LINES[:9])), encoding="utf-8")
    rows = read_message_lines(spark, str(tmp_path))
    assert [r.line for r in rows.orderBy("ts", "seq").collect()] == LINES[:9]
    good, bad = EN.split_quarantine(EN.parse_envelopes(rows))
    events = EN.to_session_events(EN.accept_sources(good)).orderBy("seq").collect()
    assert [(r.stream_key, r.kind) for r in events] == [(7, k) for k in ("focus", "focus", "workspace", "idle_on", "idle_off")]
    assert [r.reject for r in bad.collect()] == ["malformed json"]


def test_accept_sources(spark):
    a = _env(spark, ['{"Handshake":{"protocol_version":1,"backend_name":"x"}}', '{"Event":{"Idle":true}}'], "a")
    b = _env(spark, ['{"Handshake":{"protocol_version":2,"backend_name":"y"}}', '{"Event":{"Idle":true}}'], "b")
    parsed = EN.parse_envelopes(EN.merge_sources(a, b))
    assert sorted({r.source for r in EN.accept_sources(parsed).collect()}) == ["a"]
    flagged = {(r.source, r.accepted) for r in EN.accept_sources(parsed, enforce=False).collect()}
    assert flagged == {("a", True), ("b", False)}


SCHEMA = (
    "stream_key long, seq long, ts_us long, kind string, window_id long, app_id string, workspace_id long, "
    "focused boolean, windows array<struct<id:long,app_id:string,is_focused:boolean>>, "
    "workspaces array<struct<id:long,is_focused:boolean>>"
)


def _comp(spark, rows):
    full = [(1, i, i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_window_opened_then_focused(spark):
    df = _comp(
        spark,
        [
            ("WindowOpenedOrChanged", 0, "test_app_0", None, None, None, None),
            ("WindowFocusChanged", 0, None, None, None, None, None),
            ("WindowFocusChanged", 9, None, None, None, None, None),  # unknown id: nothing
            ("WindowClosed", 0, None, None, None, None, None),
            ("WindowFocusChanged", 0, None, None, None, None, None),  # closed: nothing
            ("WindowFocusChanged", None, None, None, None, None, None),  # focus lost
        ],
    )
    core, rejects = C.normalize_compositor(df)
    got = sorted((r.seq, r.kind, r.app_id) for r in core.collect())
    assert got == [(1, "focus", "test_app_0"), (5, "focus", None)]
    assert rejects.count() == 0


def test_workspaces(spark):
    df = _comp(
        spark,
        [
            ("WorkspaceActivated", None, None, 0, True, None, None),
            ("WorkspaceActivated", None, None, 2, False, None, None),
            ("WorkspacesChanged", None, None, None, None, None, [(0, False), (3, True), (4, True)]),
            ("WindowsChanged", None, None, None, None, [(5, "a", False), (6, "b", True)], None),
            ("WorkspaceActivated", None, None, 2**40, True, None, None),
        ],
    )
    core, rejects = C.normalize_compositor(df)
    got = sorted((r.seq, r.kind, r.app_id, r.workspace) for r in core.collect())
    assert got == [(0, "workspace", None, 0), (2, "workspace", None, 3), (3, "focus", "b", None)]
    assert [r.seq for r in rejects.collect()] == [4]


def test_hot_window_split_equals_plain(spark):
    """J3 on the fixture: windows above the hot threshold take the chunked as-of lookup; same rows."""
    from conftest import SF_SMALL
    from sessionlake.fixtures import compositor_events, read_table

    ev = compositor_events(read_table(spark, SF_SMALL, "events"))
    plain, _ = C.normalize_compositor(ev, hot_key_rows=None)
    split, _ = C.normalize_compositor(ev, hot_key_rows=2, rows_per_chunk=2)
    assert sorted(plain.collect()) == sorted(split.collect())
    assert plain.count() > 0
