"""The reference's state-machine tests (FIXTURES.md section 2) on the pure step machine."""

import pytest

from helpers import run_machine

IDLE = (False, None, None)


def A(app, ws=None):
    return (True, app, ws)


# Event scripts and the sessions that must come out.
GOLDEN = [
    ("@1 F(firefox) !", 15, 0, (), [(1, 1, A("firefox"))]),
    ("@1 F(firefox) @30 T", 15, 0, (), [(1, 30, A("firefox"))]),
    ("@1 F(alacritty) @15 T", 15, 0, (), [(1, 15, A("alacritty"))]),
    ("@1 W(1) F(firefox) !", 15, 0, (), [(1, 1, A("firefox", 1))]),
    ("@1 F(-) !", 15, 0, (), [(1, 1, IDLE)]),
    (
        "@1 F(firefox) @11 T ! F(kitty) @21 T ! F(alacritty) @31 T !",
        15, 0, (),
        [(1, 11, A("firefox")), (11, 21, A("kitty")), (21, 31, A("alacritty"))],
    ),
    ("@1 I+ @6 T !", 15, 0, (), [(1, 6, IDLE)]),
    (
        "@1 F(Terraria) @6 T ! I+ @11 T ! I- @16 T !",
        15, 0, (),
        [(1, 6, A("Terraria")), (6, 11, IDLE), (11, 16, A("Terraria"))],
    ),
    ("@1 F(tg) T @16 T ! @31 T ! @46 T !", 15, 0, (), [(1, 46, A("tg"))]),
    ("@1 F(steam) @6 T ! F(kitty) @7 T F(steam) @12 T !", 15, 0, (), [(1, 12, A("steam"))]),
    ("@1 F(alacritty) @5 T", 5, 0, (), [(1, 5, A("alacritty"))]),
    ("@1 F(X) @999999 T !", 15, 5, ("X",), []),
    ("@1 F(firefox) @21 T ! F(zen) @26 T !", 15, 10, (), [(1, 21, A("firefox"))]),
]


@pytest.mark.parametrize("script,interval,min_dur,hidden,expected", GOLDEN)
def test_golden_scripts(script, interval, min_dur, hidden, expected):
    sessions, _ = run_machine(script, interval, min_dur, hidden)
    assert sessions == expected


def test_stale_restore():
    # F(a) I+ I- F(-) I- restores a (old state is never cleared)
    sessions, resp = run_machine("@1 F(a) @10 I+ @20 I- @30 F(-) @40 I- @50 !", 15, 0)
    assert resp[-2] == "SessionIdled(false)"
    assert sessions[-1][2] == A("a")


def test_focus_change_between_flushes_loses_tail():
    sessions, _ = run_machine("@1 F(a) @20 T @25 F(b) @40 T", 15, 0)
    assert sessions == [(1, 20, A("a")), (25, 40, A("b"))]


def test_workspace_change_alone_does_not_split():
    sessions, _ = run_machine("@1 W(1) F(a) @10 W(2) @20 T @40 T", 15, 0)
    assert sessions == [(1, 40, A("a", 1))]


RESPONSES = [
    ("@1 F(kitty)", (), ["SessionCreated"]),
    ("@1 F(hidden)", ("hidden",), ["Ignored"]),
    ("@1 W(3)", (), ["Handled"]),
    ("@1 I+ I+ I-", (), ["Handled", "Ignored", "Handled"]),
    ("@1 F(kitty) I+ I-", (), ["SessionCreated", "SessionIdled(true)", "SessionIdled(false)"]),
    ("@1 T", (), ["Ignored"]),
    ("@1 F(kitty) @2 T", (), ["SessionCreated", "Handled"]),
]


@pytest.mark.parametrize("script,hidden,expected", RESPONSES)
def test_responses(script, hidden, expected):
    _, resp = run_machine(script, 15, 0, hidden)
    assert resp == expected
