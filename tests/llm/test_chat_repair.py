"""Operator 11 against the recursion over every edit, and a repair's own rules."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import chat_repair
from sessionlake.llm.chat_repair import BEHIND, GONE, START, Runs, _apply, _row_matrix, before_run, damage, repair

SPACE = " \t\n\x0b\x0c\r"
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # by the last role's initial


def cheapest(rows):
    """(cost, audit) by trying each edit everywhere; rows: (initial, must go, truncated)."""

    @functools.cache
    def best(i, last, inserts):
        found = [] if i < len(rows) or last not in ("", "a") else [(0, "")]
        new = "a" if last == "u" else "u"
        if inserts < 2:
            c, audit = best(i, new, inserts + 1)
            found.append((c + 2, "I" + audit))
        if i < len(rows):
            initial, gone, cut = rows[i]
            edits = [("D", 3, last)]
            if not gone:
                edits.append(("R", 2 + cut, new))
                if initial in AFTER[last]:
                    edits.append(("K", cut, AFTER[last][initial]))
            for edit, cost, state in edits:
                c, audit = best(i + 1, state, 0)
                found.append((c + cost, edit + audit))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        role, text, kind = say(role), say(text), zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own = convs.setdefault(conv, [])
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        faults, seen = [], set()
        for _, role, text in own:
            ink = text.strip(SPACE)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)])
        lines, i = [], 0
        for edit in audit:
            new = "assistant" if lines and lines[-1][0] == "u" else "user"
            if edit != "D":
                lines.append(f"{new}:" if edit == "I" else f"{own[i][1] if edit == 'K' else new}:{own[i][2]}")
            i += edit != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, -3, *range(60)]:
        for turn in range(r.randint(1, 14)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = r.choice(["Yes.", "No!", "Why?", "open", "open ", "a\nb. \t", "", " \x0b", None, "é…", f"own {turn}."])
            rows.append((conv, r.choice([turn, turn, turn, turn + 5, None]), role, text))
    rows += [(200, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(60)] + [(201, 5, "user", "same.")] * 30
    rows += [(202, None, "system", f"no turn {i}.") for i in range(20)] + [(203, 1, "user", "long " * 50_000)]
    return rows + [(300 + i, 0, "user", "alone.") for i in range(30)]  # some lose their only row


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def run(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, repair(damage(spark.createDataFrame(rows, schema).repartition(5))).collect()), key=str)


@pytest.mark.parametrize("rows, size", [(10**6, 10**9), (6, 10**9), (10**6, 60)])
def test_same_as_brute_force(spark, monkeypatch, rows, size):
    monkeypatch.setattr(chat_repair, "HOT_ROWS", rows)
    monkeypatch.setattr(chat_repair, "HOT_BYTES", size)
    monkeypatch.setattr(chat_repair, "BLOCK", 4)
    data = conversations(1)
    assert run(spark, data) == brute(data)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = [(1, i, r, "x.") for i, r in enumerate(["user", "user", "assistant"])]
    clash = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], SCHEMA + ", times int, kind int, seg int")
    assert sorted(map(tuple, repair(damage(clash)).collect()), key=str) == brute(rows)


symbols = st.lists(st.tuples(st.integers(0, GONE), st.integers(1, 9)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(symbols)
def test_runs_give_the_least_audit(pairs):
    runs = Runs()
    for symbol, count in pairs:
        runs.add(symbol, count)
    rows = [("sua?"[s & 3], s == GONE, s >> 2 == 1) for s, n in pairs for _ in range(n)]
    cost, audit = cheapest(rows)
    assert runs.bounds(BEHIND)[0][START] == cost == _apply(runs.matrix(), BEHIND)[START]
    assert "".join(e for e, _ in runs.edits(START, BEHIND)) == audit


@settings(deadline=None)
@given(st.integers(0, GONE), st.integers(0, 1500))
def test_powers_are_single_steps(symbol, count):
    v = BEHIND
    for _ in range(count):
        v = _apply(_row_matrix(symbol), v)
    assert before_run(symbol, count, BEHIND) == v
