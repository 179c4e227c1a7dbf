"""Operator 10 against all places of all windows, aligned without a filter or a band."""

import random

import numpy as np

from sessionlake.llm import decontaminate as dc


def norm(s):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    for c in "\t\r\v\f\n":
        low = low.replace(c, " ")
    return " ".join(x for x in low.split(" ") if x)


def edits_to_beginning(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def fewest_edits(window, text, text_size):
    """Fewest edits of a window to any part of each text: ``text`` holds the texts, with gaps too long to align across."""
    least = np.zeros(len(text) + 1, np.int16)
    step = np.arange(len(text) + 1, dtype=np.int32)
    for x in window:
        new = np.append(least[0] + 1, np.minimum(least[:-1] + (text != x), least[1:] + 1))
        least = (np.minimum.accumulate(new - step) + step).astype(np.int32)
    return np.minimum.reduceat(least, text_size)


def brute(docs, items):
    """Every window of every item at every place of every text, with both ends free."""
    keys = [(k, norm(t or "")) for k, t in docs if k is not None]
    gap = 2 * int(dc.EDITS * dc.WINDOW) + 2
    text = np.concatenate([np.array([*map(ord, t), *[-1] * gap]) for _, t in keys])
    begin = np.cumsum([0, *(len(t) + gap for _, t in keys)])[:-1]
    out = {}
    for item, passage in items:
        p = [ord(c) for c in norm(passage or "")]
        if item is None or len(p) < dc.MIN_CHARS:
            continue
        w = min(len(p), dc.WINDOW)
        e = int(dc.EDITS * w)
        e = e if w + 1 >= dc.Q * (e + 1) + 1 else 0  # too short for the q-grams to leave an edit
        for s in range(len(p) - w + 1):
            for (key, _), cost in zip(keys, fewest_edits(p[s : s + w], text, begin), strict=True):
                if cost <= e:
                    out[key, item] = min(out.get((key, item), 99), int(cost))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["the", "on", "er", "ti", "né", "sha", "wh", "a", "中"], k=rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(4, 30)).capitalize()) for i in range(12)]

    def noisy(s, n):
        s = list(s)
        for _ in range(n):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], ["x"], [s[i], "z"]])
        return "".join(s)

    docs = []
    for i in range(70):
        parts = [prose(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            text = rng.choice(items)[1]
            lo = rng.choice([0, 0, rng.randint(0, 30)])
            parts += [noisy(text[lo : lo + rng.choice([60, 90, 400])] or "x", rng.randint(0, 9)).replace(" ", rng.choice([" ", " \n"])), prose(rng.randint(0, 25))]
        docs.append((i, rng.choice([str, str.upper])(" ".join(parts))))
    return docs, items


def test_same_as_brute_force(spark, monkeypatch):
    docs, items = corpus(1)
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, " x"), (503, ("filler text " * 900) + items[3][1] + " and more " * 900)]
    items += [(90, None), (91, ""), (92, "short"), (None, items[1][1]), (93, items[2][1])]
    want = brute(docs, items)
    assert len(want) > 20
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for chars in (dc.BLOCK_CHARS, 500):
        monkeypatch.setattr(dc, "BLOCK_CHARS", chars)
        got = dc.passages(d, b).collect()
        assert {(r.doc_id, r.item_id): r.n_edits for r in got} == want and len(got) == len(want)
    texts, passages = dict(docs), dict(items)
    for r in got:
        region, window = norm("|" + texts[r.doc_id][r.doc_start : r.doc_end] + "|")[1:-1], norm(passages[r.item_id])[r.item_start :][: dc.WINDOW]
        assert edits_to_beginning(window, region) == r.n_edits


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some text " * 9)], "item_id long, text string")
    assert dc.passages(d, b.limit(0)).count() == 0 and dc.passages(d.limit(0), b).count() == 0
    assert dc.passages(d.union(d), b).count() == 0


def test_band_equals_full_alignment():
    rng = random.Random(4)
    a, b = [], []
    for _ in range(200):
        s = [rng.randrange(4) for _ in range(rng.randint(5, 40))]
        t = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], [9], [t[i], 8]]) or []
            t = t or [7]
        a.append(np.array(s))
        b.append(np.array(t + [rng.randrange(4) for _ in range(rng.randint(0, 5))]))
    cost, _ = dc.align(a, b, np.full(len(a), 5))
    for x, y, c in zip(a, b, cost, strict=True):
        full = edits_to_beginning(list(x), list(y)[: len(x) + 5])
        assert c == full if full <= 5 else c > 5


def edits_anywhere(a, b):
    """Fewest edits from ``a`` to any part of ``b``: every document place is tried."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute_anywhere(docs, items):
    out = {}
    for key, text in docs:
        t = norm(text)
        for item, passage in items:
            p = norm(passage)
            w = min(len(p), dc.WINDOW)
            e = int(dc.EDITS * w)
            e = e if w + 1 - dc.Q * (e + 1) >= 1 else 0
            cost = min(edits_anywhere(p[s : s + w], t) for s in range(len(p) - w + 1)) if p else 99
            if cost <= e:
                out[key, item] = min(out.get((key, item), 99), cost)
    return out


def found(spark, docs, items):
    rows = dc.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): r.n_edits for r in rows}, rows


def test_every_document_place(spark):
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choices("abcdefghij klmnopqrstuv ", k=n))
    items = [(i, prose(n)) for i, n in enumerate([60, 80, 84, 88, 40, 33, 18, 27, 16, 9, 7, 3])]
    docs = []
    for i in range(24):
        s = list(items[i % 12][1])
        for at in rng.sample(range(min(9, len(s))), min(len(s), rng.randint(0, 2))) + rng.sample(range(len(s)), min(len(s), rng.randint(0, 4))):
            s[at] = rng.choice(["#", "", s[at] + "#", s[at]])
        docs.append((i, prose(rng.choice([0, 5, 60])) + rng.choice(["", " "]) + "".join(s) + prose(rng.choice([0, 4, 60]))))
    want = brute_anywhere(docs, items)
    got, rows = found(spark, docs, items)
    assert got == want and len(want) > 12 and max(want.values()) > 2
    texts, passages = dict(docs), dict(items)
    for r in rows:
        region, window = norm("|" + texts[r.doc_id][r.doc_start : r.doc_end] + "|")[1:-1], norm(passages[r.item_id])[r.item_start :][: dc.WINDOW]
        assert edits_to_beginning(window, region) == r.n_edits


def test_edit_near_the_start(spark):
    question = "what is the name of the longest river that crosses europe?!?"
    assert len(question) == 60
    got, _ = found(spark, [(1, "so: wh#t" + question[4:] + " yes")], [(7, question)])
    assert got == {(1, 7): 1}


def test_items_that_share_an_id(spark):
    got, _ = found(spark, [(1, "a first text of the item, long enough to be found"), (2, "some other words that have the same number here")], [(7, "a first text of the item, long enough to be found"), (7, "some other words that have the same number here")])
    assert got == {(1, 7): 0, (2, 7): 0}
