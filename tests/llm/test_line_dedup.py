"""Operator 1 against brute force over all pairs of lines."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash

from sessionlake.llm import linking
from sessionlake.llm.line_dedup import MIN_CHARS, PERCENT, Q, Lines, dedup_lines
from sessionlake.llm.text import utf8


def norm(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    for c in "\t\r\v\f":
        low = low.replace(c, " ")
    return " ".join(x for x in low.split(" ") if x)


def place(text):
    """Which of the texts of a repeated id comes first, as the operator orders them."""
    return int(np.array(xxhash.xxh64(text.encode(), seed=42).intdigest(), np.uint64).view(np.int64))


def brute(rows):
    where = {}
    for key, text in rows:
        if key is not None and text is not None:
            for pos, line in enumerate(text.split("\n")):
                if len(n := norm(line)) >= MIN_CHARS:
                    where.setdefault(n, set()).add((key, place(text), pos))
    sets = {n: {n[i : i + Q] for i in range(max(1, len(n) - Q + 1))} for n in where}
    names = sorted(where)
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= PERCENT * (len(sets[a]) + len(sets[b]) - k):
                parent[root(a)] = root(b)
    groups = {}
    for n in names:
        groups.setdefault(root(n), set()).update(where[n])
    gone = {p for g in groups.values() for p in g - {min(g)}}
    out = []
    for key, text in rows:
        lines = text.split("\n") if text else []
        kept = [x for i, x in enumerate(lines) if (key, place(text or ""), i) not in gone]
        out.append((key, "\n".join(kept) if text is not None else None, len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé中", k=rng.randint(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 25)))
    bases = [line() for _ in range(12)]

    def copy():
        s = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            s[rng.randrange(len(s))] = rng.choice("xyzXYZ \t")
        return "".join(s)

    docs = ["\n".join(rng.choice([line, copy, lambda: "", lambda: "Short line."])() for _ in range(rng.randint(1, 12))) for _ in range(60)]
    return [(3 * i, t) for i, t in enumerate(docs)]


EDGES = [(9000, None), (9001, ""), (9002, "\n\n  \n"), (None, "a line that is long enough to count here"), (9003, "A line that is LONG enough\tto  count here \nA line that is long enough to count here\nx"), (9004, "word " * 30_000 + "\nlast line of a very long document here"), (9005, "last line of a very long document here")]


def run(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_lines int")
    return sorted((tuple(r) for r in dedup_lines(df).select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)


def test_same_as_brute_force(spark):
    rows = corpus(1) + EDGES
    assert run(spark, rows) == brute(rows)


def test_large_groups_branch(spark, monkeypatch):
    monkeypatch.setattr(linking, "SMALL", 3)
    monkeypatch.setattr(linking, "PIVOTS", 1)
    rows = corpus(2)
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "this line stands here again and again"
    assert run(spark, [(1, t), (1, t), (2, t)]) == sorted([(1, t, 1, 0), (1, t, 1, 0), (2, "", 1, 1)], key=str)


def test_lines_of_a_run():
    texts = ["  A  b\t\nc \n\n", "", None, "é中 x", "\n", " "]
    data, offsets = utf8(pa.array(texts))
    lines = Lines(data, offsets)
    got = [(int(d), int(p), lines.text(i).decode()) for i, (d, p) in enumerate(zip(lines.doc, lines.pos, strict=True))]
    want = [(d, p, " ".join(x.split())) for d, t in enumerate(texts) for p, x in enumerate((t or "").split("\n"))]
    assert [(d, p, x.lower()) for d, p, x in got] == [(d, p, x.lower()) for d, p, x in want]


def changed_lines(n, size, seed):
    """Lines of ``size`` characters, each with a copy that has another character in the middle: size - 15 of size + 1 shingles are shared."""
    rng = random.Random(seed)
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size)) for _ in range(n)]
    return lines, [x[: size // 2] + "#" + x[size // 2 + 1 :] for x in lines]


def test_pairs_from_the_threshold_of_three_quarters(spark):
    linked, copies = changed_lines(40, 63, 5)  # 48 of 64 shingles
    apart, others = changed_lines(40, 62, 6)  # 47 of 63
    rows = [(i, t) for i, t in enumerate([*linked, *apart, *copies, *others])]
    got = run(spark, rows)
    assert {r[0] for r in got if r[3]} == set(range(80, 120))


def test_short_lines_take_part(spark):
    """"short line!" shares 3 of 4 shingles with "short line"."""
    rows = [(1, "x\nno\nshort line\n\n"), (2, "No\nX y\nSHORT  line\nx\n\n"), (3, "nob\n12345678\n1234567\nshort line!"), (4, "1234567\n 12345678 \n中é"), (5, "中é\n \nno")]
    want = [(1, "x\nno\nshort line\n\n", 5, 0), (2, "X y\n\n", 6, 3), (3, "nob\n12345678\n1234567", 4, 1), (4, "中é", 3, 2), (5, " ", 3, 2)]
    assert run(spark, rows) == want


def test_a_repeated_id_with_another_text_and_clashing_names(spark):
    x, y, z = (f"{w} line of some length that stands alone {w}{w}{w}" for w in ("first", "second", "third"))
    rows = [(1, x), (5, y), (5, x), (6, z + "\n" + x)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, cut int, of int, _gone int, _key int")
    got = dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == [(1, x, 0), (5, "", 1), (5, y, 0), (6, z, 1)]
    assert dedup_lines(df.limit(0)).collect() == []


def test_a_members_set_is_read_once_for_all_its_nodes(monkeypatch):
    """Before, every node read the sets of its members anew; links are those of all pairs, however they are counted."""
    rng = np.random.default_rng(3)
    sets = {i: np.unique(np.append(np.arange(40 * (i // 4), 40 * (i // 4) + 40), rng.integers(1000, 2000, 6))).astype(np.uint64) for i in range(24)}
    rows = [(n, i) for n in range(5) for i in sorted(rng.permutation(24)[:16].tolist())]
    batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows]), pa.array([i for _, i in rows]), pa.array([i % 4 % 3 for _, i in rows]), pa.array([sets[i].tobytes() for _, i in rows], pa.binary())], names=["node", "id", "comp", "data"])
    alike = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    for cells in (linking.CELLS, 10):
        monkeypatch.setattr(linking, "CELLS", cells, raising=False)
        read = []

        def read_set(data):
            read.append(data)
            return np.frombuffer(data, np.uint64)

        got = [tuple(r.values()) for b in linking._exact_links(read_set, 75)(iter([batch])) for r in b.to_pylist()]
        assert len(read) == len(set(read)) == len({i for _, i in rows})
        want = []
        for n in range(5):
            ids, joined = [i for k, i in rows if k == n], linking._Joined()
            for a in ids:
                for b in ids:
                    if a < b and a % 4 % 3 != b % 4 % 3 and alike(a, b) and joined.join(a % 4 % 3, b % 4 % 3):
                        want.append((b, a))
        assert want and got == want


def test_lines_are_read_in_memory_that_stays():
    """Once some texts are read, the next ones need few new pages of the system, in a fresh process as in a worker."""
    code = """
import resource
import pyarrow as pa
from sessionlake.llm import line_dedup
texts = pa.array(["\\n".join(f"line {i} of text {j} with some words" for i in range(60)) for j in range(1500)])
faults = []
for _ in range(4):
    for _ in line_dedup.line_runs(texts):
        pass
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print(faults[-1] - faults[-2])
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(linking.__file__).parents[2])
    assert int(found.stdout) < 5000  # 4 KB each; the texts are 3 MB, their arrays over 100 MB


def test_free_memory_goes_back_at_a_tasks_end():
    """A worker of the pipeline runs other stages' tasks next, so what was kept for the next texts must not stay."""
    code = """
import numpy as np
from sessionlake.llm.text import give_back, keep_room
keep_room()
held = lambda: int(open("/proc/self/statm").read().split()[1]) >> 8
rows = [np.ones(1 << 17) for _ in range(200)]
rows = rows[::20]
before = held()
give_back()
print(before - held())
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(linking.__file__).parents[2])
    assert int(found.stdout) > 100  # of 190 MB


def test_packed_pairs_give_the_nodes_of_single_rows(spark, monkeypatch):
    """Pairs travel packed; before, each was a row. A part with too many pairs goes on as single rows."""
    rng = np.random.default_rng(5)
    node, ids = rng.integers(0, 1 << 62, 700)[rng.integers(0, 700, 3000)], rng.integers(0, 300, 3000)
    node[:900], node[900:905] = 5, -5  # a large node, part of it repeated
    pairs = spark.createDataFrame(list(zip(node.tolist(), ids.tolist(), strict=True)), "node bigint, id bigint").repartition(3)
    read = lambda batch: (np.asarray(batch.column(0)), np.asarray(batch.column(1)))
    want = sorted(map(tuple, linking.shared_nodes(pairs).collect()))
    for part_pairs, packed in ((1 << 18, 1 << 20), (100, 1 << 20), (100, 50), (5000, 200)):
        monkeypatch.setattr(linking, "PART_PAIRS", part_pairs)
        monkeypatch.setattr(linking, "PACKED", packed)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
        try:
            got = sorted(map(tuple, linking.shared_packed(pairs, read, 3000).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert want and got == want
    assert linking.shared_packed(pairs.limit(0), read, 0).collect() == []
