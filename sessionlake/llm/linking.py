"""Links between similar items: candidates inside nodes, exact checks, and components.

An item is an id with a *signature payload* (binary, turned into minwise values inside tasks)
and a *set payload* (binary, turned into a sorted set of 64-bit hashes inside tasks). A node is
a group of ids that may be similar. `resolve` finds the links between the members of all nodes:

- in a small node all members are compared by their signatures, in a large one all with a few
  pivots. The best spanning forest of the candidates is confirmed on the full sets, and
  confirmed links are merged into components: pairs inside one need no more work;
- a large node of one component is done. One with few members outside its largest
  component waits for the end; others branch to smaller nodes, which are treated alike;
- at the end all nodes that were small or waited (or were still large after the last level) are
  compared again: members with a candidate in another component bring their full sets to the node, where
  an inverted index finds the links. What leaves a node is a spanning forest of them, never all pairs.

So groups of thousands of copies cost work in proportion to their size, no two members of
different components are skipped, and rows that travel grow with the members of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.config import storage_root
from sessionlake.llm.text import U64, give_back, mix

#: Members of a node that are compared exhaustively, and pivots of a larger one.
SMALL, PIVOTS = 2048, 8
#: Members of a large node that one task compares with the node's probes.
SALT_ROWS = 50_000
#: Levels of branching before large nodes are compared in blocks.
LEVELS = 8
#: Rows of two numbers that may be broadcast (their size is checked by counting them).
BROADCAST_ROWS = 1_000_000
#: Set elements that a task remembers while it confirms pairs.
MEMO_HASHES = 4_000_000
#: Members of a node times distinct elements of their sets up to which all pairs are counted by one product.
CELLS = 4_000_000
#: Pairs of a node and an id in a part of the nodes, and pairs that a task packs or holds at once.
PART_PAIRS, PACKED = 1 << 17, 1 << 18
#: Edges that one task contracts.
PART_EDGES = 500_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there: lineage ends here."""
    spark = df.sparkSession
    path = storage_root(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has few rows; Spark's own choice otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# -- components ---------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component of a part of the edges (union-find inside the part)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounded memory: pass on what is known, begin anew
            yield out()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id of an edge (a, b), the smallest id that it is connected with.

    Union-find in two steps: parts of at most about `PART_EDGES` edges are contracted to stars
    where they lie, then large-star and small-star rounds join them until nothing changes
    (a single part needs none).
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    parts = -(-e.count() // PART_EDGES)
    e = stored(e.coalesce(max(1, parts)).mapInArrow(_forest, "a bigint, b bigint"), "forests")
    seen = None
    while parts > 1:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now.n == 0 or (now.n, now.h) == seen:
            break
        seen = (now.n, now.h)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e = stored(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "stars")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


# -- runs of equal keys ---------------------------------------------------------


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys of sorted rows; each run lies in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(key))
        last = int(np.searchsorted(k, k[-1], side="left"))  # where the last run begins
        if held and np.asarray(held[-1].column(key))[-1] == k[-1] and last == 0:
            held.append(batch)
            continue
        if last or held:
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def shared_nodes(rows: DataFrame) -> DataFrame:
    """(node, id): the distinct rows of nodes with two ids or more. One shuffle, no memory of a whole node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node0 = id0 = None  # the last row seen
        held = False  # it is not out yet, as it began its node
        for batch in batches:
            node, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
            if len(node) and node0 is not None:
                new[0] = (node[0], ids[0]) != (node0, id0)
            node, ids = node[new], ids[new]
            if not len(node):
                continue
            same = np.zeros(len(node), bool)
            same[1:] = node[1:] == node[:-1]
            same[0] = node0 is not None and node[0] == node0
            keep = same.copy()
            keep[:-1] |= same[1:]
            out_n, out_i = node[keep], ids[keep]
            if same[0] and held:
                out_n, out_i = np.insert(out_n, 0, node0), np.insert(out_i, 0, id0)
            node0, id0, held = node[-1], ids[-1], not keep[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out_n), pa.array(out_i)], names=["node", "id"])

    sorted_rows = rows.select("node", "id").repartition("node").sortWithinPartitions("node", "id")
    return sorted_rows.mapInArrow(run, "node bigint, id bigint")


def _dealt(read: Callable, parts: int) -> Callable:
    """(part, nodes, ids): the pairs of batches, `PACKED` or so at a time, as numbers by the part of their node."""

    def deal(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        node, ids = (np.concatenate(x) for x in zip(*pairs, strict=True))
        part = ((node.view(U64) >> U64(32)) % U64(parts)).astype(np.min_scalar_type(parts))
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
        ends = pa.py_buffer((8 * np.append(first, len(part))).astype(np.int32))
        cells = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(x[order].tobytes())]) for x in (node, ids)]
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int64)), *cells], names=["part", "nodes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(read(batch))
            n += len(held[-1][0])
            if n > PACKED:
                yield deal(held)
                held, n = [], 0
        if n:
            yield deal(held)
        give_back()

    return run


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order."""
    node, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    order = np.lexsort((ids, node))
    node, ids = node[order], ids[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
    return node[new], ids[new]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, open) of rows sorted by part: the distinct pairs of nodes with two ids or more; of a part with more than `PACKED`
    distinct pairs all that are left are open, with repeats."""

    def out(node: np.ndarray, ids: np.ndarray, is_open: bool) -> pa.RecordBatch:
        if not is_open:
            same = node[1:] == node[:-1]
            keep = np.append(False, same) | np.append(same, False) if len(node) else np.zeros(0, bool)
            node, ids = node[keep], ids[keep]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(ids), pa.array(np.full(len(node), is_open))], names=["node", "id", "open"])

    own, held, n, is_open = None, [], 0, False
    for batch in batches:
        for part, nodes, ids in zip(*(batch.column(c) for c in ("part", "nodes", "ids")), strict=True):
            if part.as_py() != own:
                if held:
                    yield out(*_distinct(held), is_open)
                own, held, n, is_open = part.as_py(), [], 0, False
            held.append(tuple(np.frombuffer(x.as_buffer(), np.int64) for x in (nodes, ids)))
            n += len(held[-1][0])
            if n > 2 * PACKED:
                held = [_distinct(held)]
                n = len(held[0][0])
                if is_open or n > PACKED:
                    yield out(*held[0], True)
                    held, n, is_open = [], 0, True
    if held:
        yield out(*_distinct(held), is_open)
    give_back()


def shared_packed(rows: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], n: int) -> DataFrame:
    """`shared_nodes`, stored, of the pairs (nodes, ids) that ``read`` finds in batches of rows, about ``n`` in all.

    Pairs travel packed by parts of the nodes, about `PART_PAIRS` in each, as a row for each costs more than the work on it.
    A part with very many pairs of its own (of a large node, say) goes the way of single rows.
    """
    dealt = rows.mapInArrow(_dealt(read, max(1, -(-n // PART_PAIRS))), "part bigint, nodes binary, ids binary")
    found = stored(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_shared, "node bigint, id bigint, open boolean"), "shared")
    nodes, rest = found.filter("not open").select("node", "id"), found.filter("open")
    return nodes if rest.isEmpty() else stored(nodes.unionByName(shared_nodes(rest)), "shared")


# -- candidates and links ---------------------------------------------------------


@dataclass
class Items:
    """What `resolve` compares: signature rows (id, sig), set rows for given ids, and how to read them."""

    signatures: DataFrame
    sets: Callable[[DataFrame, int], DataFrame]  # (distinct ids, their number) -> (id, data)
    read_signatures: Callable[[pa.Array], np.ndarray]
    read_set: Callable[[bytes], np.ndarray]
    cut: int  # equal minwise values that make a candidate
    percent: int  # 100 * intersection >= percent * union makes a link


PAIRS = "a bigint, b bigint"


def _pairs_batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y), pa.int64()), pa.array(np.minimum(x, y), pa.int64())], names=["a", "b"])


def _candidates(node: np.ndarray, comp: np.ndarray, sig: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x < y of one node (rows are sorted by it) in different components with ``cut`` equal values; how many are."""
    left = np.searchsorted(node, node, side="right") - np.arange(len(node)) - 1  # rows of the node after each
    at, x, y, equal = np.flatnonzero(left), [], [], []
    step = 1
    while len(at):
        for part in np.array_split(at, -(-len(at) // 65536)):
            part = part[comp[part] != comp[part + step]]
            n = (sig[part] == sig[part + step]).sum(axis=1, dtype=np.uint16)
            ok = np.flatnonzero(n >= cut)
            x.append(part[ok])
            y.append(part[ok] + step)
            equal.append(n[ok].astype(np.int64))
        step += 1
        at = at[left[at] >= step]
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y, equal))


class _Joined:
    """Components joined so far."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, x, y) -> bool:
        """Whether x and y were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _forest_of(node: np.ndarray, comp: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Which of the pairs of rows (x, y), the first ones first, join components that no earlier pair of their node joins."""
    joined = _Joined()
    return [k for k, (of, p, q) in enumerate(zip(node[x].tolist(), comp[x].tolist(), comp[y].tolist(), strict=True)) if joined.join((of, p), (of, q))]


def _node_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for table in runs_of(batches, "node"):
        yield table.combine_chunks()


def _compare_small(read: Callable, cut: int) -> Callable:
    """A best spanning forest of the candidate pairs (a, b) of different components in each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _node_tables(batches):
            node, ids, comp = (table.column(c).to_numpy() for c in ("node", "id", "comp"))
            x, y, equal = _candidates(node, comp, read(table.column("sig").combine_chunks()), cut)
            order = np.argsort(-equal, kind="stable")
            x, y = x[order], y[order]
            keep = _forest_of(node, comp, x, y)
            yield _pairs_batch(ids[x[keep]], ids[y[keep]])

    return run


def _partners(read: Callable, cut: int) -> Callable:
    """(node, id, comp) of the members that have a candidate of another component in their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _node_tables(batches):
            node, ids, comp = (table.column(c).to_numpy() for c in ("node", "id", "comp"))
            x, y, _ = _candidates(node, comp, read(table.column("sig").combine_chunks()), cut)
            at = np.unique(np.concatenate([x, y]))
            yield pa.RecordBatch.from_arrays([pa.array(v[at], pa.int64()) for v in (node, ids, comp)], names=["node", "id", "comp"])

    return run


class _Postings:
    """Which of some sets hold each element."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.zeros(0, U64), *sets])
        order = np.argsort(flat, kind="stable")
        self.values, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[order]

    def similar(self, one: np.ndarray, percent: int) -> np.ndarray:
        """The sets that share enough with ``one``."""
        shared = np.zeros(len(self.size), np.int64)
        at = np.searchsorted(self.values, one)
        known = at < len(self.values)
        known[known] = self.values[at[known]] == one[known]
        at = at[known]
        for part in np.array_split(at, -(-int(self.count[at].sum()) // 2_000_000) or 1):
            count = self.count[part]
            before = np.cumsum(count) - count
            spans = np.repeat(self.first[part] - before, count) + np.arange(int(count.sum()))
            shared += np.bincount(self.owner[spans], minlength=len(shared))
        return np.flatnonzero(100 * shared >= percent * (self.size + len(one) - shared))


def _links_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets x < y that share enough, in order."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")  # which merges the sorted sets
    flat = flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    n = np.count_nonzero(new)
    if len(sets) * n <= CELLS:  # all counts at once, by a product of 0/1 rows
        held = np.zeros((len(sets), n), np.float32)
        held[np.repeat(np.arange(len(sets)), size)[order], np.cumsum(new) - 1] = 1
        shared = (held @ held.T).astype(np.int64)
        return np.nonzero(np.triu(100 * shared >= percent * (size[:, None] + size - shared), 1))
    postings, x, y = _Postings(sets), [], []
    for k, one in enumerate(sets):
        found = postings.similar(one, percent)
        y.append(found[found > k])
        x.append(np.full(len(y[-1]), k))
    return np.concatenate(x), np.concatenate(y)


def _exact_links(read_set: Callable, percent: int) -> Callable:
    """A spanning forest of the links (a, b) between different components in each node, by the members' full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}  # a member's set is the same in all of its nodes
        held = 0
        for table in _node_tables(batches):
            node, ids, comp = (table.column(c).to_numpy() for c in ("node", "id", "comp"))
            data = table.column("data")
            cuts, links = np.flatnonzero(np.diff(node)) + 1, [np.zeros((2, 0), np.int64)]
            for i, j in zip(np.append(0, cuts), np.append(cuts, len(node)), strict=True):
                if held > MEMO_HASHES:
                    memo.clear()
                    held = 0
                sets = []
                for k, name in enumerate(ids[i:j].tolist(), int(i)):
                    if name not in memo:
                        memo[name] = read_set(data[k].as_py())
                        held += len(memo[name])
                    sets.append(memo[name])
                x, y = _links_of(sets, percent)
                links.append(np.stack([x, y]) + i)
            x, y = np.concatenate(links, axis=1)
            apart = comp[x] != comp[y]
            x, y = x[apart], y[apart]
            keep = _forest_of(node, comp, x, y)
            yield _pairs_batch(ids[x[keep]], ids[y[keep]])
        memo.clear()
        give_back()

    return run


KEY = ["node", "salt", "block"]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Parts of batches that share a key (`KEY`), with whether the key is a new one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(c)) for c in KEY])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for i, j in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
            yield batch.slice(i, j - i), held != tuple(key[:, i])
            held = tuple(key[:, i])


def _stream_probes(read: Callable, cut: int, best: bool) -> Callable:
    """Candidates of rows sorted by `KEY` and member: a key's few probes come first and are held.

    Of candidate pairs of a member and a probe in other components the member's ``best``; or the members and
    probes that have one, with their key (a probe comes once for each part of a key's members).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids0, comp0, sig0 = [], [], []  # of the key's probes, in parts
        for part, new in _by_key(batches):
            if new:
                ids0, comp0, sig0 = [], [], []
            ids, comp, sig = np.asarray(part.column("id")), np.asarray(part.column("comp")), read(part.column("sig"))
            k = int(np.searchsorted(np.asarray(part.column("member")), True))
            if k:
                ids0.append(ids[:k])
                comp0.append(comp[:k])
                sig0.append(sig[:k])
            if k == len(ids) or not ids0:
                continue
            pid, pcomp, psig = np.concatenate(ids0), np.concatenate(comp0), np.concatenate(sig0)
            x, y, met = [], [], np.zeros(len(pid), bool)
            for r in range(k, len(ids)):
                equal = (psig == sig[r]).sum(axis=1)
                ok = np.flatnonzero((equal >= cut) & (pcomp != comp[r]))
                if len(ok):
                    x.append(r)
                    y.append(ok[np.argmax(equal[ok])])
                    met[ok] = True
            if best:
                yield _pairs_batch(ids[x], pid[y])
            else:
                both = [(np.append(ids[x], pid[met]), pa.int64()), (np.append(comp[x], pcomp[met]), pa.int64()), (np.append(np.ones(len(x), bool), np.zeros(int(met.sum()), bool)), pa.bool_())]
                key = [pa.array(np.full(len(both[0][0]), part.column(c)[0].as_py()), t) for c, t in zip(KEY, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*key, *(pa.array(v, t) for v, t in both)], names=[*KEY, "id", "comp", "member"])

    return run


def _exact_probes(read_set: Callable, percent: int) -> Callable:
    """A link (a, b) for each component that a member's links with its key's probes meet, by full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids0, comp0, sets0, held = [], [], [], None
        for part, new in _by_key(batches):
            if new:
                ids0, comp0, sets0, held = [], [], [], None
            x, y, joined = [], [], _Joined()
            rows = zip(*(part.column(c).to_pylist() for c in ("member", "id", "comp")), strict=True)
            for r, (member, i, c) in enumerate(rows):
                one = read_set(part.column("data")[r].as_py())
                if not member:
                    ids0.append(i)
                    comp0.append(c)
                    sets0.append(one)
                    continue
                held = held or _Postings(sets0)
                for p in held.similar(one, percent):
                    if joined.join(c, comp0[p]):
                        x.append(i)
                        y.append(ids0[p])
            yield _pairs_batch(np.array(x, np.int64), np.array(y, np.int64))

    return run


def probe(members: DataFrame, probes: DataFrame, items: Items, best: bool) -> DataFrame:
    """Candidate pairs between members (node, n, id, sig, comp) and their node's ``probes`` (the same, block, blocks).

    A node with many members is dealt to several tasks, each with the node's probes; probes that
    are too many for one block come in several, each met by all members. Each member's ``best`` candidate, or
    the confirmed links that join components.
    """
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    cols = [*KEY, "member", "id", "comp", "sig"]
    few = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("member", F.lit(False)).select(cols)
    many = members.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = few.unionByName(many.withColumn("member", F.lit(True)).select(cols)).repartition(*KEY).sortWithinPartitions(*KEY, "member")
    if best:
        return rows.mapInArrow(_stream_probes(items.read_signatures, items.cut, True), PAIRS)
    met = rows.mapInArrow(_stream_probes(items.read_signatures, items.cut, False), "node bigint, salt int, block int, id bigint, comp bigint, member boolean")
    met = with_sets(stored(met.distinct(), "probed"), items)
    return met.repartition(*KEY).sortWithinPartitions(*KEY, "member").mapInArrow(_exact_probes(items.read_set, items.percent), PAIRS)


def with_sets(rows: DataFrame, items: Items) -> DataFrame:
    """The rows with the full set (data) of their id."""
    ids = stored(rows.select("id").distinct(), "ids")
    return rows.join(items.sets(ids, ids.count()), "id")


def confirm(pairs: DataFrame, items: Items) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, stored."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = items.sets(ids, ids.count())
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("data").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("data").alias("y")), "b")
    read, percent = items.read_set, items.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}  # sets that many pairs share
        held = 0
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for r, pair in enumerate(zip(a, b, strict=True)):
                if held > MEMO_HASHES:
                    memo.clear()
                    held = 0
                both_sets = []
                for k, i in enumerate(pair):
                    got = memo.get(i)
                    if got is None:
                        got = memo[i] = read(batch.column(2 + k)[r].as_py())
                        held += len(got)
                    both_sets.append(got)
                x, y = both_sets
                least, most = sorted((len(x), len(y)))
                if 100 * least < percent * most:  # the smaller is too small even if it lies in the larger
                    continue
                n = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * n >= percent * (len(x) + len(y) - n):
                    ok.append(r)
            yield batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    return stored(both.select("a", "b", "x", "y").mapInArrow(run, PAIRS), "links")


def labelled(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The rows with comp: the component of their id, or the id."""
    if comp is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(comp.select("id", F.col("component").alias("_c")), "id", "left").withColumn("comp", F.coalesce("_c", "id")).drop("_c")


def by_component(rows: DataFrame) -> tuple[DataFrame, int]:
    """(node, main, outside): each node's largest component and the members outside it, of nodes with several; their number."""
    parts = rows.groupBy("node", "comp").agg(F.count("*").alias("k"))
    top = parts.groupBy("node").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("n"), F.count("*").alias("comps")).filter("comps > 1")
    top = stored(top.select("node", F.col("top.comp").alias("main"), (F.col("n") - F.col("top.k")).alias("outside")), "tops")
    return top, top.count()


def resolve(nodes: DataFrame, items: Items, branch: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and components (id, component) of the items in ``nodes`` (node, id), two ids or more in each.

    ``branch`` (rows of large nodes with sig, level) gives their children, as rows (node, id).
    The links connect every component; not every link inside a component is among them.
    """
    links = nodes.sparkSession.createDataFrame([], PAIRS)
    comp: DataFrame | None = None
    small_nodes: list[DataFrame] = []
    waiting: list[DataFrame] = []
    nodes = stored(nodes, "nodes")
    for level in range(LEVELS + 1):
        # the same members met in several nodes need one comparison
        every = nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
        sizes = stored(every.groupBy("n", "h").agg(F.min("node").alias("node")).select("node", "n"), "sizes")
        size = sizes.agg(F.count("*").alias("nodes"), F.sum((F.col("n") > SMALL).cast("int")).alias("large")).first()
        if not size.nodes:
            break
        members = nodes.join(small_side(sizes, size.nodes), "node").join(items.signatures, "id")
        members = stored(labelled(members, comp).select("node", "n", "id", "comp", "sig"), "members")
        small = members.filter(F.col("n") <= SMALL).select("node", "id", "sig", "comp")
        small_nodes.append(small.drop("comp"))
        found = small.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_compare_small(items.read_signatures, items.cut), PAIRS)
        large = members.filter(F.col("n") > SMALL).select("node", "n", "id", "sig", "comp")
        if size.large:
            # pivots: one of each residue of a hash
            turn = F.xxhash64("id", F.lit(level))
            pivots = large.groupBy("node", F.pmod(turn, F.lit(PIVOTS)).alias("turn")).agg(F.min(F.struct(turn.alias("t"), F.col("n"), F.col("id"), F.col("sig"), F.col("comp"))).alias("p"))
            pivots = pivots.select("node", "p.n", "p.id", "p.sig", "p.comp", F.lit(0).alias("block"))
            found = found.unionByName(probe(large.withColumn("blocks", F.lit(1)), pivots, items, True))
        links = links.unionByName(confirm(found, items))
        comp = stored(components(links), "components")
        if not size.large:
            break
        large = stored(labelled(large.drop("comp"), comp), "large-members")
        top, n = by_component(large)
        large = large.join(small_side(top, n), "node")
        waits = (F.col("outside") <= SMALL) | F.lit(level == LEVELS)
        waiting.append(large.filter(waits).select("node", "n", "id", "sig"))
        open_rows = large.filter(~waits).select("node", "id", "sig")
        if level == LEVELS or not n or open_rows.isEmpty():
            break
        # but each of these nodes branches by its own choices: a pair has as many chances as it met in nodes
        names = every.filter(F.col("n") > SMALL).select("node", F.min("node").over(Window.partitionBy("n", "h")).alias("first"))
        names = stored(names, "names")
        open_rows = open_rows.withColumnRenamed("node", "first").join(small_side(names, names.count()), "first").select("node", "id", "sig")
        nodes = stored(shared_nodes(branch(open_rows, level + 1)), "nodes")

    if comp is None:
        return links, nodes.sparkSession.createDataFrame([], "id bigint, component bigint")
    found = links.limit(0)
    for rows in small_nodes:
        rows = labelled(rows, comp).select("node", "id", "sig", "comp").repartition("node").sortWithinPartitions("node", "id")
        rows = stored(rows.mapInArrow(_partners(items.read_signatures, items.cut), "node bigint, id bigint, comp bigint"), "partners")
        if not rows.isEmpty():
            rows = with_sets(rows, items).select("node", "id", "comp", "data").repartition("node").sortWithinPartitions("node", "id")
            found = found.unionByName(rows.mapInArrow(_exact_links(items.read_set, items.percent), PAIRS))
    for rows in waiting:
        rows = stored(labelled(rows, comp), "waiting")
        top, n = by_component(rows)
        rows = rows.join(small_side(top, n), "node")
        rows = rows.withColumn("blocks", F.ceil(F.col("outside") / SMALL).cast("int"))
        probes = rows.filter("comp <> main").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int"))
        found = found.unionByName(probe(rows, probes, items, False))
    found = stored(found, "later")
    if not found.isEmpty():
        links = links.unionByName(found)
        comp = stored(components(links), "components")
    return links, comp


def fold(*parts: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash of several arrays of integers."""
    out = np.zeros(len(parts[-1]), U64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix(out * U64(0x9E3779B97F4A7C15) + np.asarray(p).astype(U64))
    return out.view(np.int64)
