"""Vectorised text helpers that run inside Spark tasks.

Texts arrive as Arrow string arrays. The helpers look at the UTF-8 bytes of a
bounded run of documents at a time (`CHUNK_BYTES`, or one document if it alone is
longer) and give word boundaries and 64-bit hashes as numpy arrays, so no Python
string is made per word. Null texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64


def _malloc(large: int, kept: int) -> None:
    """Freed arrays of ``large`` bytes go back at once, smaller ones when more than ``kept`` bytes are free in a row."""
    import ctypes

    try:
        ctypes.CDLL(None).mallopt(-3, large)  # M_MMAP_THRESHOLD, which otherwise grows with what is freed
        ctypes.CDLL(None).mallopt(-1, kept)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # not glibc
        pass


def keep_room(large: int = 32 << 20, kept: int = 64 << 20) -> None:
    """For modules whose arrays come and go for every few texts: the system's zeroed pages cost more than the work on them."""
    _malloc(large, kept)


def give_back() -> None:
    """Return all free memory to the system, at the end of a task whose arrays `keep_room` kept for the next texts."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


pa.set_memory_pool(pa.system_memory_pool())
_malloc(2 << 20, 128 << 10)  # a Python worker outlives its tasks

#: A-Z to a-z, every other byte unchanged (UTF-8 continuation bytes are over 0x7F).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of the word pattern ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SHINGLE_BASE = U64(0xD6E8FEB86659FD93)

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (so equal stays equal, distinct stays distinct)."""
    x = np.asarray(x, U64)
    if x.ndim == 0:
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))
    out = x >> U64(30)  # in two arrays, as new ones cost more than the work on them
    out ^= x
    out *= U64(0xBF58476D1CE4E5B9)
    other = out >> U64(27)
    out ^= other
    out *= U64(0x94D049BB133111EB)
    np.right_shift(out, U64(31), out=other)
    out ^= other
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((BASE, BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``out[i]``: hash sum of the first i bytes; ranges come out with `range_hash`."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_KEYS[data] * up[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end); equal contents give equal hashes anywhere."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * BASE)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets into them; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges [a, b) of at most ``limit`` bytes, or of one longer document."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


@dataclass
class Words:
    """The words of a run of documents: byte ranges, and each document's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n_docs + 1 offsets into the words

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_hash(self.data), self.start, self.end)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the documents at ``offsets``; none spans two documents."""
    inside = ~IS_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        starts[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def word_runs(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """`Words` for run after run of the documents: (first document, end document, words)."""
    data, offsets = utf8(texts)
    for a, b in runs(offsets):
        part = data[offsets[a] : offsets[b]]
        yield a, b, words(LOWER[part] if lower else part, offsets[a : b + 1] - offsets[a])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive word hashes (length n - size + 1, or 0)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * SHINGLE_BASE + hashes[k : k + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one document; with fewer words the whole sequence is one."""
    if len(hashes) == 0:
        return np.zeros(0, U64)
    return np.unique(shingles(hashes, min(size, len(hashes))))


def minhash(sets: np.ndarray, first: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` 32-bit minwise values of each set; sets lie end to end in ``sets`` at ``first`` (none empty)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    flip, times = (rng.integers(0, 1 << 31, count, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
    out = np.empty((len(first), count), np.uint32)
    if len(first) == 0:
        return out
    base = (sets >> U64(32)).astype(np.uint32)  # the sets' values are well mixed
    own = np.empty_like(base)
    for k in range(count):
        np.bitwise_xor(base, flip[k], out=own)
        np.multiply(own, times[k], out=own)
        out[:, k] = np.minimum.reduceat(own, first)
    return out


def hex64(x: int) -> int:
    """An unsigned 64-bit value as Spark's signed long."""
    x = int(x)
    return x - (1 << 64) if x >= 1 << 63 else x
