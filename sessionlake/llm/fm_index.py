"""A compressed full-text index over word ids: Burrows-Wheeler text in a wavelet matrix.

`FMIndex` answers backward steps (prepend a word to a pattern) for many patterns at once. Rows are
sorted by their first ``window`` words, which is all that patterns of up to that length need: the rows
that begin with a pattern of at most window - 1 words lie together, and so do those with one more word
before it.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class WaveletMatrix:
    """Rank queries on a sequence of small integers, a bit vector for each binary digit."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        v = values
        for level in range(self.levels - 1, -1, -1):
            one = (v >> level & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.append(packed, np.zeros(8 + -len(packed) % 8, np.uint8)).view(U64)
            self.bits.append(packed)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(packed).astype(np.int64)))[:-1])
            self.zeros.append(int(len(v) - one.sum()))
            v = np.concatenate([v[~one], v[one]])
        # where each symbol's run begins after the last digit
        self.begin = np.zeros(symbols, np.int64)
        present = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        self.begin[v[present]] = present

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        e = end
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            word = e >> 6
            mask = (U64(1) << (e & 63).astype(U64)) - U64(1)
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & mask).astype(np.int64)
            e = np.where(one, self.zeros[k] + ones, e - ones)
        return e - self.begin[symbol]


class FMIndex:
    """Index of texts laid end to end, each followed by symbol 0; ``owner`` gives each place's number."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, window: int):
        self.window, n = window, len(text)
        symbols = int(text.max(initial=0)) + 1
        padded = np.append(text, np.zeros(window, text.dtype)).astype(np.int64)
        rank, length = padded, 1
        while 2 * length <= window - 1:  # ranks of the first 2, 4, 8 ... words
            pair = rank * (int(rank.max()) + 1) + np.append(rank[length:], np.zeros(length, np.int64))
            _, rank = np.unique(pair, return_inverse=True)
            length *= 2
        head, tail, tail_less = rank[:n], rank[window - length :][:n], rank[window - 1 - length :][:n]
        order = np.lexsort((tail, head))
        head, tail, tail_less = head[order], tail[order], tail_less[order]
        new_less = np.append(True, (head[1:] != head[:-1]) | (tail_less[1:] != tail_less[:-1]))
        new = new_less | np.append(True, tail[1:] != tail[:-1])
        first = np.flatnonzero(new)
        #: for each row, the smallest owner among the rows that share its first window words
        self.least = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.append(first, n)))
        first = np.flatnonzero(new_less)
        size = np.diff(np.append(first, n))
        #: for each row, the rows that share its first window - 1 words
        self.low, self.high = np.repeat(first, size), np.repeat(first + size, size)
        self.matrix = WaveletMatrix(text[order - 1].astype(np.int64), symbols)
        self.count = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))
        self.n = n

    def least_owners(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each text that is in the index: the smallest owner of an equal window.

        All texts are streamed together from their last words to their first. A match that has
        grown to the window's length is reported and loses its last word.
        """
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        out = [np.zeros(max(0, len(t) - self.window + 1), np.int64) for t in texts]
        if not len(order) or size[order[0]] < self.window:
            return out
        ends = np.cumsum(size[order])
        flat = np.concatenate([texts[i] for i in order])
        grid = np.full((len(order), len(texts[order[0]]) - self.window + 1), -1, np.int64)
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.n)
        for step in range(1, int(size.max()) + 1):
            live = int(np.searchsorted(-size[order], -step, side="right"))
            c = flat[ends[:live] - step]
            both = self.matrix.rank(np.append(c, c), np.append(low[:live], high[:live]))
            low[:live], high[:live] = self.count[c] + both[:live], self.count[c] + both[live:]
            if (low[:live] >= high[:live]).any():
                raise ValueError("a streamed text is not in the index")
            if step >= self.window:
                at = size[order[:live]] - step
                row = low[:live]
                grid[np.arange(live), at] = self.least[row]
                low[:live], high[:live] = self.low[row], self.high[row]
        for k, i in enumerate(order):
            out[i] = grid[k, : len(out[i])]
        return out
