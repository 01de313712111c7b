"""An FM-index over integer words: Burrows-Wheeler transform in a wavelet matrix
(a wavelet tree without pointers) with packed bits and block counts, searched
backwards for many patterns in step. Beside it lies a sparse table of the owners
of all suffixes, so that a search can ask for the least owner of its interval."""

from __future__ import annotations

import numpy as np

#: Searches that go on at a time.
SEARCHES = 200_000


class _Bits:
    """Packed bits with the number of ones before each 64-bit block."""

    def __init__(self, bits: np.ndarray) -> None:
        size = len(bits) // 64 + 1
        packed = np.zeros(size * 8, np.uint8)
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.blocks = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int32)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask).astype(np.int32)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; text must end in a symbol that occurs once."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(text), 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        if new[order[-1]] == n - 1:
            return order
        rank, k = new, k * 2


class FmIndex:
    """Over texts that lie one after the other in words; sizes gives their
    lengths, owners a number for each."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, owners: np.ndarray) -> None:
        count = len(sizes)
        ends = np.cumsum(sizes)
        self.alphabet, code = np.unique(words, return_inverse=True)
        # Every text ends in a symbol of its own, below all words.
        text = np.insert(code + count, ends, np.arange(count))
        of = np.repeat(np.arange(count), sizes + 1)
        order = suffix_array(text)
        last = text[order - 1]
        self.size = len(text)
        self.below = np.searchsorted(text[order], np.arange(len(self.alphabet) + count))
        self.levels: list[tuple[int, _Bits]] = []
        for shift in range(int(last.max()).bit_length() - 1, -1, -1):
            bit = (last >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(bit)))
            last = np.concatenate([last[~bit], last[bit]])
        # Where each symbol's run begins at the bottom of the matrix.
        self.bottom = self._down(np.arange(len(self.below)), np.zeros(len(self.below), np.int64))
        table = [owners[of[order]]]
        while 2 << len(table) - 1 <= self.size:
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.least = table
        self.count = count

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The symbols of words that the index holds."""
        return np.searchsorted(self.alphabet, words) + self.count

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> shift & 1, bits.zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put in front."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([start, end]))
        base = self.below[symbol] - self.bottom[symbol]
        return both[: len(symbol)] + base, both[len(symbol) :] + base

    def least_owner(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least owner in each interval, none of them empty."""
        level = np.frexp(end - start)[1] - 1
        out = np.empty(len(start), self.least[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][start[at]], self.least[k][end[at] - (1 << int(k))])
        return out

    def match_back(self, symbols: np.ndarray, end: np.ndarray, floor: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each pattern, that ends before place end of symbols: the first place
        from which it still occurs in a text whose owner is below limit, no
        further to the front than floor. These are the matching statistics."""
        found = end.copy()
        live = np.flatnonzero(end > floor)
        start, stop = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        while len(live):
            start, stop = self.extend(symbols[found[live] - 1], start, stop)
            keep = start < stop
            keep[keep] = self.least_owner(start[keep], stop[keep]) < limit[live[keep]]
            live, start, stop = live[keep], start[keep], stop[keep]
            found[live] -= 1
            more = found[live] > floor[live]
            live, start, stop = live[more], start[more], stop[more]
        return found


def covered(index: FmIndex, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, limit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (text, from, to) of each pattern: runs of its windows of `window`
    words that are found in a text whose owner is below the pattern's limit.

    The searches of all windows go back in step, in blocks. Most end after a few
    words; a search that skips ahead saves steps but leaves single patterns with
    long chains of short array operations, which cost more."""
    texts, begins, stops = [], [], []
    windows = np.maximum(size - window + 1, 0)
    for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(windows) // SEARCHES)) + 1):
        of = np.repeat(part, windows[part])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(windows[part]) - windows[part], windows[part])
        ends = first[of] + nth + window
        hit = np.flatnonzero(index.match_back(symbols, ends, ends - window, limit[of]) <= ends - window)
        # Hits one after the other in one pattern are one interval.
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > 1) | (np.diff(of[hit]) > 0)
        last = np.append(new[1:], True)[: len(hit)]
        texts.append(of[hit[new]])
        begins.append(nth[hit[new]])
        stops.append(nth[hit[last]] + window)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (texts, begins, stops))
