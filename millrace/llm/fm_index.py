"""A compressed FM-index over words, queried for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols: one bit vector for each bit of a symbol, packed in 64-bit words with running counts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit) & 1
            padded = np.zeros(-(-(len(ones) + 1) // 64) * 64, dtype=np.uint8)
            padded[: len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((packed, before, int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        every = np.arange(1 << bits)
        self.start = self._walked(every, np.zeros_like(every))  # where each symbol's places begin on the last level

    def _walked(self, symbol: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The places, followed through all levels along each symbol's bits; places may have several rows."""
        bits = len(self.levels)
        for k, (packed, before, zeros) in enumerate(self.levels):
            one = ((symbol >> (bits - 1 - k)) & 1).astype(bool)
            word = places >> 6
            mask = (np.uint64(1) << (places & 63).view(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & mask)
            places = np.where(one, zeros + ones, places - ones)
        return places

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before low and before high."""
        low, high = self._walked(symbol, np.stack([low, high])) - self.start[symbol]
        return low, high


class FMIndex:
    """Counts patterns of up to `depth` symbols in a text of symbols from 0 on.

    The text ends with 0, which no pattern holds: it stands before the text's start in the transform.
    Suffixes are sorted by their first `depth` symbols; the order of those that agree so far does not
    matter to a backward search of that length.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        if n and text[-1]:
            raise ValueError("the text must end with 0")
        rank, length = text.astype(np.int64), 1
        order = np.argsort(rank)
        while length < depth:
            after = np.full(n, -1, dtype=np.int64)
            after[: n - length] = rank[length:] if length < n else after[:0]
            key = rank * (n + 1) + after + 1
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank, length = new, 2 * length
            if rank.max(initial=0) == n - 1:
                break
        self.size = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.ranks = WaveletMatrix(text[order - 1], max(1, int(text.max(initial=0)).bit_length()))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of each symbol put before its pattern's rows [low, high)."""
        a, b = self.ranks.rank(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b


def repeated_spans(index: FMIndex, text: np.ndarray, begins: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) window of each segment that occurs twice or more in the index, or (-1, -1).

    Segment i has counts[i] windows of `width` symbols, the first at begins[i] in text. All segments are
    streamed side by side. A backward search from a window's end that stops at j shows that no window
    from its own start up to j repeats, since all of them hold what was just searched for; so the first
    one is sought rightwards with jumps, and the last one leftwards from the end.
    """
    first = np.full(len(begins), -1, dtype=np.int64)
    last = first.copy()
    for out, forward in ((first, True), (last, False)):
        lane = np.arange(len(begins)) if forward else np.flatnonzero(first >= 0)
        start = np.zeros(len(lane), dtype=np.int64) if forward else counts[lane] - 1
        at = start + width - 1
        low, high = np.zeros(len(lane), dtype=np.int64), np.full(len(lane), index.size, dtype=np.int64)
        while len(lane):
            low, high = index.extend(text[begins[lane] + at], low, high)
            lost = high - low < 2
            found = ~lost & (at == start)
            out[lane[found]] = start[found]
            start = np.where(lost, at + 1 if forward else start - 1, start)
            low, high = np.where(lost, 0, low), np.where(lost, index.size, high)
            at = np.where(lost, start + width - 1, at - 1)
            live = ~found & (start < counts[lane]) & (start >= 0)
            lane, start, at, low, high = lane[live], start[live], at[live], low[live], high[live]
    return first, last
