"""An FM-index over integer symbols: suffix array, wavelet matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 32


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class Bits:
    """Bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = places >> 6
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of a sequence of positive symbols, where 0 marks breaks that no phrase spans."""

    def __init__(self, symbols: np.ndarray):
        text = np.concatenate((symbols.astype(np.int64) + 1, [0]))
        self.n = len(text)
        order = suffix_array(text)
        self.last = text[order - 1]
        counts = np.bincount(text)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.levels: list[tuple[int, Bits, int]] = []
        current = self.last
        for level in range(int(text.max()).bit_length() - 1, -1, -1):
            bit = ((current >> level) & 1).astype(np.uint8)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            current = np.concatenate((current[bit == 0], current[bit == 1]))
        sampled = order % SAMPLE == 0
        self.sampled = Bits(sampled)
        self.is_sampled = sampled
        self.samples = order[sampled]

    def _rank(self, symbol: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the last column before each place."""
        start = np.zeros_like(places)
        for level, bits, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            ones_start, ones = bits.rank(start), bits.rank(places)
            start = np.where(one, zeros + ones_start, start - ones_start)
            places = np.where(one, zeros + ones, places - ones)
        return places - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (one a row): their intervals of suffixes."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for symbols in phrases.T[::-1]:
            symbol = symbols[live].astype(np.int64) + 1
            known = symbol < len(self.first) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.first[symbol] + self._rank(symbol, low[live])
            high[live] = self.first[symbol] + self._rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: step back to a sampled one."""
        places, steps = rows.copy(), np.zeros_like(rows)
        open_ = np.flatnonzero(~self.is_sampled[places])
        while len(open_):
            symbol = self.last[places[open_]]
            places[open_] = self.first[symbol] + self._rank(symbol, places[open_])
            steps[open_] += 1
            open_ = open_[~self.is_sampled[places[open_]]]
        return self.samples[self.sampled.rank(places)] + steps
