"""A compressed full-text index over sequences of words: a wavelet matrix over the Burrows-Wheeler transform.

Built and searched in numpy, many searches at a time. A word is any 64-bit number. The suffix array is dropped once
the transform is made; what stays takes 1.5 bits for each word and level, and a bit for each word.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """Packed bits with counts before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self._count(words)

    def _count(self, words: np.ndarray) -> None:
        self.words = words
        small = len(words) < 2**25
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32 if small else np.int64)

    def __and__(self, other: Bits) -> Bits:
        return Bits._of(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits._of(self.words | other.words)

    @staticmethod
    def _of(words: np.ndarray) -> Bits:
        bits = Bits.__new__(Bits)
        bits._count(words)
        return bits

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word = at >> 6
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def places(self) -> np.ndarray:
        """Where bits are set, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            one = ((symbols >> level) & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(int(len(one) - one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a place goes if it follows the bits of a symbol; two places' difference is the symbol's number between them."""
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        pair = rank * (n + 1) + behind
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if step >= n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class Index:
    """An index over texts, each an array of words. heavy[i]: text i stands for several equal ones."""

    def __init__(self, texts: list[np.ndarray], heavy: np.ndarray):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.words, ids = np.unique(np.concatenate([*texts, np.zeros(0, np.uint64)]), return_inverse=True)
        # each text ends in an end mark of its own, smaller than all words
        m, n = len(texts), int(lengths.sum()) + len(texts)
        ends = np.cumsum(lengths + 1) - 1
        symbols = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[ends] = np.arange(m)
        symbols[inside] = ids + m
        order = suffix_array(symbols)
        # all end marks are one symbol to the transform, as no search passes them
        symbols = np.maximum(symbols - m + 1, 0)
        last = symbols[order - 1]
        self.size = n
        self.heavy = Bits(np.repeat(np.asarray(heavy, bool), lengths + 1)[order])
        alphabet = len(self.words) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])[:-1]
        self.matrix = WaveletMatrix(last, alphabet)
        self.base = self.matrix.down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        """The index's numbers of words; 0 for words it does not have."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        return np.where(self.words[at] == words, at + 1, 0) if len(self.words) else np.zeros(len(words), np.int64)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of a pattern with one symbol more in front of it."""
        n = len(symbol)
        both = self.matrix.down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.starts[symbol] - self.base[symbol]
        low, high = both[:n] + shift, both[n:] + shift
        return low, np.where(symbol > 0, high, low)

    def recurs(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether an interval stands for two places or more."""
        return (high - low >= 2) | (self.heavy.rank(high) - self.heavy.rank(low) > 0)

    def backward(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each pattern symbols[first:last] the start of its longest suffix that recurs (last, if none does)."""
        at, low, high = last.copy(), np.zeros(len(last), np.int64), np.full(len(last), self.size)
        live = np.flatnonzero(at > first)
        while len(live):
            a, b = self.extend(symbols[at[live] - 1], low[live], high[live])
            good = self.recurs(a, b)
            live, a, b = live[good], a[good], b[good]
            low[live], high[live] = a, b
            at[live] -= 1
            live = live[at[live] > first[live]]
        return at

    def recurring(self, texts: list[np.ndarray], least: int) -> list[np.ndarray]:
        """For each streamed text, which of its windows of least words recur (len(text) - least + 1 booleans).

        The longest recurring suffix of a text is found first: matching statistics of all its places at once. Windows
        before it are searched from the left: what breaks a match from the right excludes all windows that hold it, and
        a window that recurs is made as long as it goes.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        symbols = self.symbols_of(np.concatenate([*texts, np.zeros(0, np.uint64)]))
        found = np.zeros(len(symbols) + 1, np.int32)  # +1 where a run of recurring windows begins, -1 behind it
        enough = np.flatnonzero(lengths >= least)
        at = self.backward(symbols, starts[enough], ends[enough])
        whole = ends[enough] - at >= least
        np.add.at(found, at[whole], 1)
        np.add.at(found, ends[enough][whole] - least + 1, -1)
        place, until = starts[enough].copy(), np.minimum(at - 1, ends[enough] - least - 1)
        live = np.flatnonzero(place <= until)
        while len(live):
            here = place[live]
            broke = self.backward(symbols, here, here + least)
            hit = broke == here
            place[live] = broke
            run, here = live[hit], here[hit]
            # how far a match from here reaches, by halving; one that reaches too far breaks early
            low, high = here + least, until[run] + least + 1
            tried = high - 1
            while len(open_ends := np.flatnonzero(low + 1 < high)):
                reach = self.backward(symbols, here[open_ends], tried[open_ends]) == here[open_ends]
                low[open_ends] = np.where(reach, tried[open_ends], low[open_ends])
                high[open_ends] = np.where(reach, high[open_ends], tried[open_ends])
                tried = (low + high) // 2
            np.add.at(found, here, 1)
            np.add.at(found, low - least + 1, -1)
            place[run] = low - least + 1
            live = live[place[live] <= until[live]]
        recur = np.cumsum(found)[:-1] > 0
        return [recur[s : max(s, e - least + 1)] for s, e in zip(starts, ends)]
