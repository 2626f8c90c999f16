"""An FM-index over integer words, vectorised over many patterns at once.

The text is an array of word numbers from 1 on; 0 is a separator that no pattern holds, and ends the text.
Suffixes are sorted by prefix doubling, in which only rows that still tie are sorted again; a separator sorts by
its position, so no comparison reaches into the next piece of text. The Burrows-Wheeler transform is held as a
wavelet matrix over bit vectors with sampled ranks. Locating walks back by the LF mapping to rows whose positions
were sampled: every few positions, and all that stand behind a separator.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank in constant time: packed 64-bit words and counts before each."""

    __slots__ = ("words", "before", "n")

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of symbols in a sequence over 0 .. sigma-1, one bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        self.levels, self.zeros = [], []
        self.height = max(1, int(sigma - 1).bit_length())
        held = sequence.astype(np.int32, copy=False)
        for shift in range(self.height - 1, -1, -1):
            bit = (held >> shift) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            held = np.concatenate((held[~bit], held[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros_like(at), at
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.height - 1 - level)) & 1 == 1
            a, b = bits.rank(start), bits.rank(end)
            start = np.where(one, zeros + a, start - a)
            end = np.where(one, zeros + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at) == 1
            a, b = bits.rank(start), bits.rank(at)
            symbol = symbol * 2 + one
            start = np.where(one, zeros + a, start - a)
            at = np.where(one, zeros + b, at - b)
        return symbol, at - start


#: Positions take so many bits of a packed sort key; an index holds fewer words than MOST.
BITS = 21
MOST = 1 << BITS


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Positions in the order of their suffixes; text ends with 0."""
    n = len(text)
    assert n < MOST and text[-1] == 0
    at = np.arange(n, dtype=np.uint64)
    width = max(1, int(sigma - 1).bit_length())
    length = max(1, (63 - BITS) // width)
    key, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(length):
        word = np.zeros(n, np.uint64)
        word[: max(0, n - k)] = text[k:]
        word[ended] = 0
        ended |= word == 0
        key = (key << np.uint64(width)) | word
    held = np.sort((key << np.uint64(BITS)) | at)
    order = (held & np.uint64(MOST - 1)).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (held[1:] >> np.uint64(BITS)) != (held[:-1] >> np.uint64(BITS))
    new |= ended[order]
    rank = np.empty(n, np.int64)
    while True:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = first
        alone = new & np.append(new[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return order
        held = order[rows]
        key = (rank[held].astype(np.uint64) << np.uint64(2 * BITS)) | (rank[held + length].astype(np.uint64) << np.uint64(BITS)) | held.astype(np.uint64)
        key.sort()
        order[rows] = (key & np.uint64(MOST - 1)).astype(np.int64)
        new[rows[1:]] |= (key[1:] >> np.uint64(BITS)) != (key[:-1] >> np.uint64(BITS))
        length *= 2


class FMIndex:
    """Count and locate patterns of words."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8) -> None:
        self.n, self.sigma = len(text), sigma
        order = suffix_order(text, sigma)
        last = text[order - 1]  # the first position is preceded by the separator at the end
        self.bwt = WaveletMatrix(last, sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))).astype(np.int64)
        kept = (order % sample == 0) | (last == 0)
        self.sampled, self.positions = Bits(kept), order[kept].astype(np.int32)

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of each pattern, by backward search; patterns is (n, width), aligned to the right."""
        n, width = patterns.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        live = np.arange(n)
        for back in range(1, width + 1):
            live = live[(lengths[live] >= back) & (hi[live] > lo[live])]
            if not len(live):
                break
            symbol = patterns[live, width - back].astype(np.int64)
            if back == 1:
                lo[live], hi[live] = self.first[symbol], self.first[symbol + 1]
                continue
            both = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((lo[live], hi[live])))
            lo[live] = self.first[symbol] + both[: len(live)]
            hi[live] = self.first[symbol] + both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.sampled.get(here) == 1
            out[open_[done]] = self.positions[self.sampled.rank(here[done])] + steps[open_[done]]
            open_, here = open_[~done], here[~done]
            symbol, rank = self.bwt.access(here)
            rows[open_] = self.first[symbol] + rank
            steps[open_] += 1
        return out

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every row of the ranges."""
        size = hi - lo
        pattern = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(len(pattern)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        return pattern, self.locate(rows)
