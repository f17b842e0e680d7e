"""Elias-Fano sequences and an n-gram trie over them, in one flat buffer that can be memory-mapped."""

from __future__ import annotations

import mmap

import numpy as np

_ONE = np.uint64(1)
_SIX = np.uint64(6)


def _pack_low(low: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width integers packed into 64-bit words, one word of slack at the end."""
    words = np.zeros(len(low) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(low), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> _SIX).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, low << shift)
        spill = shift + np.uint64(width) > 64
        np.bitwise_or.at(words, word[spill] + 1, low[spill] >> (np.uint64(64) - shift[spill]))
    return words


def _nth_one(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where the n-th set bit (from 0) of each word stands; 64 if there is none."""
    left, at = n.copy(), np.zeros(len(words), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        chunk = (words >> at.astype(np.uint64)) & ((_ONE << np.uint64(step)) - _ONE)
        count = np.bitwise_count(chunk).astype(np.int64)
        skip = count <= left
        left -= np.where(skip, count, 0)
        at += np.where(skip, step, 0)
    return at


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, with counts per word for selection."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (int(universe) // max(1, n)).bit_length() - 1)
        high = values >> np.uint64(width)
        top = int(high[-1]) if n else 0
        bits = np.zeros(((n + top + 1) // 64 + 1) * 64, np.uint8)
        bits[high.astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))]).astype(np.int64)
        return cls(n, width, _pack_low(values & ((_ONE << np.uint64(width)) - _ONE), width), words, zeros)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> _SIX).astype(np.int64), at & np.uint64(63)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | rest) & ((_ONE << np.uint64(self.width)) - _ONE)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        i = i.astype(np.int64)
        before = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros  # ones before each word
        word = np.minimum(np.searchsorted(before, i, side="right") - 1, len(self.high) - 1)
        bit = _nth_one(self.high[word], i - before[word])
        high = (word * 64 + bit - i).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._lows(i)

    def _before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many ones stand before the k-th zero (from 0): the values whose high part is at most k."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        inside = np.minimum(word, len(self.high) - 1)
        at = _nth_one(~self.high[inside], (k - self.zeros[inside]).astype(np.int64))
        return np.minimum(inside * 64 + at - k, self.n)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each x the index of the first value not under it, and whether that value equals x.

        With bounds, only places from ``first`` up to but not including ``last`` are looked at.
        """
        x = x.astype(np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top = (x >> np.uint64(self.width)).astype(np.int64)
        limit = int(self.zeros[-1])
        beyond = top >= limit
        top = np.minimum(top, limit - 1)
        end = self._before_zero(top)
        start = np.where(top > 0, self._before_zero(np.maximum(top - 1, 0)), 0)
        if first is not None:
            start, end = np.maximum(start, first), np.minimum(end, last)
        want = x & ((_ONE << np.uint64(self.width)) - _ONE)
        lo, hi = start.copy(), end.copy()
        while True:
            going = np.flatnonzero(lo < hi)
            if not len(going):
                break
            mid = (lo[going] + hi[going]) >> 1
            less = self._lows(mid) < want[going]
            lo[going[less]] = mid[less] + 1
            hi[going[~less]] = mid[~less]
        hit = (lo < end) & ~beyond
        at = np.flatnonzero(hit)
        hit[at] = self._lows(lo[at]) == want[at]
        return np.where(beyond, self.n, lo), hit

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.zeros]


class BigramTrie:
    """Levels of one shard: words with quantised probabilities and counts, their pointers, contexts, quantised gains.

    The pointers bound each word's contexts in the level below. A context is known by its rank among the shard's
    contexts; rank plus word number times their count is increasing over the whole level, so one Elias-Fano sequence
    holds it, and a successor search between a word's pointers finds a context. ``codes`` are gains in steps of
    1 / STEPS of log10, ``alone`` are log10 probabilities of the words by themselves in steps of 1 / FINE under 0;
    ``unigram`` holds the words' counts, for whoever wants those.
    """

    STEPS, FINE = 256, 2048

    def __init__(self, arrays: list[np.ndarray]):
        self.raw = arrays
        parts = [EliasFano(int(arrays[i][0]), int(arrays[i][1]), *arrays[i + 1 : i + 4]) for i in (0, 4, 8, 12)]
        self.words, self.contexts, self.pointers, self.level = parts
        self.unigram, self.alone, self.codes = arrays[16], arrays[17], arrays[18]

    @classmethod
    def quantised(cls, log10: np.ndarray) -> np.ndarray:
        return np.minimum(np.rint(-log10 * cls.FINE), 65535).astype(np.uint16)

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, of_word: np.ndarray, context: np.ndarray, gains: np.ndarray, alone: np.ndarray) -> BigramTrie:
        """``words`` sorted, with counts and log10 probabilities; entries sorted by (word number, context), with log10 gains."""
        known, rank = np.unique(context, return_inverse=True)
        span = max(1, len(known))
        sizes = np.bincount(of_word, minlength=len(words))
        pointers = np.concatenate([[0], np.cumsum(sizes)])
        level = of_word.astype(np.uint64) * np.uint64(span) + rank.astype(np.uint64)
        codes = np.minimum(np.rint(gains * cls.STEPS), 65535).astype(np.uint16)
        sequences = [
            EliasFano.build(words, 1 << 64),
            EliasFano.build(known, 1 << 40),
            EliasFano.build(pointers, len(level) + 1),
            EliasFano.build(level, max(1, len(words)) * span),
        ]
        return cls([a for s in sequences for a in s.arrays()] + [counts.astype(np.int64), cls.quantised(alone), codes])

    def word(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of each word."""
        at, hit = self.words.successor(words)
        number = np.where(hit, at, -1)
        count = self.unigram[np.minimum(at, max(0, len(self.unigram) - 1))] if len(self.unigram) else np.zeros(len(at), np.int64)
        return number, np.where(hit, count, 0)

    def gain(self, number: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The code of the gain of each (word number, context) over the word alone; 0 where it was never seen."""
        at, hit = self.contexts.successor(context)
        out = np.zeros(len(number), np.uint16)
        ask = np.flatnonzero(hit & (number >= 0))
        if not len(ask):
            return out
        asked, of_ask = np.unique(number[ask], return_inverse=True)
        base = number[ask].astype(np.uint64) * np.uint64(max(1, self.contexts.n))
        first, last = self.pointers.get(asked).astype(np.int64), self.pointers.get(asked + 1).astype(np.int64)
        where, found = self.level.successor(base + at[ask].astype(np.uint64), first[of_ask], last[of_ask])
        out[ask[found]] = self.codes[where[found]]
        return out

    def to_bytes(self) -> bytes:
        """A header of types and sizes, then every array at a multiple of eight bytes."""
        kinds = {"i8": 0, "u8": 1, "u2": 2}
        head = np.array([[kinds[a.dtype.str[1:]], len(a)] for a in self.raw], np.int64)
        body = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in self.raw)
        return np.int64(len(head)).tobytes() + head.tobytes() + body

    @classmethod
    def from_buffer(cls, buffer) -> BigramTrie:
        """Views into a buffer or a memory map; nothing is copied."""
        n = int(np.frombuffer(buffer, np.int64, 1)[0])
        head = np.frombuffer(buffer, np.int64, 2 * n, 8).reshape(n, 2)
        at, arrays = 8 + 16 * n, []
        for kind, size in head.tolist():
            dtype = (np.int64, np.uint64, np.uint16)[kind]
            arrays.append(np.frombuffer(buffer, dtype, size, at))
            at += -(-size * np.dtype(dtype).itemsize // 8) * 8
        return cls(arrays)

    @classmethod
    def mapped(cls, data: bytes) -> BigramTrie:
        """The trie in an anonymous memory map of its own, outside the interpreter's heap."""
        region = mmap.mmap(-1, max(1, len(data)))
        region[: len(data)] = data
        return cls.from_buffer(region)

    @classmethod
    def open(cls, path: str) -> BigramTrie:
        return cls.from_buffer(np.memmap(path, np.uint8, "r"))
