"""Elias-Fano sequences and an n-gram trie of two levels, laid out in one run of bytes.

A monotone sequence of n numbers below u keeps the low ``log2(u / n)`` bits of each packed, and the high
bits as unary gaps: about ``2 + log2(u / n)`` bits a number. A search jumps to the numbers that share
the high bits of the wanted one and bisects their low bits.
"""

from __future__ import annotations

import mmap

import numpy as np

_POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
#: For a byte and k: the place of its k-th one (8 if there are fewer).
_SELECT = np.full((256, 8), 8, np.int64)
for _byte in range(256):
    _ones = [b for b in range(8) if _byte >> b & 1]
    _SELECT[_byte, : len(_ones)] = _ones


class EliasFano:
    """A monotone sequence as arrays that may lie in mapped memory."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray) -> None:
        self.n, self.low, self.lows, self.highs = n, low, lows.view(np.uint64), highs
        # Ones and zeros before each byte of the high part: the directory for both selections.
        self.ones = np.concatenate(([0], np.cumsum(_POPCOUNT[highs])))
        self.zeros = 8 * np.arange(len(self.ones)) - self.ones

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> list[np.ndarray]:
        """Header, low bits and high bits of a monotone sequence of int64 below ``universe``."""
        n = len(values)
        low = min(56, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))  # read as one shifted word
        high = np.zeros(n + (universe >> low) + 2, np.uint8)
        high[(values >> low) + np.arange(n)] = 1
        chunks = [((values[i : i + 65_536, None] >> np.arange(low)) & 1).astype(np.uint8) for i in range(0, n, 65_536)]
        lows = np.concatenate([np.empty(0, np.uint8), *(np.packbits(c.ravel(), bitorder="little") for c in chunks)])
        highs = np.packbits(high, bitorder="little")
        return [np.array([n, low], np.int64), np.pad(lows, (0, 16 - len(lows) % 8)), highs]

    def _low(self, at: np.ndarray) -> np.ndarray:
        """Low parts of the numbers at some places."""
        if not self.low:
            return np.zeros(len(at), np.int64)
        bit = at * self.low
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        # The second shift goes in two steps, as a shift by 64 is none.
        both = (self.lows[word] >> shift) | ((self.lows[word + 1] << (np.uint64(63) - shift)) << np.uint64(1))
        return (both & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def _select(self, count: np.ndarray, k: np.ndarray, zero: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero among the high bits."""
        byte = np.searchsorted(count, k, "right") - 1
        byte = np.minimum(byte, len(self.highs) - 1)
        value = self.highs[byte] ^ np.uint8(255) if zero else self.highs[byte]
        return 8 * byte + _SELECT[value, np.minimum(k - count[byte], 7)]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(self.ones, at, False) - at) << self.low) | self._low(at)

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Place of the first number that is not below the wanted one (n if there is none)."""
        high = wanted >> self.low
        top = (8 * len(self.highs)) - int(self.ones[-1]) - 1
        first = np.where(high > 0, self._select(self.zeros, np.clip(high - 1, 0, top), True) - np.maximum(high - 1, 0), 0)
        last = self._select(self.zeros, np.minimum(high, top), True) - np.minimum(high, top)
        first, last = np.minimum(first, self.n), np.minimum(last, self.n)
        below = wanted & ((1 << self.low) - 1)
        while (open_ := first < last).any():
            middle = (first + last) >> 1
            less = open_ & (self._low(np.minimum(middle, max(0, self.n - 1))) < below)
            first = np.where(less, middle + 1, first)
            last = np.where(open_ & ~less, middle, last)
        return first

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of a number, or -1."""
        if not self.n:
            return np.full(len(wanted), -1)
        at = self.successor(wanted)
        held = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self[held] == wanted), at, -1)


class Trie:
    """Contexts, and for each its successors with quantised values.

    Levels: the distinct words and the distinct contexts (Elias-Fano); a monotone pointer from each context to
    its successors (Elias-Fano); the successors, each as rank of its word among the distinct words, made monotone
    over the whole level by the number of its context (Elias-Fano); a value for each successor and context.
    """

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, values: np.ndarray, backoffs: np.ndarray) -> bytes:
        """From n-grams sorted by (context, word), both int64; ``backoffs`` has one number for each distinct context."""
        context_of = np.concatenate(([True], contexts[1:] != contexts[:-1]))[: len(contexts)]
        distinct = contexts[context_of]
        number = np.cumsum(context_of) - 1
        known, rank = np.unique(words, return_inverse=True)
        starts = np.append(np.flatnonzero(context_of), len(contexts))
        levels = [
            *EliasFano.parts(known, 1 << 32),
            *EliasFano.parts(distinct, 1 << 62),
            *EliasFano.parts(starts, len(contexts) + 1),
            *EliasFano.parts(number * max(1, len(known)) + rank, max(1, len(distinct) * len(known))),
            values.astype(np.int16),
            backoffs.astype(np.int16),
        ]
        sizes = np.array([len(known), *(x.nbytes for x in levels)], np.int64)
        return b"".join([sizes.tobytes(), *(x.tobytes() for x in levels)])

    def __init__(self, data: bytes) -> None:
        """The bytes are mapped, and all levels are views of the mapping."""
        self.memory = mmap.mmap(-1, len(data))
        self.memory.write(data)
        sizes = np.frombuffer(self.memory, np.int64, 15)
        at, views = sizes.nbytes, []
        for size in sizes[1:].tolist():
            views.append(np.frombuffer(self.memory, np.uint8, size, at))
            at += size
        self.n_words = int(sizes[0])
        sequences = []
        for i in range(0, 12, 3):
            n, low = views[i].view(np.int64).tolist()
            sequences.append(EliasFano(n, low, views[i + 1], views[i + 2]))
        self.words, self.contexts, self.pointers, self.successors = sequences
        self.values, self.backoffs = views[12].view(np.int16), views[13].view(np.int16)

    def look_up(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the place of its context and that of its successor, -1 where the trie has none."""
        context, rank = self.contexts.find(contexts), self.words.find(words)
        both = (context >= 0) & (rank >= 0)
        place = np.full(len(contexts), -1)
        if both.any():
            wanted = context[both] * max(1, self.n_words) + rank[both]
            found = self.successors.find(wanted)
            inside = (found >= self.pointers[context[both]]) & (found < self.pointers[context[both] + 1])
            place[both] = np.where(inside, found, -1)
        return context, place
