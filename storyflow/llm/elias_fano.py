"""Elias-Fano sequences and the n-gram trie made of them, as bytes that can be memory-mapped.

A monotone sequence keeps the low bits of its numbers packed, and their high parts in
unary: bit (number >> low) + i is set for the i-th number, so that ones select numbers
and zeros part buckets of equal high parts.

A trie has a level for each word of an n-gram.  The children of a node are one range of
the next level, which monotone pointers bound.  Within a range word numbers ascend; each
range is raised by the last number before it, so a level is one monotone sequence, and a
word is sought in its context's range alone, as the successor of its raised number.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np

#: By byte and r: which bit is its r-th one (its r-th zero); 8 where there is none.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
SELECT_ONE, SELECT_ZERO = (np.argsort(1 - (_BITS == b), axis=1, kind="stable").astype(np.uint8) for b in (1, 0))


class EliasFano:
    """A monotone sequence over a buffer."""

    HEAD = struct.Struct("<QQQQ")

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        """The bytes of numbers in ascending order, repeats allowed."""
        v, n = values.astype(np.uint64), len(values)
        low = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        packed = []
        for at in range(0, n if low else 0, 1 << 15):
            part = v[at : at + (1 << 15)]
            packed.append(np.packbits(((part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
        lows = b"".join(packed) + bytes(8)
        high = (v >> np.uint64(low)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        highs = np.packbits(bits, bitorder="little").tobytes()
        return cls.HEAD.pack(n, low, len(lows), len(highs)) + lows + highs

    def __init__(self, buffer: np.ndarray):
        self.n, self.low, lows, highs = self.HEAD.unpack(buffer[: self.HEAD.size].tobytes())
        at = self.HEAD.size
        self.lows, self.highs = buffer[at : at + lows], buffer[at + lows : at + lows + highs]
        #: Ones before each byte of the high parts.
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(self.highs), dtype=np.int64)))
        self.zeros = np.arange(len(self.ones)) * 8 - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        out = np.zeros(len(i), np.uint64)
        for k in range((self.low + 14) // 8):
            out |= self.lows[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return (out >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at some indices."""
        byte = np.searchsorted(self.ones, i, side="right") - 1
        place = byte * 8 + SELECT_ONE[self.highs[byte], i - self.ones[byte]]
        return (place - i) << self.low | self._low(i).astype(np.int64)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of indices whose numbers have these high parts."""
        zeros = self.zeros
        most = self.highs.size * 8 - int(self.ones[-1])

        def before(k):  # numbers before the k-th zero
            byte = np.searchsorted(zeros, k, side="right") - 1
            inside = np.minimum(byte, len(self.highs) - 1)
            found = inside * 8 + SELECT_ZERO[self.highs[inside], np.minimum(k - zeros[inside], 7)] - k
            return np.where(k < most, np.minimum(found, self.n), self.n)

        return np.where(high > 0, before(np.maximum(high - 1, 0)), 0), before(high)

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first index of [begin, end) whose number is at least x; end if there is none."""
        a, b = self._bucket(x >> self.low)
        a, b = np.clip(a, begin, end), np.clip(b, begin, end)
        wanted = (x & ((1 << self.low) - 1)).astype(np.uint64)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle) < wanted[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        return a


@dataclass
class Level:
    """A level to be written: each node's parent (ascending), its word (ascending by parent) and a code."""

    parent: np.ndarray
    word: np.ndarray
    code: np.ndarray


def encode(levels: list[Level]) -> bytes:
    """The bytes of a trie."""
    parts: list[bytes] = []
    parents = 1
    for level in levels:
        pointers = np.searchsorted(level.parent, np.arange(parents + 1))
        last = np.where(np.diff(pointers) > 0, level.word[np.maximum(pointers[1:] - 1, 0)] if len(level.word) else 0, 0)
        raised = level.word + (np.cumsum(last) - last)[level.parent]
        parts += [EliasFano.encode(pointers), EliasFano.encode(raised), level.code.astype("<u2").tobytes()]
        parents = len(level.word)
    head = json.dumps([len(p) for p in parts]).encode()
    return struct.pack("<I", len(head)) + head + b"".join(parts)


class Trie:
    """A trie over a buffer, mapped or in memory."""

    def __init__(self, buffer: np.ndarray):
        (size,) = struct.unpack("<I", buffer[:4].tobytes())
        at, parts = 4 + size, []
        for n in json.loads(buffer[4 : 4 + size].tobytes()):
            parts.append(buffer[at : at + n])
            at += n
        self.levels = [(EliasFano(parts[i]), EliasFano(parts[i + 1]), parts[i + 2]) for i in range(0, len(parts), 3)]

    def find(self, level: int, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, node): the nodes of words after their parents; a parent below 0 has no children."""
        pointers, words, _ = self.levels[level]
        ok = parent >= 0
        if not words.n or not ok.any():
            return np.zeros(len(word), bool), np.full(len(word), -1)
        begin, end = pointers[np.where(ok, parent, 0)], pointers[np.where(ok, parent, 0) + 1]
        base = np.where(begin > 0, words[np.maximum(begin - 1, 0)], 0)
        node = words.successor(base + word, begin, end)
        found = ok & (node < end)
        found &= words[np.minimum(node, words.n - 1)] == base + word
        return found, np.where(found, node, -1)

    def codes(self, level: int, node: np.ndarray) -> np.ndarray:
        """The codes of nodes that there are."""
        raw = self.levels[level][2]
        return raw[2 * node].astype(np.int64) | raw[2 * node + 1].astype(np.int64) << 8
