"""Wavelet matrices of token ids: a succinct, compressed, searchable shard file.

A shard's ids are mapped to the dense codes of the ids it holds.  Level by level,
from the highest bit of the codes, a plane keeps one bit of each code and the
codes are parted stably, zeros first.  Planes are cut into blocks compressed one
by one, beside the count of ones before each block, so that access, counting and
search read only the blocks they touch.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"SFWM0001"
#: Bits of a plane in one compressed block.
BLOCK_BITS = 1 << 19


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def encode(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, nulls: np.ndarray | None = None) -> bytes:
    """The file of a shard: its ids in order, with each document's id and length.

    ``nulls`` marks documents whose id is null."""
    size = int(ids.max()) + 1 if len(ids) else 1
    present = np.zeros(size, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype("<u4")
    code = np.zeros(size, np.uint16 if len(alphabet) <= 65536 else np.uint32)
    code[alphabet] = np.arange(len(alphabet), dtype=code.dtype)
    cur = code[ids]
    levels = max(1, int(len(alphabet) - 1).bit_length())
    body: list[bytes] = []
    planes = []
    for level in range(levels):
        bit = (cur >> (levels - 1 - level)) & 1 != 0
        packed = np.packbits(bit, bitorder="little")
        blocks, ones = [], [0]
        for at in range(0, max(1, len(packed)), BLOCK_BITS // 8):
            part = packed[at : at + BLOCK_BITS // 8]
            body.append(zstandard.ZstdCompressor(level=1).compress(part.tobytes()))
            blocks.append(len(body[-1]))
            ones.append(ones[-1] + int(np.bitwise_count(part).sum()))
        planes.append({"zeros": len(cur) - ones[-1], "blocks": blocks, "ones": ones})
        if level < levels - 1:
            cur = np.concatenate((cur[~bit], cur[bit]))
    meta = {
        "alphabet": _pack(alphabet),
        "doc_ids": _pack(doc_ids.astype("<i8")),
        "lengths": _pack(lengths.astype("<i8")),
        "nulls": _pack(np.zeros(len(doc_ids), bool) if nulls is None else nulls.astype(bool)),
    }
    head = json.dumps({"n": len(ids), "levels": levels, "block_bits": BLOCK_BITS, "planes": planes, "meta": [[k, len(v)] for k, v in meta.items()]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *meta.values(), *body])


class Shard:
    """A shard file, open for reading: ``source`` is its bytes or a binary file object."""

    def __init__(self, source):
        if not hasattr(source, "read"):
            import io

            source = io.BytesIO(source)
        self._file = source
        if source.read(8) != MAGIC:
            raise ValueError("not a token shard")
        head = json.loads(source.read(struct.unpack("<I", source.read(4))[0]))
        self.n, self.levels, self._bits = head["n"], head["levels"], head["block_bits"]
        self._planes = head["planes"]
        meta = {k: self._unpack(source.read(size)) for k, size in head["meta"]}
        self.alphabet = np.frombuffer(meta["alphabet"], "<u4")
        self.doc_ids = np.frombuffer(meta["doc_ids"], "<i8")
        self.lengths = np.frombuffer(meta["lengths"], "<i8")
        self.nulls = np.frombuffer(meta["nulls"], bool)
        at = source.tell()
        for p in self._planes:
            p["at"] = np.concatenate(([at], at + np.cumsum(p["blocks"]))).tolist()
            at = p["at"][-1]
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def _unpack(raw: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(raw)

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._kept:
            if len(self._kept) > 256:
                self._kept.clear()
            p = self._planes[level]
            self._file.seek(p["at"][k])
            self._kept[level, k] = np.frombuffer(self._unpack(self._file.read(p["at"][k + 1] - p["at"][k])), np.uint8)
        return self._kept[level, k]

    def _bit(self, level: int, i: int) -> int:
        k, r = divmod(i, self._bits)
        return int(self._block(level, k)[r >> 3]) >> (r & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k, r = divmod(i, self._bits)
        ones = self._planes[level]["ones"][k]
        if r:
            block = self._block(level, k)
            ones += int(np.bitwise_count(block[: r >> 3]).sum()) + int(block[r >> 3] & ((1 << (r & 7)) - 1)).bit_count() if r & 7 else int(np.bitwise_count(block[: r >> 3]).sum())
        return ones

    def _select(self, level: int, bit: int, j: int) -> int:
        """Where the ``j``-th (from 0) bit of that value lies in a plane."""
        p = self._planes[level]
        ones = np.asarray(p["ones"])
        before = ones if bit else np.minimum(np.arange(len(ones)) * self._bits, self.n) - ones
        k = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self._block(level, k), bitorder="little")[: min(self._bits, self.n - k * self._bits)]
        return k * self._bits + int(np.flatnonzero(bits == bit)[j - int(before[k])])

    def access(self, i: int) -> int:
        """The token id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            code = code << 1 | bit
            i = self._planes[level]["zeros"] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, token: int, end: int) -> tuple[int, int, list[int]] | None:
        c = int(np.searchsorted(self.alphabet, token))
        if c == len(self.alphabet) or self.alphabet[c] != token:
            return None
        lo, hi, bits = 0, end, []
        for level in range(self.levels):
            bit = c >> (self.levels - 1 - level) & 1
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            z = self._planes[level]["zeros"]
            lo, hi = (z + a, z + b) if bit else (lo - a, hi - b)
            bits.append(bit)
        return lo, hi, bits

    def rank(self, token: int, end: int | None = None) -> int:
        """How often a token id occurs before position ``end`` (in the whole shard, if none)."""
        r = self._range(token, self.n if end is None else min(end, self.n))
        return r[1] - r[0] if r else 0

    def select(self, token: int, j: int) -> int:
        """The position of the ``j``-th (from 0) occurrence of a token id."""
        r = self._range(token, self.n)
        if r is None or not 0 <= j < r[1] - r[0]:
            raise IndexError(j)
        i = r[0] + j
        for level in range(self.levels - 1, -1, -1):
            bit = r[2][level]
            i = self._select(level, bit, i - self._planes[level]["zeros"] if bit else i)
        return i

    def locate(self, token: int) -> list[int]:
        """All positions of a token id, in order."""
        return [self.select(token, j) for j in range(self.rank(token))]

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the partings from the lowest plane up."""
        cur = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 65536 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            p = self._planes[level]
            raw = np.concatenate([self._block(level, k) for k in range(len(p["blocks"]))])
            bit = np.unpackbits(raw, bitorder="little")[: self.n].view(bool)
            if level < self.levels - 1:
                was, cur = cur, np.empty_like(cur)
                cur[~bit], cur[bit] = was[: p["zeros"]], was[p["zeros"] :]
            cur |= bit.astype(cur.dtype) << (self.levels - 1 - level)
        return self.alphabet[cur]
