"""Blobs: sorted number columns packed into bytes, which tasks deal to each other by parts."""

from __future__ import annotations

import math
import struct

import numpy as np
import zstandard


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, none below 0, each in as few bytes as its largest needs, first bytes
    first, second ones then, so that they compress well; compressed."""
    out = []
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * w))
        out += [struct.pack("<QB", len(a), width), a.astype(f"<u{width}").view(np.uint8).reshape(len(a), width).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays of :func:`packed`."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<QB", raw, at)
        planes = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += 9 + n * width
    return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of numbers."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the order by ``keys``, the first one first, and where each group begins in it."""
    tops = [int(k.max()) + 1 if len(k) else 1 for k in keys]
    if math.prod(tops) < 1 << 62:  # the keys fit one number, which is sorted faster
        code = keys[0].astype(np.int64)
        for k, top in zip(keys[1:], tops[1:]):
            code = code * top + k
        order = np.argsort(code)
        code = code[order]
        new = np.ones(len(code), bool)
        np.not_equal(code[1:], code[:-1], out=new[1:])
        return order, np.flatnonzero(new)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def ranks(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of each row's group, from what :func:`grouped` gives."""
    new = np.zeros(len(order), np.int64)
    new[first] = 1
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def summed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)


def runs(part: np.ndarray):
    """(part, from, to) of each run of equal numbers."""
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
        yield int(part[lo]), lo, hi
