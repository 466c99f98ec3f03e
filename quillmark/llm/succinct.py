"""Succinct bit-planes with rank and select, and the wavelet matrix over them (numpy, vectorised).

A plane holds n bits in 64-bit words and the count of ones before each word, so rank is one lookup and one
population count; select is a binary search over those counts. The wavelet matrix keeps one plane for each bit
of a symbol, highest first; each level is the stable partition of the one above by its bit.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"QWM1"


class BitPlane:
    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @classmethod
    def of(cls, bits: np.ndarray) -> BitPlane:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(n // 64 + 1, "<u8")  # one spare word, so rank(n) reads in bounds
        words.view(np.uint8)[: len(packed)] = packed
        return cls(words, n)

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def rank0(self, i: np.ndarray) -> np.ndarray:
        return i - self.rank1(i)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the k-th (from 0) ones or zeros; k must be in range."""
        k = np.asarray(k, np.int64)
        before = self.before if bit else np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        w = np.searchsorted(before, k, side="right") - 1
        word = self.words[w] if bit else ~self.words[w]
        left, pos = k - before[w], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # descend by halves of the word
            low = (word >> pos.astype(np.uint64)) & np.uint64((1 << width) - 1)
            c = np.bitwise_count(low).astype(np.int64)
            go = left >= c
            pos += np.where(go, width, 0)
            left -= np.where(go, c, 0)
        return w * 64 + pos


class WaveletMatrix:
    def __init__(self, planes: list[BitPlane], n: int):
        self.planes, self.n = planes, n
        self.zeros = [p.n - p.ones for p in planes]

    @classmethod
    def of(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        planes, n = [], len(values)
        for level in range(levels - 1, -1, -1):
            bit = (values & values.dtype.type(1 << level)).astype(bool)
            planes.append(BitPlane.of(bit))
            if level:
                below, z = np.empty_like(values), n - planes[-1].ones
                np.compress(~bit, values, out=below[:z])
                np.compress(bit, values, out=below[z:])
                values = below
        return cls(planes, n)

    def access(self, i: np.ndarray) -> np.ndarray:
        i, value = np.asarray(i, np.int64), np.zeros(len(i), np.int64)
        for p, z in zip(self.planes, self.zeros, strict=True):
            b = p.get(i)
            r = p.rank1(i)
            i = np.where(b, z + r, i - r)
            value = value * 2 + b
        return value

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in [0, i), elementwise."""
        i = np.asarray(i, np.int64)
        start, top = np.zeros(len(i), np.int64), len(self.planes) - 1
        for k, (p, z) in enumerate(zip(self.planes, self.zeros, strict=True)):
            b = (symbol >> (top - k)) & 1 == 1
            rs, ri = p.rank1(start), p.rank1(i)
            start, i = np.where(b, z + rs, start - rs), np.where(b, z + ri, i - ri)
        return i - start

    def count(self, symbol: int) -> int:
        return int(self.rank(np.array([symbol]), np.array([self.n]))[0])

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th occurrences (from 0) of one symbol."""
        start, top = np.zeros(1, np.int64), len(self.planes) - 1
        for j, (p, z) in enumerate(zip(self.planes, self.zeros, strict=True)):
            start = z + p.rank1(start) if (symbol >> (top - j)) & 1 else p.rank0(start)
        i = start[0] + np.asarray(k, np.int64)
        for j in range(top, -1, -1):
            bit = (symbol >> (top - j)) & 1
            i = self.planes[j].select(i - self.zeros[j] if bit else i, bit)
        return i

    def decode(self) -> np.ndarray:
        """All symbols in order: undo the stable partitions from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for k in range(len(self.planes) - 1, -1, -1):
            bit, z = self.planes[k].bits(), self.zeros[k]
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~bit)] = value[:z]
            above[np.flatnonzero(bit)] = value[z:] | kind(1 << (len(self.planes) - 1 - k))
            value = above
        return value

    def to_bytes(self, level: int = 1) -> bytes:
        """One file: magic, n, levels, then each plane's words, zstandard where that is shorter; level 0 stores."""
        press = zstandard.ZstdCompressor(level=level) if level else None
        out = [MAGIC, struct.pack("<QB", self.n, len(self.planes))]
        for p in self.planes:
            raw = p.words.tobytes()
            body = press.compress(raw) if press else raw
            squeezed = len(body) < len(raw)
            out += [struct.pack("<BQ", squeezed, len(body) if squeezed else len(raw)), body if squeezed else raw]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, levels = struct.unpack_from("<QB", data, 4)
        at, planes, press = 13, [], zstandard.ZstdDecompressor()
        for _ in range(levels):
            squeezed, size = struct.unpack_from("<BQ", data, at)
            at += 9
            raw = press.decompress(data[at : at + size]) if squeezed else data[at : at + size]
            planes.append(BitPlane(np.frombuffer(raw, "<u8"), n))
            at += size
        return cls(planes, n)
