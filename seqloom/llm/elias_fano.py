"""Elias-Fano encoding of sorted integers with select."""

import struct

import numpy as np

_SAMPLE = 256


class EliasFano:
    """n non-decreasing integers in [0, universe]: l low bits each as they are, the rest in unary.

    About n * (2 + log2(universe / n)) bits. select(i) finds the i-th one of the unary part from a sampled rank and a
    scan of a few bytes; no table of 64-bit offsets is kept.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = _POP[high]
        self._rank = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)[_SAMPLE - 1 :: _SAMPLE]))

    @classmethod
    def encode(cls, values) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        if len(v) and bool((v[1:] < v[:-1]).any()):
            raise ValueError("values must not fall")
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        marks = np.zeros((top >> low_bits) + n + 1 if n else 0, dtype=np.uint8)
        marks[(v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(marks, bitorder="little"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw, at: int = 0):
        """The structure at `at`, and the place after it."""
        n, low_bits, a, b = struct.unpack_from("<QBQQ", raw, at)
        at += struct.calcsize("<QBQQ")
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        return cls(n, low_bits, low, high), at + a + b

    def _low(self, i):
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self._rank, i, "right")) - 1
        part = self.high[block * _SAMPLE : (block + 1) * _SAMPLE]
        left = i - int(self._rank[block])
        seen = np.cumsum(_POP[part])
        byte = int(np.searchsorted(seen, left, "right"))
        left -= int(seen[byte - 1]) if byte else 0
        bit = np.flatnonzero(np.unpackbits(part[byte : byte + 1], bitorder="little"))[left]
        place = (block * _SAMPLE + byte) * 8 + int(bit)
        return ((place - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def select_range(self, i: int, j: int) -> np.ndarray:
        """The i-th to the (j-1)-th value: one sampled rank and one scan of the bytes between them."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        first = int(np.searchsorted(self._rank, i, "right")) - 1
        last = int(np.searchsorted(self._rank, j, "left"))
        ones = np.flatnonzero(np.unpackbits(self.high[first * _SAMPLE : last * _SAMPLE], bitorder="little"))
        at = np.arange(i, j)
        places = ones[at - int(self._rank[first])] + first * _SAMPLE * 8
        return ((places - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def values(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        i = np.arange(self.n)
        return ((places - i.astype(np.uint64)) << np.uint64(self.low_bits)) | self._low(i)


_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
