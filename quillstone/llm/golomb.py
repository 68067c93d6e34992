"""Golomb-Rice codes for ascending integers, in numpy: the quotients' unary stream and the remainders' stream stand apart, so both decode without a loop."""

from __future__ import annotations

import numpy as np


def rice_bits(n: int, span: int) -> int:
    """Bits of a remainder for n values spread over span: about log2 of 0.69 times the mean gap."""
    return max(0, min(56, int(np.log2(max(1.0, 0.69 * span / max(1, n))))))


def encode(values: np.ndarray, k: int) -> bytes:
    """values: ascending distinct uint64. Returns gaps as unary quotients, then k-bit remainders."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    head = np.packbits(unary)
    rest = b""
    if k:
        shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
        rest = np.packbits(((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()).tobytes()
    return len(head).to_bytes(4, "little") + head.tobytes() + rest


def decode(blob: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    size = int.from_bytes(blob[:4], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 4)))[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps = gaps << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, -1, 4 + size))[: n * k].reshape(n, k)
        for i in range(k):
            gaps |= bits[:, i].astype(np.uint64) << np.uint64(k - 1 - i)
    return np.cumsum(gaps, dtype=np.uint64)
