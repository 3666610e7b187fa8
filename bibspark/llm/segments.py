"""Segment-popcount embedding of 64-bit fingerprints: bit counts of their 32 two-bit segments, whose Manhattan distance never exceeds the Hamming distance."""

from __future__ import annotations

import numpy as np

_FIELDS = 0x5555555555555555


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed in two-bit fields (uint64 in, uint64 out)."""
    return fp - (fp >> np.uint64(1) & np.uint64(_FIELDS))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: fields hold 0, 1 or 2, and a field's difference is found from its two bits."""
    low = np.uint64(_FIELDS)
    a1, a0, b1, b0 = a >> np.uint64(1) & low, a & low, b >> np.uint64(1) & low, b & low
    two = (a1 & ~b1 & ~b0 | b1 & ~a1 & ~a0) & low
    return np.bitwise_count((a1 ^ b1 | a0 ^ b0) & low) + np.bitwise_count(two)
