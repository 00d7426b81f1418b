"""Arrays of numbers as compressed byte planes, for what moves between tasks in large rows."""

from __future__ import annotations

import numpy as np


def pack(a, width: int = 8) -> bytes:
    """Unsigned numbers below 2 ** (8 * width)."""
    import zstandard

    a = np.ascontiguousarray(a).astype("<u8", copy=False)
    return zstandard.compress(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpack(data: bytes, width: int = 8):
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    a = np.zeros((raw.shape[1], 8), np.uint8)
    a[:, :width] = raw.T
    return a.reshape(-1).view("<u8")


def ragged(starts, lengths):
    """Indices of the pieces [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
