"""Content-defined chunking with a gear rolling hash over the last 16 bytes."""

from __future__ import annotations

import numpy as np


def gear_table(seed: int = 7) -> np.ndarray:
    """256 random 32-bit words, the same in every process."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint32)


TABLE = gear_table()


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of TABLE[byte j back] << j for j below 16, by doubling the window."""
    h = TABLE[data]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    at = 1
    while 2 * at <= width:
        values = np.minimum(values[:-at], values[at:])
        at *= 2
    return np.minimum(values[: len(values) - (width - at)], values[width - at :]) if width > at else values


def cuts(data: bytes, width: int, most: int) -> list[int]:
    """Ends of the chunks of data: after each byte whose hash is below all on its left and not
    above any on its right, width bytes either way; and where most bytes pass without such a
    byte, after the first of the least hash among those that leave width to most bytes.

    A cut depends on the bytes near it alone, so an insertion shifts only chunks close by. In
    text of a short period no byte is below its left; there the second rule falls into step
    with the period, so runs of one word are cut alike wherever they begin. Chunks have more
    than width bytes, but for the first, the last and those around a cut of the second rule.
    Empty data has no chunk.
    """
    n, high = len(data), np.full(width, 0xFFFFFFFF, np.uint32)
    if n <= width:
        return [n] if n else []
    h = rolling(np.frombuffer(data, np.uint8))
    low = _least(np.concatenate((high, h, high)), width)
    marks = np.flatnonzero((h < low[:n]) & (h <= low[width + 1 : width + 1 + n])) + 1
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > most:
            last += width + int(h[last + width - 1 : last + most].argmin())
            out.append(last)
        if m > last:
            out.append(m)
            last = m
    return out
