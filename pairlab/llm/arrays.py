"""Array routines for batches of texts: 64-bit mixing, rolling hashes, sliding minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Odd multipliers of the mixing function and the base of the rolling hash.
_M1, _M2, BASE = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Rolling:
    """Hashes of the stretches of one array of numbers; equal stretches have equal hashes."""

    _up = _down = np.empty(0, dtype=U64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Rolling._up) <= n:
            Rolling._up, Rolling._down = powers(BASE, n + 1), powers(BASE_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(mix(values.astype(U64) + U64(0x5851F42D4C957F2D)) * Rolling._up[:n], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        """The hash of each stretch of ``width`` numbers."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, dtype=U64)
        return mix((self.sums[width:] - self.sums[:n]) * Rolling._down[:n])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the stretches from ``start`` to before ``end``."""
        return mix((self.sums[end] - self.sums[start]) * Rolling._down[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, in time that doesn't depend on ``width``."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(texts: list[str | None], size: int, overlap: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Groups of text pieces of at most about ``size`` characters: row numbers, first
    characters and pieces. A longer text is cut so that each ``overlap`` + 1 neighbouring
    characters lie in one piece, whole."""
    rows, starts, pieces, held = [], [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        for start in range(0, max(1, len(text) - overlap), size):
            piece = text if len(text) <= size + overlap else text[start : start + size + overlap]
            if held and held + len(piece) > size + overlap:
                yield rows, starts, pieces
                rows, starts, pieces, held = [], [], [], 0
            rows.append(row)
            starts.append(start)
            pieces.append(piece)
            held += len(piece)
            if piece is text:
                break
    if pieces:
        yield rows, starts, pieces
