"""Kernels as lists of taps (dy, dx, weight), made on the driver: their size depends on parameters alone."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

FIXED_LINE = (1, 4, 6, 4, 1)  # fixed values: the public library's kernel of 5 where no sigma is given
SCALE_BITS = 47  # single-precision weights are whole numbers at this scale, and 255 times their sum fits in 55 bits


@cache
def gaussian_weights(ksize: int, sigma: float) -> np.ndarray:
    """Single-precision taps of a normal density, divided by their sum in double precision."""
    r = ksize // 2
    d = np.arange(-r, r + 1, dtype=np.float64)
    square = d[:, None] ** 2 + d[None, :] ** 2
    taps = (np.exp(-square / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)).astype(np.float32)
    return (taps / taps.astype(np.float64).sum()).astype(np.float32)


def gaussian_line(ksize: int, sigma: float) -> list[float]:
    """Weights along one axis, whose products are those of the square kernel but for its rounding to single precision."""
    if sigma <= 0:
        return [w / sum(FIXED_LINE) for w in FIXED_LINE]
    d = np.arange(-(ksize // 2), ksize // 2 + 1, dtype=np.float64)
    line = np.exp(-(d**2) / (2 * sigma * sigma))
    return (line / line.sum()).tolist()


@cache
def gaussian_taps(ksize: int, sigma: float) -> tuple[tuple[int, int, int], ...]:
    """(dy, dx, weight * 2**47), zero weights left out: sums of whole numbers don't depend on their order.

    sigma 0: the public library's fixed kernel of 5.
    """
    if sigma <= 0:
        if ksize != len(FIXED_LINE):
            raise ValueError("sigma 0 is known for a kernel of 5 alone")
        unit = (1 << SCALE_BITS) // sum(FIXED_LINE) ** 2
        return tuple((y - 2, x - 2, a * b * unit) for y, a in enumerate(FIXED_LINE) for x, b in enumerate(FIXED_LINE))
    w = np.rint(gaussian_weights(ksize, sigma).astype(np.float64) * 2.0**SCALE_BITS).astype(np.int64)
    r = ksize // 2
    return tuple((y - r, x - r, int(w[y, x])) for y in range(ksize) for x in range(ksize) if w[y, x])


@cache
def disc(ksize: int) -> tuple[tuple[int, int], ...]:
    """(dy, dx) strictly within ksize / 2 of the centre; none for ksize 1."""
    r = ksize // 2
    return tuple((dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx < r * r)


@cache
def ellipse(ksize: int) -> tuple[tuple[int, int], ...]:
    """The public library's elliptic element: each row reaches round(r * sqrt(1 - (dy / r)**2))."""
    r = ksize // 2
    reach = {dy: round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0 for dy in range(-r, r + 1)}
    return tuple((dy, dx) for dy in reach for dx in range(-reach[dy], reach[dy] + 1))


def runs(taps: tuple[tuple[int, int], ...]) -> dict[int, int]:
    """dy to half width, for kernels whose rows are centred runs."""
    out = {dy: max(dx for y, dx in taps if y == dy) for dy in {y for y, _ in taps}}
    if sum(2 * w + 1 for w in out.values()) != len(taps):
        raise ValueError("the kernel's rows are not centred runs")
    return out


def taps_of(kernel: np.ndarray) -> tuple[tuple[int, int, int], ...]:
    """(dy, dx, weight) of an odd-sized array, zeros left out."""
    kernel = np.asarray(kernel)
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    return tuple((int(y) - ry, int(x) - rx, int(kernel[y, x])) for y, x in zip(*np.nonzero(kernel), strict=True))
