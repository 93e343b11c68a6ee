"""Column functions on pixel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(b: Column, g: Column, r: Column, weights: str = "cpu") -> Column:
    """Grey value of a B, G, R pixel.

    cpu: truncated double sum.  gpu: the first byte, which is blue, gets the weight of red, in single precision.
    rounded: the public library's fixed-point form, rounded.
    """
    if weights == "cpu":
        return F.floor(r * F.lit(0.2989) + g * F.lit(0.5870) + b * F.lit(0.1140)).cast("int")
    if weights == "gpu":
        single = lambda c: c.cast("float")
        return F.floor(single(F.lit(0.299)) * single(b) + single(F.lit(0.587)) * single(g) + single(F.lit(0.114)) * single(r)).cast("int")
    if weights == "rounded":
        return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14).cast("int")
    raise ValueError(f"unknown weights: {weights}")


def difference(a: Column, b: Column) -> Column:
    """|a - b| of values from 0 to 255, without wrapping."""
    return F.abs(a - b).cast("int")


def thresholded(v: Column, threshold: int, maxval: int = 255, strict: bool = False) -> Column:
    over = v > threshold if strict else v >= threshold
    return F.when(over, F.lit(maxval)).otherwise(F.lit(0)).cast("int")


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.round(c).cast("int")


def is_on(v: Column) -> Column:
    """Binary morphology sees only the lowest bit: 255 and 1 are on, 254 is off."""
    return v.bitwiseAND(1) == 1
