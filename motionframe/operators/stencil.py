"""Neighbourhood operators on pixel tables: shifted copies by a constant list of taps, and sums.

All of them group by (frame_id, y, x).  Pixels that are partitioned by frame_id - see ``by_frame`` - already satisfy
that, so a whole chain of these operators shuffles once, and the many shifted copies of a pixel are summed where they arise.
A null value counts as 0, like a pixel that isn't there; rows without place or frame are dropped; rows that repeat a
pixel add up; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.functions.kernels import SCALE_BITS, gaussian_taps, taps_of


def by_frame(pixels: DataFrame) -> DataFrame:
    """Each frame's pixels in one partition; frames are of bounded size and there are many of them."""
    return pixels.repartition(F.col("frame_id"))


def with_taps(pixels: DataFrame, taps: list | tuple, names: str = "dy dx") -> DataFrame:
    """pixels with each of the taps: a constant array exploded in generated code, so there is neither a join nor a broadcast."""
    names = names.split()
    rows = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}L" if n == "w" else f"'{n}', {v}" for n, v in zip(names, t, strict=True)) + ")" for t in taps)
    return pixels.select("*", F.expr(f"inline(array({rows}))"))


def axis(n: int, reach: int, border: str) -> list[tuple[int, int, int]]:
    """(source, target, offset) along one axis: target + offset is source, mirrored at the edges if border says so."""
    out = []
    for target in range(n):
        for d in range(-reach, reach + 1):
            s = target + d
            if border == "reflect101":
                s = s % (2 * n - 2) if n > 1 else 0
                s = min(s, 2 * n - 2 - s) if n > 1 else 0
            if 0 <= s < n:
                out.append((s, target, d))
    return out


def placed(pixels: DataFrame) -> DataFrame:
    """Rows that have a frame and a place, null values as 0."""
    return pixels.where("frame_id IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").select("frame_id", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def correlated(pixels: DataFrame, taps: tuple, height: int, width: int, border: str = "zero") -> DataFrame:
    """(frame_id, y, x, total): the sum of weight * pixel over the taps, unflipped; beyond the frame 0 or mirrored."""
    spark, taps, pixels = pixels.sparkSession, list(taps) or [(0, 0, 0)], placed(pixels)
    if border == "zero":
        ty, tx = F.col("y") - F.col("dy"), F.col("x") - F.col("dx")
        near = with_taps(pixels, taps, "dy dx w").select("frame_id", ty.alias("y"), tx.alias("x"), (F.col("v") * F.col("w")).alias("p"))
        near = near.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    else:
        ry, rx = (max((abs(t[k]) for t in taps), default=0) for k in (0, 1))
        rows = F.broadcast(spark.createDataFrame(axis(height, ry, border), "y int, ty int, dy int"))
        cols = F.broadcast(spark.createDataFrame(axis(width, rx, border), "x int, tx int, dx int"))
        near = pixels.join(rows, "y").join(cols, "x").join(F.broadcast(spark.createDataFrame(taps, "dy int, dx int, w long")), ["dy", "dx"])
        near = near.select("frame_id", F.col("ty").alias("y"), F.col("tx").alias("x"), (F.col("v") * F.col("w")).alias("p"))
    return near.groupBy("frame_id", "y", "x").agg(F.sum("p").alias("total"))


def filter2d(pixels: DataFrame, kernel: np.ndarray, height: int, width: int, border: str = "zero") -> DataFrame:
    """Correlation with a kernel of whole numbers."""
    out = correlated(pixels, taps_of(kernel), height, width, border)
    return out.select("frame_id", "y", "x", F.col("total").cast("int").alias("v"))


def blur(pixels: DataFrame, ksize: int, sigma: float, height: int, width: int, border: str = "zero") -> DataFrame:
    """Gaussian blur, never in place; zero borders are not renormalised.  Sums are exact, halves round up.

    sigma 0 with a kernel of 5 is the public library's fixed one.  Exact sums need the whole square of taps: going along rows
    and columns would leave doubtful pixels, whose neighbours a join had to fetch by another shuffle.
    """
    out = correlated(pixels, gaussian_taps(ksize, sigma), height, width, border)
    value = F.shiftright(F.col("total") + F.lit(1 << (SCALE_BITS - 1)), SCALE_BITS).cast("int")
    return out.select("frame_id", "y", "x", value.alias("v"))
