"""Point operators on pixel tables.

A null value stays null through grey values and differences, and is off after a threshold.  A pixel that the background
doesn't have, or one without place, has no difference.  Rows that repeat are answered as they come; an empty table gives an empty
result, and a background without rows gives no differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.functions import pixels as P


def grayscale(bgr: DataFrame, weights: str = "cpu") -> DataFrame:
    return bgr.select("frame_id", "y", "x", P.gray(F.col("b"), F.col("g"), F.col("r"), weights).alias("v"))


def background(frames: DataFrame, frame_id: int) -> DataFrame:
    """The pixels (y, x, bg) of one frame: bounded by the frame's size, so it can be broadcast."""
    return frames.where(F.col("frame_id") == frame_id).select("y", "x", F.col("v").alias("bg"))


def abs_diff(frames: DataFrame, bg: DataFrame, bg_id: int) -> DataFrame:
    """|frame - background| at each pixel, for all frames but the background."""
    own = frames.where(F.col("frame_id") != bg_id)
    return own.join(F.broadcast(bg), ["y", "x"]).select("frame_id", "y", "x", P.difference(F.col("v"), F.col("bg")).alias("v"))


def threshold(frames: DataFrame, value: int, maxval: int = 255, strict: bool = False) -> DataFrame:
    return frames.select("frame_id", "y", "x", P.thresholded(F.col("v"), value, maxval, strict).alias("v"))


def moving_pixels(binary: DataFrame) -> DataFrame:
    """frame_id, n_moving: how many pixels of each frame are on, frames without any too."""
    return binary.groupBy("frame_id").agg(F.count_if(P.is_on(F.col("v"))).alias("n_moving"))
