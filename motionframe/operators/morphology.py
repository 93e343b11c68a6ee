"""Binary and grey morphology on pixel tables.

Binary input is dense or sparse: only pixels whose lowest bit is set count.  Binary results are sparse: the pixels that
are on, with v = on.  Beyond the frame everything is off, for dilation and erosion alike.  A null value is off, and so is a row
without place; rows that repeat a pixel count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions.kernels import disc, ellipse, runs
from motionframe.functions.pixels import is_on
from motionframe.operators.stencil import with_taps


def _shifted(pixels: DataFrame, taps: tuple, height: int, width: int) -> DataFrame:
    at = with_taps(pixels.where("frame_id IS NOT NULL"), taps).select("frame_id", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), "v")
    return at.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def dilate(binary: DataFrame, taps: tuple, height: int, width: int, on: int = 255) -> DataFrame:
    if not taps:
        return binary.where("false").select("frame_id", "y", "x", F.lit(on).alias("v"))
    near = _shifted(binary.where(is_on(F.col("v"))), taps, height, width)
    return near.groupBy("frame_id", "y", "x").agg(F.lit(on).alias("v"))


def erode(binary: DataFrame, taps: tuple, height: int, width: int, on: int = 255, neutral: bool = False) -> DataFrame:
    """A pixel stays on where all taps are.  Without taps every pixel of the (dense) input is on.  neutral: taps beyond the frame don't count."""
    if not taps:
        return binary.select("frame_id", "y", "x", F.lit(on).alias("v"))
    # each pixel once: a row that repeats would count twice
    near = _shifted(binary.where(is_on(F.col("v"))).groupBy("frame_id", "y", "x").agg(F.lit(on).alias("v")), taps, height, width)
    count = near.groupBy("frame_id", "y", "x").agg(F.count("*").alias("n"))
    need = F.lit(len(taps))
    if neutral:
        inside = [(y, x, sum(0 <= y + dy < height and 0 <= x + dx < width for dy, dx in taps)) for y in range(height) for x in range(width)]
        edge = [p for p in inside if p[2] < len(taps)]
        few = F.broadcast(binary.sparkSession.createDataFrame(edge or [(-1, -1, 0)], "y int, x int, m int"))
        count, need = count.join(few, ["y", "x"], "left"), F.coalesce("m", F.lit(len(taps)))
    return count.where(F.col("n") == need).select("frame_id", "y", "x", F.lit(on).alias("v"))


def dilate_erode(binary: DataFrame, ksize: int, height: int, width: int) -> DataFrame:
    """Dilation, then erosion, by a disc: a closing, though it goes by the name of the opposite elsewhere."""
    taps = disc(ksize)
    return erode(dilate(binary, taps, height, width), taps, height, width) if taps else erode(binary, taps, height, width)


def erode_dilate(binary: DataFrame, ksize: int, height: int, width: int) -> DataFrame:
    """Erosion, then dilation, by a disc: an opening."""
    return dilate(erode(binary, disc(ksize), height, width), disc(ksize), height, width)


#: The names these have in the pipeline's older forms.
morph_open_ref, morph_close_ref = dilate_erode, erode_dilate


def open_neutral(binary: DataFrame, ksize: int, height: int, width: int) -> DataFrame:
    """A true opening by an ellipse, the outside neutral."""
    taps = ellipse(ksize)
    return dilate(erode(binary, taps, height, width, neutral=True), taps, height, width)


def gray_dilate(pixels: DataFrame, taps: tuple, height: int, width: int) -> DataFrame:
    return _shifted(pixels, taps, height, width).groupBy("frame_id", "y", "x").agg(F.max("v").alias("v"))


def gray_erode(pixels: DataFrame, taps: tuple, height: int, width: int) -> DataFrame:
    return _shifted(pixels, taps, height, width).groupBy("frame_id", "y", "x").agg(F.min("v").alias("v"))


def gray_open(pixels: DataFrame, taps: tuple, height: int, width: int) -> DataFrame:
    """Grey opening: least, then greatest value over the taps within the frame."""
    return gray_dilate(gray_erode(pixels, taps, height, width), taps, height, width)


def dilate_by_runs(binary: DataFrame, ksize: int, on: int = 255) -> DataFrame:
    """Dilation of a dense binary table by windows instead of shifted copies: running maxima along rows, one for each
    width that the disc's rows have, then down the columns.  Dense result, 0 or on."""
    reach = runs(disc(ksize))
    lit = binary.select("frame_id", "y", "x", F.when(is_on(F.col("v")), 1).otherwise(0).alias("v"))
    row = Window.partitionBy("frame_id", "y").orderBy("x")
    for w in sorted(set(reach.values())):
        lit = lit.withColumn(f"m{w}", F.max("v").over(row.rangeBetween(-w, w)))
    column = Window.partitionBy("frame_id", "x").orderBy("y")
    found = F.greatest(*(F.coalesce(F.max(f"m{w}").over(column.rangeBetween(dy, dy)), F.lit(0)) for dy, w in reach.items()), F.lit(0), F.lit(0))
    return lit.select("frame_id", "y", "x", (found * on).cast("int").alias("v"))
