"""Connected components (8 neighbours) of binary pixel tables, frame by frame.

label = y * width + x + label_base of the component's first pixel in raster order; with label_base 0 the pixel (0, 0)
still gets its label here, 0, since the background has no rows.  A null value is off; rows that repeat a pixel count once;
an empty table has no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.functions.pixels import is_on
from motionframe.operators import packed
from motionframe.operators.stencil import with_taps
from motionframe.sources.frames import pack

PRIOR = ((-1, -1), (-1, 0), (-1, 1), (0, -1))


def _on(binary: DataFrame) -> DataFrame:
    return binary.where(is_on(F.col("v"))).select("frame_id", "y", "x")


def prior_neighbours(binary: DataFrame) -> DataFrame:
    """(frame_id, y, x, ny, nx): each pixel that is on with those before it in raster order that touch it.

    Rows and columns are compared apart, so the last pixel of a row never touches the first of the next.
    """
    on = _on(binary)
    ask = with_taps(on, PRIOR).select("*", (F.col("y") + F.col("dy")).alias("ny"), (F.col("x") + F.col("dx")).alias("nx")).drop("dy", "dx")
    near = on.select("frame_id", F.col("y").alias("ny"), F.col("x").alias("nx"))
    return ask.join(near, ["frame_id", "ny", "nx"]).select("frame_id", "y", "x", "ny", "nx")


def components(binary: DataFrame, height: int, width: int, label_base: int = 1) -> DataFrame:
    """(frame_id, y, x, label): each frame's pixels meet in one row, a frame being of bounded size, and are labelled there.

    Whatever the shape of an object, that takes one pass; pixels that are partitioned by frame_id aren't moved for it.
    """
    return packed.label_frames(pack(_on(binary).select("*", F.lit(1).alias("v")), height, width), height, width, label_base)
