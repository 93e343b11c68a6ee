"""Bounding boxes of labelled pixels, their ranking, and drawing them.

Rows without frame_id or label are a group of their own, as SQL has it; an empty table has no boxes.  Boxes that tie in
area are ranked by label; rows that repeat a box are ranked apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounding_boxes(labels: DataFrame) -> DataFrame:
    """(frame_id, label, x, y, width, height, area): one box per component; area counts its pixels."""
    ends = labels.groupBy("frame_id", "label").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("area")
    )
    size = lambda a, b: (F.col(b) - F.col(a) + 1).cast("int")
    return ends.select("frame_id", "label", "x", "y", size("x", "x2").alias("width"), size("y", "y2").alias("height"), "area")


def ranked(boxes: DataFrame) -> DataFrame:
    """boxes with their rank by falling area within the frame, ties by label."""
    order = Window.partitionBy("frame_id").orderBy(F.desc("area"), "label")
    return boxes.withColumn("rank", F.row_number().over(order))


def topk(boxes: DataFrame, k: int = 1) -> DataFrame:
    """Boxes with more area than the one of rank k + 1: boxes tied with it all go.  A frame with k boxes or fewer keeps all.

    area is whatever the boxes have: pixels of a component, or the area of a contour's polygon.
    """
    whole = Window.partitionBy("frame_id")
    cut = F.max(F.when(F.col("rank") == k + 1, F.col("area"))).over(whole)
    return ranked(boxes).withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("area") > F.col("cut"))).drop("cut", "rank")


def outline_pixels(boxes: DataFrame, thickness: int = 2) -> DataFrame:
    """(frame_id, y, x): distinct pixels of the boxes' outlines, ``thickness`` deep from their edges inwards."""
    at = boxes.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x0", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    t = thickness
    edge = (F.col("y0") < t) | (F.col("y0") >= F.col("height") - t) | (F.col("x0") < t) | (F.col("x0") >= F.col("width") - t)
    return at.where(edge).select("frame_id", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x")).distinct()
