"""The detection pipeline: background, grey, blur, difference, threshold, morphology, components, boxes.

Two physical plans, one result.  "packed" runs whole frames through numpy in one pass without a shuffle; "relational" is
made of joins and aggregates on pixel tables, partitioned by frame once.  "auto" takes the packed one for frames of more
than ``PIXEL_BUDGET`` pixels, where shifted copies of every pixel would dominate, and whenever the input is packed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions.pixels import is_on
from motionframe.operators import boxes, labelling, morphology, packed, point, stencil
from motionframe.params import DetectParams
from motionframe.sources import frames as S

PIXEL_BUDGET = 1024


def first_frame(frames: DataFrame, bg_id: int | None = None) -> tuple[int, np.ndarray]:
    """Number and array of the first packed frame: one row reaches the driver.  A number that is known needn't be looked for.

    Of frames that repeat the number the least counts.  An aggregate, unlike a limit, doesn't stop workers half way.
    """
    bg_id = S.background_id(frames) if bg_id is None else bg_id
    r = frames.where(F.col("frame_id") == bg_id).agg(F.min(F.struct("height", "width", "n_channels", "data")).alias("first")).head().first
    a = np.frombuffer(bytes(r.data), np.uint8).reshape((r.height, r.width) + ((r.n_channels,) if r.n_channels > 1 else ()))
    return bg_id, a


def detect_packed(frames: DataFrame, p: DetectParams, background: np.ndarray | None = None, bg_id: int | None = None) -> DataFrame:
    """Boxes of all packed frames but the background, which is the first one unless given."""
    if background is None:
        bg_id, background = first_frame(frames, bg_id)
        frames = frames.where(F.col("frame_id") != bg_id)
    return packed.detect(frames, background, p)


def binary_stages(pixels: DataFrame, p: DetectParams, height: int, width: int, bg_id: int) -> dict[str, DataFrame]:
    """Each stage's pixels of the relational plan, from grey frames (or B, G, R ones) to morphology.

    The background's few pixels go through the first steps by themselves and are broadcast: bounded by one frame.
    """
    grey = pixels if "v" in pixels.columns else point.grayscale(pixels, p.gray)
    own = stencil.by_frame(grey)
    blurred = stencil.blur(own, p.ksize, p.sigma, height, width, p.border)
    bg = point.background(stencil.blur(grey.where(F.col("frame_id") == bg_id), p.ksize, p.sigma, height, width, p.border), bg_id)
    diff = point.abs_diff(blurred, bg, bg_id)
    binary = point.threshold(diff, p.threshold, p.maxval, p.strict)
    form = {
        "dilate_erode": morphology.dilate_erode, "erode_dilate": morphology.erode_dilate, "open_neutral": morphology.open_neutral,
        "dilate": lambda b, k, h, w: morphology.dilate(b, morphology.disc(k), h, w),
    }[p.morphology]
    return {"grayscale": grey, "blur": blurred, "diff": diff, "threshold": binary, "morphology": form(binary, p.morph_ksize, height, width)}


def detect_relational(pixels: DataFrame, p: DetectParams, height: int, width: int, bg_id: int | None = None) -> DataFrame:
    if p.external:
        raise ValueError("outer components alone: use the packed plan")
    stages = binary_stages(pixels, p, height, width, S.background_id(pixels) if bg_id is None else bg_id)
    return boxes.bounding_boxes(labelling.components(stages["morphology"], height, width, p.label_base))


def detect(frames: DataFrame, p: DetectParams, plan: str = "auto", height: int | None = None, width: int | None = None, bg_id: int | None = None) -> DataFrame:
    """(frame_id, label, x, y, width, height, area) of every object in every frame but the first, from packed frames or pixels.

    Frames of another size than the background are an error, and so is an input without a frame.  Pixels that are missing or
    null are 0.  bg_id is the first frame's number, where it is known without looking through the frames.  Frames that repeat a number are answered one by one where they are packed.
    """
    is_packed = "data" in frames.columns
    if plan == "auto":
        plan = "packed" if is_packed or p.external or height is None or height * width > PIXEL_BUDGET else "relational"
    if plan == "packed":
        if not is_packed:
            if height is None:
                size = frames.agg(F.max("y"), F.max("x")).head()
                if size[0] is None:
                    raise ValueError("no first frame to take as background")
                height, width = size[0] + 1, size[1] + 1
            frames = S.pack(frames, height, width, ("v",) if "v" in frames.columns else ("b", "g", "r"))
        return detect_packed(frames, p, bg_id=bg_id)
    if plan != "relational":
        raise ValueError(f"unknown plan: {plan}")
    if is_packed:
        height, width = S.frame_size(frames)
        frames = S.unpack(frames)
    return detect_relational(frames, p, height, width, bg_id)


#: A kernel of two values where a square was meant: this pixel and the one above.
PROTOTYPE_TAPS = ((-1, 0), (0, 0))


def prototype_binary(pixels: DataFrame, height: int, width: int, threshold: int = 20, taps: tuple = PROTOTYPE_TAPS, bg_id: int | None = None) -> DataFrame:
    """The early form's binary frames: grey opening of the difference, then a strict threshold.

    Frames are blurred with a kernel of 5 and sigma 0.2, the background with the fixed kernel that 5 and sigma 0 mean; borders are mirrored.
    """
    bg_id = S.background_id(pixels) if bg_id is None else bg_id
    soft = stencil.blur(stencil.by_frame(pixels), 5, 0.2, height, width, "reflect101")
    still = stencil.blur(pixels.where(F.col("frame_id") == bg_id), 5, 0, height, width, "reflect101")
    diff = point.abs_diff(soft, point.background(still, bg_id), bg_id)
    return point.threshold(morphology.gray_open(diff, taps, height, width), threshold, strict=True)


def detect_prototype(pixels: DataFrame, height: int, width: int, k: int = 1, threshold: int = 20, taps: tuple = PROTOTYPE_TAPS, bg_id: int | None = None) -> DataFrame:
    """The boxes of the k largest contours of the early form: outer borders, nested ones too, and borders of holes all count.

    area is that of the contour's polygon through the middles of pixels; a lone pixel's, or a line's, is 0.
    """
    binary = prototype_binary(pixels, height, width, threshold, taps, bg_id)
    return boxes.topk(packed.contour_frames(S.pack(binary, height, width), height, width), k)


def stage_report(frames: DataFrame, p: DetectParams, bg_id: int | None = None) -> DataFrame:
    """Means by stage, as the benchmark prints them: (stage, frames, total_ms, frame_avg_ms, percent) of detecting objects in packed frames: seconds within the tasks, summed."""
    bg_id, background = first_frame(frames, bg_id)
    times = packed.timed_stages(frames.where(F.col("frame_id") != bg_id), background, p)
    sums = times.groupBy("stage").agg(F.sum("frames").alias("frames"), (1000 * F.sum("seconds")).alias("total_ms"))
    share = 100 * F.col("total_ms") / F.sum("total_ms").over(Window.partitionBy())  # a row for each stage, six in all
    return sums.select("stage", "frames", "total_ms", (F.col("total_ms") / F.col("frames")).alias("frame_avg_ms"), share.alias("percent"))


def stage_summary(pixels: DataFrame, p: DetectParams, height: int, width: int, bg_id: int | None = None) -> DataFrame:
    """(stage, n_frames, n_pixels, total): how many frames and pixels each stage leaves on, and the sum of its values."""
    stages = binary_stages(pixels, p, height, width, S.background_id(pixels) if bg_id is None else bg_id)
    out = None
    for name, df in stages.items():
        on = F.col("v") != 0 if name not in ("threshold", "morphology") else is_on(F.col("v"))
        row = df.where(on).agg(F.countDistinct("frame_id").alias("n_frames"), F.count("*").alias("n_pixels"), F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("total"))
        row = row.select(F.lit(name).alias("stage"), "n_frames", "n_pixels", "total")
        out = row if out is None else out.unionByName(row)
    return out
