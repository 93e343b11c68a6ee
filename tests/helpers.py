import itertools

import numpy as np

from motionframe.sources import frames as S


def pixel_table(spark, *frames):
    rows = [(i, y, x, int(a[y, x])) for i, a in enumerate(frames) for y, x in itertools.product(range(a.shape[0]), range(a.shape[1]))]
    return spark.createDataFrame(rows, "frame_id long, y int, x int, v int")


def as_array(df, height, width, frame=0, column="v"):
    out = np.zeros((height, width), np.int64)
    for r in df.where(f"frame_id = {frame}").collect():
        out[r.y, r.x] = r[column]
    return out


def packed_frames(spark, *frames):
    return S.from_arrays(spark, list(frames))


def brute_components(on):
    """Labels 1 + first raster place, by flooding."""
    h, w = on.shape
    out = np.zeros((h, w), int)
    for y, x in itertools.product(range(h), range(w)):
        if on[y, x] and not out[y, x]:
            label, front = y * w + x + 1, [(y, x)]
            out[y, x] = label
            while front:
                a, b = front.pop()
                for c, d in itertools.product(range(max(0, a - 1), min(h, a + 2)), range(max(0, b - 1), min(w, b + 2))):
                    if on[c, d] and not out[c, d]:
                        out[c, d] = label
                        front.append((c, d))
    return out


def brute_over(on, taps, every, outside=False):
    h, w = on.shape
    out = np.zeros((h, w), bool)
    for y, x in itertools.product(range(h), range(w)):
        seen = [on[y + a, x + b] if 0 <= y + a < h and 0 <= x + b < w else outside for a, b in taps]
        out[y, x] = all(seen) if every else any(seen)
    return out
