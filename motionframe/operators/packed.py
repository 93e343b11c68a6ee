"""The same operators on whole frames as numpy arrays, and the Arrow functions that run them.

Arrays are (frames, height, width); a batch of frames goes through each step at once.  Results equal the pixel-table
forms bit for bit: blurs are summed in whole numbers, labels are first places in raster order.  A frame without size or data
is an error, and so is one of another size; frames that repeat a number are answered one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.functions.kernels import SCALE_BITS, disc, ellipse, gaussian_line, gaussian_taps
from motionframe.params import DetectParams

CONTOURS = "frame_id long, kind string, label long, x int, y int, width int, height int, area double"
BOXES = "frame_id long, label long, x int, y int, width int, height int, area long"
BATCH_FRAMES = 64
BATCH_PIXELS = 1 << 20
FEW_TAPS = 25
DOUBT = np.float32(7e-4)  # two passes of 15 single-precision terms up to 255 are off by less than 5e-4
BAND = 64
HALF = 1 << (SCALE_BITS - 1)


def gray(bgr: np.ndarray, weights: str) -> np.ndarray:
    """The same sums as the column functions, in the same order; a cast to bytes truncates."""
    b, g, r = bgr[..., 0], bgr[..., 1], bgr[..., 2]
    if weights == "cpu":
        out = r * np.float64(0.2989)
        out += g * np.float64(0.5870)
        out += b * np.float64(0.1140)
    elif weights == "gpu":
        out = b * np.float32(0.299)
        out += g * np.float32(0.587)
        out += r * np.float32(0.114)
    else:
        out = (r.astype(np.int32) * 4899 + g * np.int32(9617) + b * np.int32(1868) + 8192) >> 14
    return out.astype(np.uint8)


def padded(a: np.ndarray, reach: int, border: str) -> np.ndarray:
    """Frames with ``reach`` more pixels on each side: zeros, or the frame mirrored as often as it takes."""
    if border != "reflect101":
        return np.pad(a, ((0, 0), (reach, reach), (reach, reach)))
    rows, cols = (mirror(n, reach) for n in a.shape[1:])
    return a[:, rows][:, :, cols]


def mirror(n: int, reach: int) -> np.ndarray:
    at = np.arange(-reach, n + reach)
    if n == 1:
        return np.zeros_like(at)
    at %= 2 * n - 2
    return np.minimum(at, 2 * n - 2 - at)


def keeps_pixels(taps: tuple) -> bool:
    """Whether a blur rounds every pixel to itself: the other weights can't move it, nor a missing border, by half a step."""
    own = sum(w for y, x, w in taps if y == x == 0)
    others = sum(w for y, x, w in taps) - own
    return 255 * max((1 << SCALE_BITS) - own, others) < HALF


@cache
def bands(ksize: int, sigma: float, block: int = BAND) -> np.ndarray:
    """The matrix that takes block + ksize - 1 pixels of a line to block blurred ones."""
    line, out = np.array(gaussian_line(ksize, sigma), np.float32), np.zeros((block + ksize - 1, block), np.float32)
    for i in range(block):
        out[i : i + ksize, i] = line
    return out


def blur(a: np.ndarray, ksize: int, sigma: float, border: str = "zero") -> np.ndarray:
    """Whole-number sums, as the relational form makes them.

    A kernel of many taps is applied as rows and columns in single precision first, as products with band matrices, a frame
    at a time.  That is off by far less than ``DOUBT``; only pixels that come so close to a half are summed exactly.
    """
    taps = gaussian_taps(ksize, sigma)
    if keeps_pixels(taps):
        return a.copy()
    reach = max((max(abs(y), abs(x)) for y, x, _ in taps), default=0)
    h, w = a.shape[1:]
    wide = padded(a, reach, border)
    if len(taps) <= FEW_TAPS:
        wide = wide.astype(np.int64)
        total = np.zeros(a.shape, np.int64)
        for y, x, k in taps:
            total += k * wide[:, reach + y : reach + y + h, reach + x : reach + x + w]
        return ((total + HALF) >> SCALE_BITS).astype(np.uint8)
    band = bands(2 * reach + 1, sigma)
    n_rows, n_cols = (-(-n // BAND) * BAND + 2 * reach for n in (h, w))
    own, rows, about = np.zeros((n_rows, n_cols), np.float32), np.empty((n_rows, n_cols), np.float32), np.empty((n_rows, n_cols), np.float32)
    out, near = np.empty(a.shape, np.uint8), []
    for i, frame in enumerate(wide):
        own[: h + 2 * reach, : w + 2 * reach] = frame
        for s in range(0, w, BAND):
            np.matmul(own[:, s : s + len(band)], band, out=rows[:, s : s + BAND])
        for s in range(0, h, BAND):
            np.matmul(band.T, rows[s : s + len(band), :w], out=about[s : s + BAND, :w])
        now = about[:h, :w]
        now += np.float32(0.5)
        out[i] = now
        now -= out[i]  # how far above the step that it was rounded down to
        y, x = np.nonzero((now < DOUBT) | (now > 1 - DOUBT))
        near.append((np.full(len(y), i), y, x))
    f, y, x = (np.concatenate(c) for c in zip(*near, strict=True)) if near else (np.empty(0, np.int64),) * 3
    if len(f):
        k = 2 * reach + 1
        weight = np.zeros((k, k), np.int64)
        for dy, dx, v in taps:
            weight[reach + dy, reach + dx] = v
        for s in range(0, len(f), 4096):
            at = f[s : s + 4096], y[s : s + 4096], x[s : s + 4096]
            near = np.lib.stride_tricks.sliding_window_view(wide, (k, k), axis=(1, 2))[at].reshape(len(at[0]), -1)
            out[at] = (near.astype(np.int64) @ weight.reshape(-1) + HALF) >> SCALE_BITS
    return out


def _over(on: np.ndarray, taps: tuple, outside: bool, every: bool) -> np.ndarray:
    """OR (AND if every) over the taps, row runs joined by doubling; beyond the frame ``outside`` holds."""
    if not taps:
        return np.full(on.shape, every)
    reach = max(max(abs(y), abs(x)) for y, x in taps)
    h, w = on.shape[1:]
    wide = np.pad(on, ((0, 0), (reach, reach), (reach, reach)), constant_values=outside)
    join = np.logical_and if every else np.logical_or
    out = np.full(on.shape, every)
    rows: dict[tuple[int, int], list[int]] = {}
    for dy in sorted({y for y, _ in taps}):
        own = sorted(x for y, x in taps if y == dy)
        start = own[0]
        for a, b in zip(own, [*own[1:], None], strict=True):
            if b != a + 1:
                rows.setdefault((start, a - start + 1), []).append(dy)
                start = b
    for (x, n), dys in rows.items():
        run, have = wide, 1
        while have < n:  # run[..., i] covers have places from i on
            step = min(have, n - have)
            run = join(run[..., : run.shape[2] - step], run[..., step:])
            have += step
        for dy in dys:
            join(out, run[:, reach + dy : reach + dy + h, reach + x : reach + x + w], out=out)
    return out


def dilate(on: np.ndarray, taps: tuple) -> np.ndarray:
    return _over(on, taps, False, False)


def erode(on: np.ndarray, taps: tuple, neutral: bool = False) -> np.ndarray:
    return _over(on, taps, neutral, True)


def morphology(on: np.ndarray, p: DetectParams) -> np.ndarray:
    taps = ellipse(p.morph_ksize) if p.morphology == "open_neutral" else disc(p.morph_ksize)
    if p.morphology == "dilate":
        return dilate(on, taps)
    if p.morphology == "dilate_erode":
        return erode(dilate(on, taps), taps)
    if p.morphology == "erode_dilate":
        return dilate(erode(on, taps), taps)
    return dilate(erode(on, taps, neutral=True), taps)


def runs_of(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the horizontal runs of a stack of frames; row counts through the whole stack."""
    flat = on.reshape(-1, on.shape[2])
    edge = np.diff(np.pad(flat, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n items' components under links a - b: hooking and pointer jumping on arrays."""
    p = np.arange(n)
    while True:
        ra, rb = p[a], p[b]
        if (ra == rb).all():
            return p
        np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
        while (p != (q := p[p])).any():
            p = q


def labelled(on: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last, component) of the runs; a component is known by its first run."""
    h = on.shape[1]
    row, first, last = runs_of(on)
    n, reach = len(row), int(diagonal)
    big = on.shape[2] + 2
    # for each run, the runs of the row above that it touches are a range, since runs of a row are in order
    lo = np.searchsorted(row * big + last, (row - 1) * big + first - reach)
    hi = np.searchsorted(row * big + first, (row - 1) * big + last + reach, "right")
    count = np.where(row % h == 0, 0, np.maximum(0, hi - lo))
    own = np.repeat(np.arange(n), count)
    above = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return row, first, last, joined(n, own, above)


def outside_reaches(on: np.ndarray) -> np.ndarray:
    """Pixels beside the part of the background that is joined, by edges, with the outside of the frame."""
    off = np.pad(~on, ((0, 0), (1, 1), (1, 1)), constant_values=True)
    row, first, last, component = labelled(off, diagonal=False)
    h = off.shape[1]
    outer = np.zeros(off.shape, bool).reshape(-1, off.shape[2])
    top = np.zeros(len(row), bool)
    top[component[row % h == 0]] = True
    mark = np.zeros((outer.shape[0], outer.shape[1] + 1), np.int8)
    use = top[component]
    np.add.at(mark, (row[use], first[use]), 1)
    np.add.at(mark, (row[use], last[use] + 1), -1)
    outer = (np.cumsum(mark, axis=1)[:, :-1] > 0).reshape(off.shape)
    near = outer[:, :-2, 1:-1] | outer[:, 2:, 1:-1] | outer[:, 1:-1, :-2] | outer[:, 1:-1, 2:]
    return near & on


def boxes_of(on: np.ndarray, ids: np.ndarray, external: bool = False, label_base: int = 1) -> pa.RecordBatch:
    """A row of BOXES for each component of a stack of frames."""
    h, w = on.shape[1:]
    row, first, last, component = labelled(on)
    head, which = np.unique(component, return_inverse=True)
    n = len(head)
    x0, x1, y1 = np.full(n, w), np.full(n, -1), np.full(n, -1)
    np.minimum.at(x0, which, first)
    np.maximum.at(x1, which, last)
    np.maximum.at(y1, which, row % h)
    area = np.bincount(which, last - first + 1, n).astype(np.int64)
    frame, y0 = row[head] // h, row[head] % h
    keep = np.ones(n, bool)
    if external and n:
        seen = np.concatenate([np.zeros((len(on) * h, 1), np.int64), np.cumsum(outside_reaches(on).reshape(-1, w), axis=1)], axis=1)
        keep = np.bincount(which, (seen[row, last + 1] - seen[row, first]) > 0, n) > 0
    label = y0.astype(np.int64) * w + first[head] + label_base
    cols = [ids[frame], label, x0, y0, x1 - x0 + 1, y1 - y0 + 1, area]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c[keep], t) for c, t in zip(cols, kinds, strict=True)], names=["frame_id", "label", "x", "y", "width", "height", "area"])


def painted(shape: tuple[int, ...], row: np.ndarray, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    """An array with each run's value in its places, -1 elsewhere."""
    n = last - first + 1
    out = np.full(int(np.prod(shape)), -1)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(row * shape[2] + first, n)
    out[at] = np.repeat(value, n)
    return out.reshape(shape)


def contours_of(on: np.ndarray, ids: np.ndarray, label_base: int = 1) -> pa.RecordBatch:
    """A row of CONTOURS for each border of a stack of frames, in no order: the outer one of each component, and one around
    each hole, which runs over the component's pixels beside it.

    The area is that of the polygon through the middles of the border's pixels.  It is made of unit squares between four
    pixels: a component has those with four of its pixels and half of those with three, the rest belongs to the parts
    of the background; an outer border encloses its component, its holes and what lies in these.
    """
    h, w = on.shape[1] + 2, on.shape[2] + 2
    lit = np.pad(on, ((0, 0), (1, 1), (1, 1)))
    parts, firsts = [], []
    for side, diagonal in ((lit, True), (~lit, False)):
        row, first, last, component = labelled(side, diagonal)
        head, which = np.unique(component, return_inverse=True)
        n = len(head)
        x0, x1, y1 = np.full(n, w), np.full(n, -1), np.full(n, -1)
        np.minimum.at(x0, which, first)
        np.maximum.at(x1, which, last)
        np.maximum.at(y1, which, row)
        parts.append([painted(lit.shape, row, first, last, which), row[head], first[head], x0, x1, y1])
        firsts.append(row[head] * w + first[head])
    (own, *_), (back, *_) = parts
    n_own, n_back = len(firsts[0]), len(firsts[1])
    area = np.zeros(n_own + n_back)
    corners = [(slice(None), slice(y, h - 1 + y), slice(x, w - 1 + x)) for y in (0, 1) for x in (0, 1)]
    count = sum(lit[c].astype(np.int8) for c in corners)
    for c in corners:
        mine = own[c]
        np.add.at(area, mine[(count == 4) & (mine >= 0)], 0.25)
        np.add.at(area, mine[(count == 3) & (mine >= 0)], 0.5 / 3)
        them = back[c]
        for zeros, share in ((1, 0.5), (2, 0.5), (3, 1 / 3), (4, 0.25)):
            np.add.at(area, n_own + them[(count == 4 - zeros) & (them >= 0)], share)
    flat_own, flat_back = own.reshape(-1), back.reshape(-1)
    # what surrounds a part stands left of a component's first pixel, and above a hole's
    outside = firsts[1] % (h * w) == 0
    parent = np.concatenate([n_own + flat_back[firsts[0] - 1], np.where(outside, -1, flat_own[np.maximum(firsts[1] - w, 0)])])
    for i in np.argsort(-np.concatenate(firsts), kind="stable").tolist():  # what is enclosed begins after what encloses it
        if parent[i] >= 0:
            area[parent[i]] += area[i]
    holes = np.flatnonzero(~outside)
    cols: list[list] = [[], [], [], [], [], [], [], []]
    for kind, which, grow in (("outer", np.arange(n_own), 0), ("hole", holes, 1)):
        _, row, first, x0, x1, y1 = (v if v.ndim > 1 else v[which] for v in parts[grow])
        y0, frame = row % h, row // h
        label = (y0 - 1) * (w - 2) + first - 1 + label_base
        sizes = (ids[frame], [kind] * len(which), label, x0 - 1 - grow, y0 - 1 - grow, x1 - x0 + 1 + 2 * grow, y1 % h - y0 + 1 + 2 * grow, np.round(2 * area[which + grow * n_own]) / 2)
        for c, v in zip(cols, sizes, strict=True):
            c.extend(v if isinstance(v, list) else v.tolist())
    kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["frame_id", "kind", "label", "x", "y", "width", "height", "area"])


def contour_frames(packed: DataFrame, height: int, width: int, label_base: int = 1) -> DataFrame:
    """CONTOURS of packed binary frames: outer borders of all components, nested ones too, and borders of holes.

    label is the place of the component's, or hole's, first pixel in raster order.
    """

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, frames in stacks(b, height, width):
                yield contours_of((frames & 1).astype(bool), ids, label_base)

    return packed.mapInArrow(task, CONTOURS)


def stacks(batch: pa.RecordBatch, height: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, frames) of a batch of packed frames, a bounded number at a time; a frame of another size is an error."""
    step = max(1, min(BATCH_FRAMES, BATCH_PIXELS // (height * width)))
    for s in range(0, batch.num_rows, step):
        part = batch.slice(s, step)
        if any(part.column(c).null_count for c in ("height", "width", "n_channels", "data")):
            raise ValueError("a frame without size or data")
        sizes = {*zip(part.column("height").to_pylist(), part.column("width").to_pylist(), strict=True)}
        if sizes != {(height, width)}:
            raise ValueError(f"frames of {sorted(sizes)} against a background of {(height, width)}")
        n = part.column("n_channels")[0].as_py()
        data = np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8)
        shape = (part.num_rows, height, width) + ((n,) if n > 1 else ())
        yield part.column("frame_id").to_numpy(), data.reshape(shape)


def prepared(frames: np.ndarray, p: DetectParams) -> np.ndarray:
    """Grey and blurred."""
    return blur(frames if frames.ndim == 3 else gray(frames, p.gray), p.ksize, p.sigma, p.border)


def moving(frames: np.ndarray, background: np.ndarray, p: DetectParams) -> np.ndarray:
    """Which pixels are on after difference, threshold and morphology; background is prepared already."""
    d = np.abs(prepared(frames, p).astype(np.int16) - background)
    on = d > p.threshold if p.strict else d >= p.threshold
    return morphology(on & bool(p.maxval & 1), p)


def detect(packed: DataFrame, background: np.ndarray, p: DetectParams) -> DataFrame:
    """Boxes of every packed frame against one background frame (uint8, grey or B, G, R); no shuffle, one pass."""
    h, w = background.shape[:2]
    ready = prepared(background[None], p)[0].astype(np.int16)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, frames in stacks(b, h, w):
                yield boxes_of(moving(frames, ready, p), ids, p.external, p.label_base)

    return packed.select("frame_id", "height", "width", "n_channels", "data").mapInArrow(task, BOXES)


def label_frames(packed: DataFrame, height: int, width: int, label_base: int = 1) -> DataFrame:
    """(frame_id, y, x, label) of packed binary frames."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, frames in stacks(b, height, width):
                on = (frames & 1).astype(bool)
                row, first, last, component = labelled(on)
                n = last - first + 1
                at = np.repeat(np.arange(len(row)), n)
                x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[at]
                y = row[at] % height
                label = (row[component] % height * width + first[component] + label_base)[at]
                cols = [(ids[row[at] // height], pa.int64()), (y, pa.int32()), (x, pa.int32()), (label, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["frame_id", "y", "x", "label"])

    return packed.mapInArrow(task, "frame_id long, y int, x int, label long")


def box_frames(packed: DataFrame, height: int, width: int, external: bool = False, label_base: int = 1) -> DataFrame:
    """Boxes of packed binary frames."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, frames in stacks(b, height, width):
                yield boxes_of((frames & 1).astype(bool), ids, external, label_base)

    return packed.mapInArrow(task, BOXES)


STAGES = ("grayscale", "blur", "difference", "threshold", "morphology", "components and boxes")


def timed_stages(packed: DataFrame, background: np.ndarray, p: DetectParams) -> DataFrame:
    """(stage, frames, seconds) of each stack of frames that a task detects objects in."""
    h, w = background.shape[:2]
    ready = prepared(background[None], p)[0].astype(np.int16)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, frames in stacks(b, h, w):
                marks = [time.perf_counter()]
                mark = lambda value: (marks.append(time.perf_counter()), value)[1]  # noqa: B023, E731
                grey = mark(frames if frames.ndim == 3 else gray(frames, p.gray))
                soft = mark(blur(grey, p.ksize, p.sigma, p.border))
                d = mark(np.abs(soft.astype(np.int16) - ready))
                on = mark((d > p.threshold if p.strict else d >= p.threshold) & bool(p.maxval & 1))
                on = mark(morphology(on, p))
                mark(boxes_of(on, ids, p.external, p.label_base))
                cols = [pa.array(STAGES), pa.array([len(ids)] * len(STAGES), pa.int64()), pa.array(np.diff(marks))]
                yield pa.RecordBatch.from_arrays(cols, names=["stage", "frames", "seconds"])

    return packed.select("frame_id", "height", "width", "n_channels", "data").mapInArrow(task, "stage string, frames long, seconds double")


def render(packed: DataFrame, boxes: DataFrame, thickness: int = 2, text: str | Column = "Detected", side_by_side: bool = True) -> DataFrame:
    """Packed colour frames with red outlines, beside the plain frame if asked; text goes along as a column.

    text: the same for every frame, or a column of the frames' table such as ``rate_text``.  A frame without boxes is as it was.
    """
    box = F.collect_list(F.struct("x", "y", "width", "height")).alias("boxes")
    rows = packed.withColumn("text", F.lit(text)).join(boxes.groupBy("frame_id").agg(box), "frame_id", "left")
    names = ["frame_id", "height", "width", "n_channels", "data"]

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, widths = [], []
            for r in b.to_pylist():
                h, w, n = r["height"], r["width"], r["n_channels"]
                plain = np.frombuffer(r["data"], np.uint8).reshape(h, w, n)
                plain = np.repeat(plain, 3, axis=2) if n == 1 else plain[..., :3]
                drawn = plain.copy()
                for q in r["boxes"] or []:
                    inner = drawn[q["y"] : q["y"] + q["height"], q["x"] : q["x"] + q["width"]]
                    keep = inner[thickness:-thickness, thickness:-thickness].copy()
                    inner[:] = (0, 0, 255)
                    if keep.size:
                        inner[thickness:-thickness, thickness:-thickness] = keep
                out = np.concatenate([plain, drawn], axis=1) if side_by_side else drawn
                data.append(out.tobytes())
                widths.append(out.shape[1])
            m = b.num_rows
            cols = [b.column("frame_id"), b.column("height"), pa.array(widths, pa.int32()), pa.array([3] * m, pa.int32()), pa.array(data, pa.binary()), b.column("text")]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "text"])

    return rows.select(*names, "boxes", "text").mapInArrow(task, "frame_id long, height int, width int, n_channels int, data binary, text string")


def rate_text(milliseconds: Column) -> Column:
    """The overlay's text for a frame that took so long: frames a second, with two digits; null for an unknown time.

    Rounded as C's printf does, from the double's exact value and halves to even (15.625 is 15.62), below 2**46 frames a
    second.  Java's own %.2f takes the shortest decimal and rounds halves up.
    """
    return F.concat(F.lit("Fps: "), F.call_function("format_number", F.lit(1000.0) / milliseconds, F.lit("0.00")))


def printed(packed: DataFrame) -> DataFrame:
    """(frame_id, text): one-channel frames as a debug printer writes them, each value three wide and a space, a line a row."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = []
            for h, w, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "data")), strict=True):
                text.append("".join("".join(f"{v:3d} " for v in line) + "\n" for line in np.frombuffer(data, np.uint8).reshape(h, w).tolist()))
            yield pa.RecordBatch.from_arrays([b.column("frame_id"), pa.array(text, pa.string())], names=["frame_id", "text"])

    return packed.select("frame_id", "height", "width", "data").mapInArrow(task, "frame_id long, text string")
