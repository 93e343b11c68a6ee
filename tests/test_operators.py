import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.functions import pixels as P
from motionframe.functions.kernels import disc, ellipse
from motionframe.operators import boxes, labelling, morphology, packed, point, stencil
from tests.helpers import as_array, brute_components, brute_over, packed_frames, pixel_table

RNG = np.random.default_rng(11)
BLOBS = (RNG.random((13, 14)) < 0.3).astype(int) * 255


def test_gray_of_neutral_pixels(spark):
    rows = spark.createDataFrame([(0, 0, v, v, v, v) for v in range(256)], "frame_id long, y int, x int, b int, g int, r int")
    got = as_array(point.grayscale(rows), 1, 256)[0]
    assert got[0] == 0 and (got[1:] == np.arange(255)).all()
    for weights in ("cpu", "gpu", "rounded"):
        bgr = RNG.integers(0, 256, (6, 7, 3))
        table = spark.createDataFrame([(0, y, x, *map(int, bgr[y, x])) for y in range(6) for x in range(7)], rows.schema)
        assert (as_array(point.grayscale(table, weights), 6, 7) == packed.gray(bgr.astype(np.uint8), weights)).all()


def test_gpu_weights_exchange_red_and_blue(spark):
    row = spark.createDataFrame([(0, 0, 0, 255, 0, 0)], "frame_id long, y int, x int, b int, g int, r int")
    assert as_array(point.grayscale(row, "gpu"), 1, 1)[0, 0] == 76
    assert as_array(point.grayscale(row, "cpu"), 1, 1)[0, 0] == 29


def test_difference_and_threshold(spark):
    a, b = np.array([[0, 200, 20]]), np.array([[255, 10, 40]])
    d = point.abs_diff(px := pixel_table(spark, a, b), point.background(px, 0), 0)
    assert as_array(d, 1, 3, 1).tolist() == [[255, 190, 20]]
    assert as_array(point.threshold(d, 20), 1, 3, 1).tolist() == [[255, 255, 255]]
    assert as_array(point.threshold(d, 20, strict=True), 1, 3, 1).tolist() == [[255, 255, 0]]
    assert point.moving_pixels(point.threshold(d, 100)).collect()[0].n_moving == 2


def test_rounding_is_away_from_zero(spark):
    row = spark.createDataFrame([(2.5,), (-2.5,), (3.5,)], "c double").select(P.rounded(F.col("c")).alias("c")).collect()
    assert [r.c for r in row] == [3, -3, 4]


def test_filter2d(spark):
    got = as_array(stencil.filter2d(pixel_table(spark, np.eye(3, dtype=int)), np.eye(3, dtype=int), 3, 3), 3, 3)
    assert got.tolist() == [[2, 0, 0], [0, 3, 0], [0, 0, 2]]
    a = RNG.integers(0, 256, (9, 9))
    assert (as_array(stencil.filter2d(pixel_table(spark, a), np.array([[0, 0, 0], [0, 1, 0], [0, 0, 0]]), 9, 9), 9, 9) == a).all()


@pytest.mark.parametrize(("k", "sigma", "border"), [(3, 2.0, "zero"), (9, 2.0, "zero"), (11, 2.0, "zero"), (15, 2.0, "zero"), (5, 2.0, "reflect101"), (15, 0.2, "zero")])
def test_blur_plans_agree(spark, k, sigma, border):
    a = RNG.integers(0, 256, (13, 14))
    rel = as_array(stencil.blur(pixel_table(spark, a), k, sigma, 13, 14, border), 13, 14)
    assert (rel == packed.blur(a[None].astype(np.uint8), k, sigma, border)[0]).all()
    if sigma == 0.2:
        assert (rel == a).all()


def test_blur_of_a_constant():
    got = packed.blur(np.full((1, 31, 31), 200, np.uint8), 15, 2.0)[0]
    assert (got[0, 0], got[0, 15], got[15, 15]) == (72, 120, 200)


@pytest.mark.parametrize("taps", [disc(3), disc(5), disc(9), ellipse(5), ((-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)), ((0, 0), (0, 3))])
@pytest.mark.parametrize("on", [1, 255])
def test_binary_morphology(spark, taps, on):
    lit = BLOBS > 0
    table = pixel_table(spark, lit.astype(int) * on)
    grown, shrunk = brute_over(lit, taps, False), brute_over(lit, taps, True)
    assert (as_array(morphology.dilate(table, taps, 13, 14, on), 13, 14) == grown * on).all()
    assert (as_array(morphology.erode(table, taps, 13, 14, on), 13, 14) == shrunk * on).all()
    assert (packed.dilate(lit[None], taps)[0] == grown).all() and (packed.erode(lit[None], taps)[0] == shrunk).all()
    neutral = brute_over(lit, taps, True, True)
    assert (packed.erode(lit[None], taps, neutral=True)[0] == neutral).all()
    assert (as_array(morphology.erode(table, taps, 13, 14, on, neutral=True), 13, 14) == neutral * on).all()


def test_kernel_without_taps(spark):
    table = pixel_table(spark, BLOBS)
    assert morphology.dilate(table, disc(1), 13, 14).count() == 0
    assert morphology.erode(table, disc(1), 13, 14).count() == 13 * 14
    assert morphology.dilate_erode(table, 1, 13, 14).count() == 13 * 14
    assert packed.erode(packed.dilate(BLOBS[None] > 0, ()), ()).all()


def test_lowest_bit_counts(spark):
    assert morphology.dilate(pixel_table(spark, np.array([[254, 254]])), disc(5), 1, 2).count() == 0


def test_border_is_lost(spark):
    full = np.full((31, 31), 255)
    assert morphology.dilate_erode(pixel_table(spark, full), 15, 31, 31).count() == 361
    lone = np.zeros((31, 31), int)
    lone[15, 15] = 255
    assert morphology.dilate_erode(pixel_table(spark, lone), 15, 31, 31).count() == 1
    assert morphology.erode_dilate(pixel_table(spark, lone), 15, 31, 31).count() == 0
    assert morphology.morph_open_ref is morphology.dilate_erode


def test_windows_dilate_alike(spark):
    lit = (RNG.random((24, 20)) < 0.03).astype(int) * 255
    assert (as_array(morphology.dilate_by_runs(pixel_table(spark, lit), 15), 24, 20) == 255 * brute_over(lit > 0, disc(15), False)).all()


def test_gray_open(spark):
    a = RNG.integers(0, 256, (7, 8))
    near = lambda m, f: np.array([[f(m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]) for x in range(8)] for y in range(7)])
    assert (as_array(morphology.gray_open(pixel_table(spark, a), disc(5), 7, 8), 7, 8) == near(near(a, np.min), np.max)).all()


def components_of(spark, on):
    table = pixel_table(spark, on.astype(int) * 255)
    rel = as_array(labelling.components(table, *on.shape), *on.shape, column="label")
    pack = as_array(packed.label_frames(packed_frames(spark, on.astype(int) * 255), *on.shape), *on.shape, column="label")
    assert (rel == pack).all()
    return rel


def test_components(spark):
    for share in (0.15, 0.35, 0.6):
        on = RNG.random((13, 14)) < share
        assert (components_of(spark, on) == brute_components(on)).all()


def test_u_shape_corner_and_edges(spark):
    u = np.zeros((9, 9), bool)
    u[0:8, 0] = u[0:8, 8] = u[8, 0:9] = True
    assert set(components_of(spark, u)[u]) == {1}
    edges = np.zeros((4, 6), bool)
    edges[1, 5] = edges[2, 0] = True
    assert len(set(components_of(spark, edges)[edges])) == 2
    assert packed.label_frames(packed_frames(spark, np.zeros((3, 3))), 3, 3).count() == 0


def test_label_base_zero_labels_the_corner(spark):
    on = np.zeros((3, 3), int)
    on[0, 0] = 255
    assert labelling.components(pixel_table(spark, on), 3, 3, label_base=0).collect()[0].label == 0


def test_prior_neighbours(spark):
    found = labelling.prior_neighbours(pixel_table(spark, np.full((5, 5), 255))).collect()
    near = {}
    for r in found:
        near.setdefault((r.x, r.y), set()).add(5 * r.ny + r.nx)
    assert near[2, 2] == {6, 7, 8, 11} and near[1, 1] == {0, 1, 2, 5} and near[4, 4] == {18, 19, 23} and (0, 0) not in near


def boxes_by(spark, on):
    return {(r.x, r.y, r.width, r.height) for r in boxes.bounding_boxes(labelling.components(pixel_table(spark, on * 255), *on.shape)).collect()}


def test_bounding_boxes(spark):
    two = np.zeros((5, 5), int)
    assert boxes_by(spark, two) == set()
    two[0:2, 0:2] = two[3, 2:4] = 1
    assert boxes_by(spark, two) == {(0, 0, 2, 2), (2, 3, 2, 1)}
    got = packed.boxes_of((two > 0)[None], np.array([7])).to_pylist()
    assert {(r["x"], r["y"], r["width"], r["height"], r["area"]) for r in got} == {(0, 0, 2, 2, 4), (2, 3, 2, 1, 2)} and got[0]["frame_id"] == 7


def test_external_only():
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[2:7, 2:7] = False
    ring[4, 4] = True
    assert packed.boxes_of(ring[None], np.array([0])).num_rows == 2
    assert packed.boxes_of(ring[None], np.array([0]), external=True).num_rows == 1


def test_topk(spark):
    rows = [(0, i, 0, 0, 1, 1, a) for i, a in enumerate([9, 7, 7, 3])] + [(1, 0, 0, 0, 1, 1, 2)]
    b = spark.createDataFrame(rows, "frame_id long, label long, x int, y int, width int, height int, area long")
    kept = lambda k: sorted((r.frame_id, r.area) for r in boxes.topk(b, k).collect())
    assert kept(1) == [(0, 9), (1, 2)]
    assert kept(2) == [(0, 9), (1, 2)]  # both of 7 tie with the third and go
    assert kept(4) == [(0, 3), (0, 7), (0, 7), (0, 9), (1, 2)]
    assert [r.rank for r in boxes.ranked(b).where("frame_id = 0").orderBy("rank").collect()] == [1, 2, 3, 4]


def test_outlines(spark):
    b = spark.createDataFrame([(0, 1, 2, 3, 6, 5, 30)], "frame_id long, label long, x int, y int, width int, height int, area long")
    got = {(r.y, r.x) for r in boxes.outline_pixels(b).collect()}
    assert got == {(y, x) for y, x in itertools.product(range(3, 8), range(2, 8)) if not (y == 5 and 4 <= x <= 5)}


def test_shuffles_once(spark):
    own = stencil.by_frame(pixel_table(spark, BLOBS))
    plan = morphology.dilate_erode(stencil.blur(own, 5, 2.0, 13, 14), 5, 13, 14)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange RoundRobin") == 1


def flooded(free, corners):
    """Pixels that a flood from the corner of the padded frame reaches over ``free`` ones."""
    free = np.pad(free, 1, constant_values=True)
    seen = np.zeros(free.shape, bool)
    seen[0, 0], front = True, [(0, 0)]
    moves = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    while front:
        y, x = front.pop()
        for a, b in moves:
            p = y + a, x + b
            if 0 <= p[0] < free.shape[0] and 0 <= p[1] < free.shape[1] and free[p] and not seen[p]:
                seen[p] = True
                front.append(p)
    return seen[1:-1, 1:-1]


def polygon_area(points):
    return abs(sum(a * d - b * c for (a, b), (c, d) in zip(points, points[1:] + points[:1], strict=True))) / 2


def border_area(part, kind):
    """By triangles between neighbouring pixel middles: the hull of every square's pixels that are on the enclosed side."""
    enclosed = ~flooded(~part, kind == "hole")
    wide, total = np.pad(enclosed, 1), 0.0
    for y, x in itertools.product(range(wide.shape[0] - 1), range(wide.shape[1] - 1)):
        k = [(y + a, x + b) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0)) if wide[y + a, x + b]]
        if kind == "outer":
            total += polygon_area(k) if len(k) > 2 else 0
        else:
            k = [(y + a, x + b) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0)) if not wide[y + a, x + b]]
            total += 0 if len(k) == 4 else 1 - (polygon_area(k) if len(k) == 3 else 0)
    return total


def brute_contours(on):
    labels, out = brute_components(on), set()
    holes = brute_parts(~on & ~flooded(~on, False))
    for kind, parts, grow in (("outer", labels, 0), ("hole", holes, 1)):
        for label in set(parts[parts > 0].tolist()):
            ys, xs = np.nonzero(parts == label)
            box = (int(xs.min()) - grow, int(ys.min()) - grow, int(np.ptp(xs)) + 1 + 2 * grow, int(np.ptp(ys)) + 1 + 2 * grow)
            out.add((kind, label, *box, border_area(parts == label, kind)))
    return out


def brute_parts(off):
    """Labels of parts joined by edges."""
    out = np.zeros(off.shape, int)
    for y, x in itertools.product(*map(range, off.shape)):
        if off[y, x] and not out[y, x]:
            label, front = y * off.shape[1] + x + 1, [(y, x)]
            while front:
                a, b = front.pop()
                if 0 <= a < off.shape[0] and 0 <= b < off.shape[1] and off[a, b] and not out[a, b]:
                    out[a, b] = label
                    front += [(a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)]
    return out


def contours_found(on):
    rows = packed.contours_of(np.stack([np.zeros_like(on), on]), np.array([4, 9])).to_pylist()
    assert all(r["frame_id"] == 9 for r in rows)
    return {tuple(r[c] for c in ("kind", "label", "x", "y", "width", "height", "area")) for r in rows}


def test_contours_of_a_ring_with_a_nested_object():
    ring = np.zeros((11, 12), bool)
    ring[1:9, 1:10] = True
    ring[2:8, 2:9] = False
    ring[4:6, 4:7] = True
    assert contours_found(ring) == {("outer", 14, 1, 1, 9, 8, 56.0), ("hole", 27, 1, 1, 9, 8, 56.0 - 2.0), ("outer", 53, 4, 4, 3, 2, 2.0)}
    lone = np.zeros((5, 5), bool)
    lone[2, 2] = lone[4, 0:3] = True
    assert {r[-1] for r in contours_found(lone)} == {0.0}
    diamond = np.zeros((5, 5), bool)
    diamond[1, 2] = diamond[2, 1] = diamond[2, 3] = diamond[3, 2] = True
    assert {(r[0], r[-1]) for r in contours_found(diamond)} == {("outer", 2.0), ("hole", 2.0)}


def test_contours_by_floods():
    for share in (0.2, 0.45, 0.6, 0.8):
        for _ in range(6):
            on = RNG.random((12, 13)) < share
            assert contours_found(on) == brute_contours(on)


def test_the_fixed_kernel_of_five(spark):
    a = RNG.integers(0, 256, (9, 8))
    wide, line = np.pad(a, 2, mode="reflect"), (1, 4, 6, 4, 1)
    want = (sum(p * q * wide[y : y + 9, x : x + 8] for y, p in enumerate(line) for x, q in enumerate(line)) + 128) >> 8
    assert (as_array(stencil.blur(pixel_table(spark, a), 5, 0, 9, 8, "reflect101"), 9, 8) == want).all()
    assert (packed.blur(a[None].astype(np.uint8), 5, 0, "reflect101")[0] == want).all()
    with pytest.raises(ValueError, match="kernel of 5"):
        stencil.blur(pixel_table(spark, a), 7, 0, 9, 8)


@pytest.mark.parametrize(("h", "w"), [(6, 6), (3, 9), (1, 5), (2, 2)])
def test_small_frames_are_mirrored_again(spark, h, w):
    a = RNG.integers(0, 256, (h, w))
    rel = as_array(stencil.blur(pixel_table(spark, a), 15, 2.0, h, w, "reflect101"), h, w)
    assert (rel == packed.blur(a[None].astype(np.uint8), 15, 2.0, "reflect101")[0]).all()


@pytest.mark.parametrize(("h", "w"), [(64, 64), (63, 130), (5, 200)])
def test_band_products_are_exact(h, w):
    a = RNG.integers(0, 256, (3, h, w), dtype=np.uint8)
    a[1, :, : w // 2], a[2] = 255, 0
    for k, sigma in ((15, 2.0), (15, 5.0), (9, 1.3)):
        total, r = 0, k // 2
        wide = np.pad(a.astype(np.int64), ((0, 0), (r, r), (r, r)))
        from motionframe.functions.kernels import gaussian_taps

        for y, x, v in gaussian_taps(k, sigma):
            total = total + v * wide[:, r + y : r + y + h, r + x : r + x + w]
        assert (packed.blur(a, k, sigma) == (total + packed.HALF) >> 47).all()


def test_nulls_and_repeats(spark):
    rows = [(0, 0, 0, 9), (0, 0, 1, None), (1, 0, 0, 50), (1, 0, 1, 70), (1, 0, 1, 70), (1, None, 0, 5), (None, 0, 0, 5)]
    px = spark.createDataFrame(rows, "frame_id long, y int, x int, v int")
    d = point.abs_diff(px, point.background(px, 0), 0)
    assert sorted((r.x, r.v) for r in d.where("v IS NOT NULL").collect()) == [(0, 41)]
    assert {r.v for r in point.threshold(d, 20).collect()} == {0, 255}
    once = px.where("frame_id IS NULL OR frame_id = 1")
    got = {(r.frame_id, r.y, r.x): r.v for r in stencil.filter2d(once, np.eye(3, dtype=int), 1, 2).collect()}
    assert got == {(1, 0, 0): 50, (1, 0, 1): 140}
    on = spark.createDataFrame([(1, 0, x, v) for x, v in ((0, 255), (0, 255), (1, 255), (2, None))] + [(1, None, 0, 255)], px.schema)
    row = ((0, -1), (0, 0))
    assert [(r.y, r.x) for r in morphology.erode(on, row, 1, 3).collect()] == [(0, 1)]
    assert sorted(r.x for r in morphology.dilate(on, row, 1, 3).collect()) == [0, 1, 2]
    assert {r.label for r in labelling.components(on, 1, 3).collect()} == {1}
    empty = px.where("false")
    for out in (point.threshold(empty, 1), stencil.blur(empty, 3, 2.0, 2, 2), morphology.dilate_erode(empty, 3, 2, 2), labelling.components(empty, 2, 2), boxes.bounding_boxes(labelling.components(empty, 2, 2))):
        assert out.count() == 0
