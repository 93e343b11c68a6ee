"""The engine's queries on the driver's tables, each with SQL that DuckDB runs for the same result.

Frames come from ``embeddings`` (8 x 8 tiles, or 64 x 64 mosaics of them) and, in colour, from ``lineitem``.  All values
are whole numbers; blurs use weights scaled by 2**47, so that sums agree exactly whatever their order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.functions import pixels
from motionframe.functions.kernels import disc, ellipse, gaussian_taps, taps_of
from motionframe.operators import boxes, labelling, morphology, packed, point, stencil
from motionframe.params import PROFILES
from motionframe.plans import detect as D
from motionframe.shared import fresh_path
from motionframe.sources import frames as S
from motionframe.sources import sinks, video

SIDE, MOSAIC = 8, 64
DIFF, DIFF_MOSAIC = 20, 90
CPU = PROFILES["cpu"].but(threshold=DIFF_MOSAIC)
STRESS = CPU.but(morph_ksize=9)
GPU = PROFILES["gpu"].but(threshold=10)
PER_FRAME = PROFILES["gpu_per_frame"].but(threshold=10, morph_ksize=5)
OPENCV = PROFILES["opencv"].but(threshold=50, morph_ksize=3)
ERODE_DILATE = CPU.but(morphology="erode_dilate", morph_ksize=5)
PROTOTYPE = 75
KERNEL = np.eye(3, dtype=int)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tiles(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mosaics(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.order_frames(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"))


def first_tile(spark: SparkSession, sf_dir: str) -> int:
    return S.first_number(table(spark, sf_dir, "embeddings"))


def first_mosaic(spark: SparkSession, sf_dir: str) -> int:
    return S.first_number(table(spark, sf_dir, "embeddings"), per_frame=SIDE * SIDE)


def tile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, bg = tiles(spark, sf_dir), first_tile(spark, sf_dir)
    return point.abs_diff(px, point.background(px, bg), bg)


def mosaic_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, bg = mosaics(spark, sf_dir), first_mosaic(spark, sf_dir)
    return point.threshold(point.abs_diff(px, point.background(px, bg), bg), DIFF_MOSAIC)


def packed_mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pack(mosaics(spark, sf_dir), MOSAIC, MOSAIC)


def tile_binary(spark: SparkSession, sf_dir: str, on: int = 255) -> DataFrame:
    return stencil.by_frame(point.threshold(tile_diff(spark, sf_dir), DIFF, on))


def mosaic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.label_frames(S.pack(mosaic_binary(spark, sf_dir), MOSAIC, MOSAIC), MOSAIC, MOSAIC)


def detected(p, plan: str = "auto"):
    return lambda spark, sf_dir: D.detect(mosaics(spark, sf_dir), p, plan, MOSAIC, MOSAIC, first_mosaic(spark, sf_dir))


def stress_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(STRESS)(spark, sf_dir)


def gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(gaussian_taps(15, 2.0)), "dy int, dx int, w long")


def circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [(k, dy, dx) for k in (1, 3, 5, 7, 9, 15) for dy, dx in disc(k)]
    return spark.createDataFrame(sizes, "ksize int, dy int, dx int")


def detect_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaics replayed as a stream of files, against the first as given background."""
    from motionframe.streaming import detect as T

    folder = fresh_path(spark, "stream")
    packed_mosaics(spark, sf_dir).write.parquet(f"{folder}/frames")
    still = spark.read.schema(S.PACKED).parquet(f"{folder}/frames")
    bg_id, background = D.first_frame(still)
    stream = T.read_frames(spark, f"{folder}/frames").where(F.col("frame_id") != bg_id)
    T.run_to_end(T.detect_stream(stream, background, CPU), f"{folder}/boxes", f"{folder}/checkpoint")
    return spark.read.schema(packed.BOXES).parquet(f"{folder}/boxes")


def stream_first_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaics as two captures' streams, odd and even ones: each against its own first frame, which is kept as state."""
    from motionframe.streaming import detect as T

    folder = fresh_path(spark, "stream")
    capture = F.when(F.col("frame_id") % 2 == 0, "even").otherwise("odd").alias("capture")
    packed_mosaics(spark, sf_dir).select(capture, "*").write.parquet(f"{folder}/frames")
    stream = spark.readStream.schema(T.CAPTURED).parquet(f"{folder}/frames")
    T.run_to_end(T.with_first_frame(stream, CPU), f"{folder}/boxes", f"{folder}/checkpoint")
    return spark.read.schema(f"capture string, {packed.BOXES}").parquet(f"{folder}/boxes")


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaics written as PNG files and read again."""
    folder = fresh_path(spark, "png")
    sinks.write_pngs(packed_mosaics(spark, sf_dir), folder)
    return S.unpack(S.read_images(spark, folder))


def video_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaics written as a video and read again."""
    path = f"{fresh_path(spark, 'video')}/mosaics.y4m"
    sinks.write_y4m(packed_mosaics(spark, sf_dir), path, MOSAIC, MOSAIC)
    spark.dataSource.register(video.Y4M)
    return S.unpack(spark.read.format("y4m").load(path))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mosaic beside itself with the outlines of its objects."""
    out = packed.render(packed_mosaics(spark, sf_dir), detected(CPU)(spark, sf_dir))
    return S.unpack_bgr(out.drop("text"))


def overlay_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that goes along with each mosaic, as if frame i took i + 1 eighths of a millisecond."""
    frames = packed_mosaics(spark, sf_dir)
    none = spark.createDataFrame([], packed.BOXES)
    return packed.render(frames, none, text=packed.rate_text((F.col("frame_id") + 1) / 8), side_by_side=False).select("frame_id", "width", "text")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the report doesn't depend on the clock: the stages, their frames, and that times and shares are sound."""
    out = D.stage_report(packed_mosaics(spark, sf_dir), CPU, first_mosaic(spark, sf_dir))
    sound = (F.col("total_ms") > 0) & (F.abs(F.col("frame_avg_ms") * F.col("frames") - F.col("total_ms")) < 1e-6) & F.col("percent").between(0, 100)
    return out.select("stage", "frames", sound.alias("sound"))


def in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of arrays in memory, whose values go beyond a byte."""
    f, y, x = np.meshgrid(np.arange(3), np.arange(5), np.arange(7), indexing="ij")
    return S.unpack(S.from_arrays(spark, list((f * 100 + y * 7 + x) * 13)))


def rounded_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of whole numbers on both sides of 0, to the nearest whole number."""
    half = (F.col("l_orderkey") - 2 * F.col("l_suppkey") - 20001) / F.lit(2.0)
    return table(spark, sf_dir, "lineitem").select(half.alias("half")).groupBy("half").agg(F.count("*").alias("n")).select("half", "n", pixels.rounded(F.col("half")).alias("whole"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture from its beginning twice, and what moves in it."""
    twice = S.replay(point.moving_pixels(mosaic_binary(spark, sf_dir)), 2)
    return twice.select("pass", "frame_id", "n_moving")


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All borders of the mosaics' objects, grown by a pixel: outer and nested ones, and those of holes."""
    grown = morphology.dilate(stencil.by_frame(mosaic_binary(spark, sf_dir)), disc(5), MOSAIC, MOSAIC)
    return packed.contour_frames(S.pack(grown, MOSAIC, MOSAIC), MOSAIC, MOSAIC)


def blurred(sigma: float, border: str = "zero"):
    return lambda spark, sf_dir: stencil.blur(stencil.by_frame(tiles(spark, sf_dir)), 15, sigma, SIDE, SIDE, border)


def bgr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pixels packed into frames of 32 x 32 and unpacked again; pixels that no order line has are 0."""
    return S.unpack_bgr(S.pack(colours(spark, sf_dir), 32, 32, ("b", "g", "r")))


QUERIES = {
    "frame_metadata": lambda s, d: S.metadata(mosaics(s, d), 50.0),
    "unpack_pixels": lambda s, d: S.unpack(S.pack(tiles(s, d), SIDE, SIDE)),
    "unpack_bgr": bgr_round_trip,
    "grayscale_cpu": lambda s, d: point.grayscale(colours(s, d), "cpu"),
    "grayscale_gpu_weights": lambda s, d: point.grayscale(colours(s, d), "gpu"),
    "grayscale_rounded": lambda s, d: point.grayscale(colours(s, d), "rounded"),
    "background_first_frame": lambda s, d: point.background(tiles(s, d), first_tile(s, d)),
    "abs_diff": tile_diff,
    "threshold_ge": lambda s, d: point.threshold(tile_diff(s, d), DIFF),
    "threshold_strict": lambda s, d: point.threshold(tile_diff(s, d), DIFF, strict=True),
    "moving_pixels_per_frame": lambda s, d: point.moving_pixels(point.threshold(tile_diff(s, d), DIFF)),
    "gaussian_taps": gaussian,
    "circle_kernel": circle,
    "filter2d_custom": lambda s, d: stencil.filter2d(stencil.by_frame(tiles(s, d)), KERNEL, SIDE, SIDE),
    "blur_sigma02": blurred(0.2),
    "blur_sigma2": blurred(2.0),
    "blur_reflect101": blurred(2.0, "reflect101"),
    "dilate_255": lambda s, d: morphology.dilate(tile_binary(s, d), disc(5), SIDE, SIDE),
    "erode_255": lambda s, d: morphology.erode(tile_binary(s, d), disc(5), SIDE, SIDE),
    "dilate_1": lambda s, d: morphology.dilate(tile_binary(s, d, 1), disc(5), SIDE, SIDE, 1),
    "erode_1": lambda s, d: morphology.erode(tile_binary(s, d, 1), disc(5), SIDE, SIDE, 1),
    "dilate_erode": lambda s, d: morphology.dilate_erode(tile_binary(s, d), 5, SIDE, SIDE),
    "erode_dilate": lambda s, d: morphology.erode_dilate(tile_binary(s, d), 5, SIDE, SIDE),
    "dilate_window_runs": lambda s, d: morphology.dilate_by_runs(mosaic_binary(s, d), 15),
    "open_neutral": lambda s, d: morphology.open_neutral(tile_binary(s, d), 5, SIDE, SIDE),
    "grayscale_open": lambda s, d: morphology.gray_open(stencil.by_frame(tiles(s, d)), disc(5), SIDE, SIDE),
    "label_neighbours": lambda s, d: labelling.prior_neighbours(mosaic_binary(s, d)),
    "connected_components": mosaic_labels,
    "connected_components_relational": lambda s, d: labelling.components(stencil.by_frame(mosaic_binary(s, d)), MOSAIC, MOSAIC),
    "bounding_boxes": lambda s, d: boxes.bounding_boxes(mosaic_labels(s, d)),
    "box_area_sort": lambda s, d: boxes.ranked(stress_boxes(s, d)),
    "topk_boxes": lambda s, d: boxes.topk(stress_boxes(s, d), 3),
    "detect_cpu_profile": detected(CPU),
    "detect_gpu_profile": detected(GPU),
    "detect_dilate_only": detected(PER_FRAME),
    "detect_opencv_like": detected(OPENCV),
    "detect_prototype": lambda s, d: D.detect_prototype(mosaics(s, d), MOSAIC, MOSAIC, 2, PROTOTYPE, bg_id=first_mosaic(s, d)),
    "detect_relational": detected(STRESS, "relational"),
    "detect_label_base_0": detected(CPU.but(label_base=0)),
    "detect_erode_dilate": detected(ERODE_DILATE),
    "contours": contours,
    "stream_first_frame": stream_first_frame,
    "image_files": image_files,
    "video_file": video_file,
    "render_side_by_side": rendered,
    "overlay_text": overlay_text,
    "stage_report": report,
    "frames_from_arrays": in_memory,
    "round_half_away": rounded_halves,
    "replay": replayed,
    "printed_frames": lambda s, d: packed.printed(S.pack(tiles(s, d), SIDE, SIDE)),
    "detect_streaming": detect_streaming,
    "render_boxes_mask": lambda s, d: boxes.outline_pixels(detected(CPU)(s, d)),
    "stage_summary": lambda s, d: D.stage_summary(mosaics(s, d), CPU, MOSAIC, MOSAIC, first_mosaic(s, d)),
}

# ---------------------------------------------------------------------------------------------------------------------
# SQL.  Each text is a chain of common table expressions ("name AS (...)") and a last SELECT.

V = "CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (CAST(e AS DOUBLE) + 0.6::DOUBLE) * 212.5::DOUBLE))) AS INTEGER)"
TILES = f"""raw AS (SELECT CAST(vec_id AS BIGINT) AS frame_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
px AS (SELECT frame_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {V} AS v FROM raw)"""
MOSAICS = f"""raw AS (SELECT CAST(vec_id AS BIGINT) AS id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
tile AS (SELECT id // 64 AS frame_id, CAST((id % 64) // 8 * 8 + i // 8 AS INTEGER) AS y, CAST((id % 64) % 8 * 8 + i % 8 AS INTEGER) AS x, {V} AS v FROM raw),
px AS MATERIALIZED (SELECT f.frame_id, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, coalesce(tile.v, 0) AS v
  FROM (SELECT DISTINCT frame_id FROM tile) f, (SELECT unnest(range(64)) AS gy), (SELECT unnest(range(64)) AS gx)
  LEFT JOIN tile ON tile.frame_id = f.frame_id AND tile.y = gy AND tile.x = gx)"""
COLOURS = """px AS (SELECT CAST(l_suppkey AS BIGINT) AS frame_id, CAST(l_partkey % 32 AS INTEGER) AS y, CAST(l_orderkey % 32 AS INTEGER) AS x,
  max(CAST(l_partkey % 256 AS INTEGER)) AS b, max(CAST(l_orderkey % 256 AS INTEGER)) AS g, max(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 256 AS INTEGER)) AS r
  FROM lineitem GROUP BY 1, 2, 3)"""


def values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(str, r)) + ')' for r in rows)}) AS t({names})"


def query(*steps: str, last: str) -> str:
    return f"WITH RECURSIVE {', '.join(steps)} {last}"


def diff(source: str = "px") -> str:
    return f"""d AS (SELECT p.frame_id, p.y, p.x, CAST(abs(p.v - q.v) AS INTEGER) AS v FROM {source} p JOIN {source} q USING (y, x)
  WHERE q.frame_id = (SELECT min(frame_id) FROM {source}) AND p.frame_id <> q.frame_id)"""


def thresholded(value: int, maxval: int = 255, strict: bool = False, name: str = "b") -> str:
    return f"{name} AS (SELECT frame_id, y, x, CASE WHEN v {'>' if strict else '>='} {value} THEN {maxval} ELSE 0 END AS v FROM d)"


def correlation(taps, n: int, source: str = "px", name: str = "s") -> str:
    return f"""{name} AS (SELECT frame_id, y - dy AS y, x - dx AS x, sum(v * w)::BIGINT AS s FROM {source}, {values(taps, 'dy, dx, w')}
  WHERE y - dy BETWEEN 0 AND {n - 1} AND x - dx BETWEEN 0 AND {n - 1} GROUP BY 1, 2, 3)"""


def mirrored(taps, n: int, reach: int = 7, source: str = "px") -> str:
    rows = cols = stencil.axis(n, reach, "reflect101")
    return f"""s AS (SELECT p.frame_id, a.ty AS y, c.tx AS x, sum(p.v * k.w)::BIGINT AS s FROM {source} p
  JOIN (SELECT * FROM {values(rows, 'y, ty, dy')}) a ON p.y = a.y JOIN (SELECT * FROM {values(cols, 'x, tx, dx')}) c ON p.x = c.x
  JOIN (SELECT * FROM {values(taps, 'dy, dx, w')}) k ON k.dy = a.dy AND k.dx = c.dx GROUP BY 1, 2, 3)"""


def shifted(taps, n: int, source: str, what: str, having: str = "") -> str:
    return f"""SELECT frame_id, CAST(y - dy AS INTEGER) AS y, CAST(x - dx AS INTEGER) AS x, {what} AS v FROM {source}, {values(taps, 'dy, dx')}
  WHERE y - dy BETWEEN 0 AND {n - 1} AND x - dx BETWEEN 0 AND {n - 1} {having}"""


def dilation(taps, n: int, source: str, name: str, on: int = 255) -> str:
    return f"{name} AS ({shifted(taps, n, source, str(on), 'AND v % 2 = 1')} GROUP BY 1, 2, 3)"


def erosion(taps, n: int, source: str, name: str, on: int = 255) -> str:
    return f"{name} AS ({shifted(taps, n, source, str(on), 'AND v % 2 = 1')} GROUP BY 1, 2, 3 HAVING count(*) = {len(taps)})"


def erosion_neutral(taps, n: int, source: str, name: str) -> str:
    inside = [(y, x, sum(0 <= y + dy < n and 0 <= x + dx < n for dy, dx in taps)) for y in range(n) for x in range(n)]
    return f"""{name}0 AS (SELECT frame_id, y - dy AS y, x - dx AS x, count(*) AS c FROM {source}, {values(taps, 'dy, dx')} WHERE v % 2 = 1 GROUP BY 1, 2, 3),
{name} AS (SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, 255 AS v FROM {name}0 JOIN {values(inside, 'y, x, m')} USING (y, x) WHERE c = m)"""


def labels(n: int, source: str) -> str:
    return f"""f AS MATERIALIZED (SELECT frame_id, y, x, y * {n} + x AS i FROM {source} WHERE v % 2 = 1),
e AS MATERIALIZED (SELECT a.frame_id, a.i AS a, c.i AS b FROM f a, {values([(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x], 'dy, dx')}
  JOIN f c ON c.frame_id = a.frame_id AND c.y = a.y + dy AND c.x = a.x + dx),
reach AS (SELECT frame_id, i, i AS l FROM f UNION SELECT r.frame_id, e.b, r.l FROM reach r JOIN e ON e.frame_id = r.frame_id AND e.a = r.i WHERE r.l < e.b),
lab AS (SELECT frame_id, CAST(i // {n} AS INTEGER) AS y, CAST(i % {n} AS INTEGER) AS x, CAST(min(l) + 1 AS BIGINT) AS label FROM reach GROUP BY frame_id, i)"""


BOX = """box AS (SELECT frame_id, label, min(x) AS x, min(y) AS y, CAST(max(x) - min(x) + 1 AS INTEGER) AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height,
  count(*) AS area FROM lab GROUP BY frame_id, label)"""
ROUND = "CAST((s + 70368744177664) >> 47 AS INTEGER)"
PIXELS = "frame_id, y, x, v"


def blur_steps(p, n: int) -> list[str]:
    return [correlation(gaussian_taps(p.ksize, p.sigma), n), f"g AS (SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {ROUND} AS v FROM s)"]


def morph_steps(p, n: int) -> list[str]:
    taps = disc(p.morph_ksize)
    if p.morphology == "dilate":
        return [dilation(taps, n, "b", "m")]
    if p.morphology == "dilate_erode":
        return [dilation(taps, n, "b", "m1"), erosion(taps, n, "m1", "m")]
    if p.morphology == "erode_dilate":
        return [erosion(taps, n, "b", "m1"), dilation(taps, n, "m1", "m")]
    return [erosion_neutral(ellipse(p.morph_ksize), n, "b", "m1"), dilation(ellipse(p.morph_ksize), n, "m1", "m")]


def detect_sql(p, last: str = "SELECT * FROM box", *more: str) -> str:
    """For these frames sigma 0.2 leaves every pixel as it is, whatever the border, so one blur serves all profiles."""
    steps = [MOSAICS, *blur_steps(p, MOSAIC), diff("g"), thresholded(p.threshold, p.maxval, p.strict), *morph_steps(p, MOSAIC)]
    return query(*steps, labels(MOSAIC, "m"), BOX, *more, last=last)


OUTER = f"""grid AS (SELECT DISTINCT frame_id, gy, gx FROM (SELECT DISTINCT frame_id FROM m), (SELECT unnest(range(-1, {MOSAIC + 1})) AS gy), (SELECT unnest(range(-1, {MOSAIC + 1})) AS gx)),
off AS MATERIALIZED (SELECT g.frame_id, gy, gx FROM grid g LEFT JOIN m ON m.frame_id = g.frame_id AND m.y = gy AND m.x = gx WHERE m.v IS NULL),
outer_ AS (SELECT frame_id, gy, gx FROM off WHERE gy = -1 AND gx = -1 UNION SELECT o.frame_id, o.gy, o.gx FROM outer_ r,
  {values([(-1, 0), (1, 0), (0, -1), (0, 1)], 'dy, dx')} JOIN off o ON o.frame_id = r.frame_id AND o.gy = r.gy + dy AND o.gx = r.gx + dx),
seen AS (SELECT DISTINCT l.frame_id, l.label FROM lab l, {values([(-1, 0), (1, 0), (0, -1), (0, 1)], 'dy, dx')}
  JOIN outer_ o ON o.frame_id = l.frame_id AND o.gy = l.y + dy AND o.gx = l.x + dx)"""
#: Borders.  A hole is a part of the background, joined by edges, that isn't joined with the outside.  What a border
#: encloses is what a flood from outside doesn't reach: by edges around a component, by corners too around a hole.
#: Its area counts squares between four pixels, whole ones and halves.
BORDERS = f"""hole AS MATERIALIZED (SELECT o.frame_id, o.gy AS y, o.gx AS x, o.gy * {MOSAIC} + o.gx AS i FROM off o ANTI JOIN outer_ r ON r.frame_id = o.frame_id AND r.gy = o.gy AND r.gx = o.gx),
he AS MATERIALIZED (SELECT a.frame_id, a.i AS a, c.i AS b FROM hole a, {values([(-1, 0), (1, 0), (0, -1), (0, 1)], 'dy, dx')} JOIN hole c ON c.frame_id = a.frame_id AND c.y = a.y + dy AND c.x = a.x + dx),
hr AS (SELECT frame_id, i, i AS l FROM hole UNION SELECT r.frame_id, he.b, r.l FROM hr r JOIN he ON he.frame_id = r.frame_id AND he.a = r.i WHERE r.l < he.b),
part AS MATERIALIZED (SELECT frame_id, 'outer' AS kind, label, y, x FROM lab
  UNION ALL SELECT frame_id, 'hole', CAST(min(l) + 1 AS BIGINT), i // {MOSAIC}, i % {MOSAIC} FROM hr GROUP BY frame_id, i),
win AS MATERIALIZED (SELECT frame_id, kind, label, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM part GROUP BY 1, 2, 3),
flood AS (SELECT frame_id, kind, label, y0 AS y, x0 AS x FROM win UNION SELECT f.frame_id, f.kind, f.label, f.y + dy, f.x + dx
  FROM flood f JOIN win w ON w.frame_id = f.frame_id AND w.kind = f.kind AND w.label = f.label
  JOIN {values([(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x], 'dy, dx')} ON f.kind = 'hole' OR dy = 0 OR dx = 0
  LEFT JOIN part p ON p.frame_id = f.frame_id AND p.kind = f.kind AND p.label = f.label AND p.y = f.y + dy AND p.x = f.x + dx
  WHERE p.y IS NULL AND f.y + dy BETWEEN y0 AND y1 AND f.x + dx BETWEEN x0 AND x1),
inside AS (SELECT w.frame_id, w.kind, w.label, gy AS y, gx AS x FROM win w, (SELECT unnest(range(-1, {MOSAIC + 1})) AS gy), (SELECT unnest(range(-1, {MOSAIC + 1})) AS gx)
  WHERE gy BETWEEN y0 AND y1 AND gx BETWEEN x0 AND x1 AND NOT EXISTS (SELECT 1 FROM flood f WHERE f.frame_id = w.frame_id AND f.kind = w.kind AND f.label = w.label AND f.y = gy AND f.x = gx)),
square AS (SELECT frame_id, kind, label, y - sy, x - sx, count(*) AS k FROM inside, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(sy, sx) GROUP BY 1, 2, 3, 4, 5),
size AS (SELECT frame_id, kind, label, sum(CASE WHEN kind = 'hole' THEN CASE WHEN k = 1 THEN 0.5::DOUBLE ELSE 1 END ELSE CASE k WHEN 4 THEN 1 WHEN 3 THEN 0.5::DOUBLE ELSE 0 END END) AS area FROM square GROUP BY 1, 2, 3),
border AS (SELECT frame_id, kind, label, CAST(CASE kind WHEN 'hole' THEN x0 ELSE x0 + 1 END AS INTEGER) AS x, CAST(CASE kind WHEN 'hole' THEN y0 ELSE y0 + 1 END AS INTEGER) AS y,
  CAST(x1 - x0 + CASE kind WHEN 'hole' THEN 1 ELSE -1 END AS INTEGER) AS width, CAST(y1 - y0 + CASE kind WHEN 'hole' THEN 1 ELSE -1 END AS INTEGER) AS height, area
  FROM win JOIN size USING (frame_id, kind, label))"""
RANKED = "rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, label) AS INTEGER) AS rank FROM box)"
TILE_B = [TILES, diff(), thresholded(DIFF)]
TILE_1 = [TILES, diff(), thresholded(DIFF, 1)]
MOSAIC_B = [MOSAICS, diff(), thresholded(DIFF_MOSAIC)]
T5 = disc(5)
BLUR_LAST = f"SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {ROUND} AS v FROM s"


def gaussian_sql(k: int, sigma: float) -> str:
    r = k // 2
    return f"""WITH a AS (SELECT CAST(exp(-(y * y + x * x)::DOUBLE / (2 * {sigma}::DOUBLE * {sigma}::DOUBLE)) / (2 * pi() * {sigma}::DOUBLE * {sigma}::DOUBLE) AS FLOAT) AS t, y, x
  FROM (SELECT unnest(range(-{r}, {r + 1})) AS y), (SELECT unnest(range(-{r}, {r + 1})) AS x)),
n AS (SELECT sum(t::DOUBLE) AS s FROM a)
SELECT CAST(y AS INTEGER) AS dy, CAST(x AS INTEGER) AS dx, CAST(round(CAST(t::DOUBLE / s AS FLOAT)::DOUBLE * 140737488355328::DOUBLE) AS BIGINT) AS w FROM a, n"""


def summary_sql(p) -> str:
    one = lambda name, source, on: f"SELECT '{name}' AS stage, count(DISTINCT frame_id) AS n_frames, count(*) AS n_pixels, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM {source} WHERE {on}"
    parts = [one("grayscale", "px", "v <> 0"), one("blur", "g", "v <> 0"), one("diff", "d", "v <> 0"), one("threshold", "b", "v % 2 = 1"), one("morphology", "m", "v % 2 = 1")]
    return query(MOSAICS, *blur_steps(p, MOSAIC), diff("g"), thresholded(p.threshold), *morph_steps(p, MOSAIC), last=" UNION ALL ".join(parts))


SQL = {
    "frame_metadata": query(MOSAICS, last="SELECT count(DISTINCT frame_id) AS frame_count, CAST(max(y) + 1 AS INTEGER) AS height, CAST(max(x) + 1 AS INTEGER) AS width, 50.0::DOUBLE AS fps, 1000.0::DOUBLE * count(DISTINCT frame_id) / 50.0::DOUBLE AS duration_ms FROM px"),
    "unpack_pixels": query(TILES, last=f"SELECT {PIXELS} FROM px"),
    "unpack_bgr": query(COLOURS, last="""SELECT f.frame_id, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r
  FROM (SELECT DISTINCT frame_id FROM px) f, (SELECT unnest(range(32)) AS gy), (SELECT unnest(range(32)) AS gx) LEFT JOIN px ON px.frame_id = f.frame_id AND px.y = gy AND px.x = gx"""),
    "grayscale_cpu": query(COLOURS, last="SELECT frame_id, y, x, CAST(floor(r * 0.2989::DOUBLE + g * 0.5870::DOUBLE + b * 0.1140::DOUBLE) AS INTEGER) AS v FROM px"),
    "grayscale_gpu_weights": query(COLOURS, last="SELECT frame_id, y, x, CAST(floor(0.299::FLOAT * b::FLOAT + 0.587::FLOAT * g::FLOAT + 0.114::FLOAT * r::FLOAT) AS INTEGER) AS v FROM px"),
    "grayscale_rounded": query(COLOURS, last="SELECT frame_id, y, x, CAST((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS INTEGER) AS v FROM px"),
    "background_first_frame": query(TILES, last="SELECT y, x, v AS bg FROM px WHERE frame_id = (SELECT min(frame_id) FROM px)"),
    "abs_diff": query(TILES, diff(), last=f"SELECT {PIXELS} FROM d"),
    "threshold_ge": query(*TILE_B, last=f"SELECT {PIXELS} FROM b"),
    "threshold_strict": query(TILES, diff(), thresholded(DIFF, strict=True), last=f"SELECT {PIXELS} FROM b"),
    "moving_pixels_per_frame": query(*TILE_B, last="SELECT frame_id, count(*) FILTER (v % 2 = 1) AS n_moving FROM b GROUP BY frame_id"),
    "gaussian_taps": gaussian_sql(15, 2.0),
    "circle_kernel": "SELECT CAST(k AS INTEGER) AS ksize, CAST(y AS INTEGER) AS dy, CAST(x AS INTEGER) AS dx FROM (SELECT unnest([1, 3, 5, 7, 9, 15]) AS k), (SELECT unnest(range(-7, 8)) AS y), (SELECT unnest(range(-7, 8)) AS x) WHERE y * y + x * x < (k // 2) * (k // 2)",
    "filter2d_custom": query(TILES, correlation(taps_of(KERNEL), SIDE), last="SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(s AS INTEGER) AS v FROM s"),
    "blur_sigma02": query(TILES, correlation(gaussian_taps(15, 0.2), SIDE), last=BLUR_LAST),
    "blur_sigma2": query(TILES, correlation(gaussian_taps(15, 2.0), SIDE), last=BLUR_LAST),
    "blur_reflect101": query(TILES, mirrored(gaussian_taps(15, 2.0), SIDE), last=BLUR_LAST),
    "dilate_255": query(*TILE_B, dilation(T5, SIDE, "b", "m"), last=f"SELECT {PIXELS} FROM m"),
    "erode_255": query(*TILE_B, erosion(T5, SIDE, "b", "m"), last=f"SELECT {PIXELS} FROM m"),
    "dilate_1": query(*TILE_1, dilation(T5, SIDE, "b", "m", 1), last=f"SELECT {PIXELS} FROM m"),
    "erode_1": query(*TILE_1, erosion(T5, SIDE, "b", "m", 1), last=f"SELECT {PIXELS} FROM m"),
    "dilate_erode": query(*TILE_B, dilation(T5, SIDE, "b", "m1"), erosion(T5, SIDE, "m1", "m"), last=f"SELECT {PIXELS} FROM m"),
    "erode_dilate": query(*TILE_B, erosion(T5, SIDE, "b", "m1"), dilation(T5, SIDE, "m1", "m"), last=f"SELECT {PIXELS} FROM m"),
    "dilate_window_runs": query(*MOSAIC_B, dilation(disc(15), MOSAIC, "b", "m"), last="SELECT b.frame_id, b.y, b.x, coalesce(m.v, 0) AS v FROM b LEFT JOIN m USING (frame_id, y, x)"),
    "open_neutral": query(*TILE_B, erosion_neutral(ellipse(5), SIDE, "b", "m1"), dilation(ellipse(5), SIDE, "m1", "m"), last=f"SELECT {PIXELS} FROM m"),
    "grayscale_open": query(TILES, f"m1 AS ({shifted(T5, SIDE, 'px', 'min(v)')} GROUP BY 1, 2, 3)", f"m AS ({shifted(T5, SIDE, 'm1', 'max(v)')} GROUP BY 1, 2, 3)", last=f"SELECT {PIXELS} FROM m"),
    "label_neighbours": query(*MOSAIC_B, last=f"""SELECT a.frame_id, a.y, a.x, c.y AS ny, c.x AS nx FROM b a, {values(labelling.PRIOR, 'dy, dx')}
  JOIN b c ON c.frame_id = a.frame_id AND c.y = a.y + dy AND c.x = a.x + dx WHERE a.v % 2 = 1 AND c.v % 2 = 1"""),
    "connected_components": query(*MOSAIC_B, labels(MOSAIC, "b"), last="SELECT frame_id, y, x, label FROM lab"),
    "connected_components_relational": query(*MOSAIC_B, labels(MOSAIC, "b"), last="SELECT frame_id, y, x, label FROM lab"),
    "bounding_boxes": query(*MOSAIC_B, labels(MOSAIC, "b"), BOX, last="SELECT * FROM box"),
    "box_area_sort": detect_sql(STRESS, "SELECT * FROM rk", RANKED),
    "topk_boxes": detect_sql(STRESS, "SELECT frame_id, label, x, y, width, height, area FROM (SELECT *, max(CASE WHEN rank = 4 THEN area END) OVER (PARTITION BY frame_id) AS cut FROM rk) WHERE cut IS NULL OR area > cut", RANKED),
    "detect_cpu_profile": detect_sql(CPU),
    "detect_gpu_profile": detect_sql(GPU),
    "detect_dilate_only": detect_sql(PER_FRAME),
    "detect_opencv_like": detect_sql(OPENCV, "SELECT box.* FROM box SEMI JOIN seen USING (frame_id, label)", OUTER),
    "detect_prototype": query(
        MOSAICS, "first AS (SELECT * FROM px WHERE frame_id = (SELECT min(frame_id) FROM px))",
        f"""line AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([1, 4, 6, 4, 1]) AS w),
soft AS (SELECT t.frame_id, t.y, t.x, (sum(a.w * c.w * p.v)::BIGINT + 128) >> 8 AS v FROM first t, line a, line c JOIN first p
  ON p.y = CASE WHEN t.y + a.d < 0 THEN -t.y - a.d WHEN t.y + a.d > {MOSAIC - 1} THEN {2 * MOSAIC - 2} - t.y - a.d ELSE t.y + a.d END
  AND p.x = CASE WHEN t.x + c.d < 0 THEN -t.x - c.d WHEN t.x + c.d > {MOSAIC - 1} THEN {2 * MOSAIC - 2} - t.x - c.d ELSE t.x + c.d END GROUP BY 1, 2, 3),
d AS (SELECT p.frame_id, p.y, p.x, CAST(abs(p.v - s.v) AS INTEGER) AS v FROM px p JOIN soft s USING (y, x) WHERE p.frame_id <> s.frame_id)""",
        f"o1 AS ({shifted(((-1, 0), (0, 0)), MOSAIC, 'd', 'min(v)')} GROUP BY 1, 2, 3)", f"o AS ({shifted(((-1, 0), (0, 0)), MOSAIC, 'o1', 'max(v)')} GROUP BY 1, 2, 3)",
        f"m AS (SELECT frame_id, y, x, 255 AS v FROM o WHERE v > {PROTOTYPE})", labels(MOSAIC, "m"), OUTER, BORDERS,
        "rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, label) AS rank FROM border)",
        last="SELECT frame_id, kind, label, x, y, width, height, area FROM (SELECT *, max(CASE WHEN rank = 3 THEN area END) OVER (PARTITION BY frame_id) AS cut FROM rk) WHERE cut IS NULL OR area > cut",
    ),
    "contours": query(*MOSAIC_B, dilation(T5, MOSAIC, "b", "m"), labels(MOSAIC, "m"), OUTER, BORDERS, last="SELECT * FROM border"),
    "detect_label_base_0": detect_sql(CPU, "SELECT frame_id, label - 1 AS label, x, y, width, height, area FROM box"),
    "detect_erode_dilate": detect_sql(ERODE_DILATE),
    "stream_first_frame": query(
        MOSAICS, *blur_steps(CPU, MOSAIC), "own AS (SELECT CASE WHEN frame_id % 2 = 0 THEN 'even' ELSE 'odd' END AS capture, * FROM g)",
        "d AS (SELECT p.frame_id, p.y, p.x, CAST(abs(p.v - q.v) AS INTEGER) AS v FROM own p JOIN own q USING (capture, y, x) JOIN (SELECT capture, min(frame_id) AS f FROM own GROUP BY 1) h ON h.f = q.frame_id WHERE p.frame_id <> q.frame_id)",
        thresholded(CPU.threshold), *morph_steps(CPU, MOSAIC), labels(MOSAIC, "m"), BOX, last="SELECT CASE WHEN frame_id % 2 = 0 THEN 'even' ELSE 'odd' END AS capture, * FROM box",
    ),
    "image_files": query(MOSAICS, last="SELECT dense_rank() OVER (ORDER BY frame_id) - 1 AS frame_id, y, x, v FROM px"),
    "video_file": query(MOSAICS, last="SELECT dense_rank() OVER (ORDER BY frame_id) - 1 AS frame_id, y, x, v FROM px"),
    "render_side_by_side": detect_sql(CPU, """SELECT px.frame_id, px.y, CAST(px.x + side * 64 AS INTEGER) AS x, CASE WHEN side = 1 AND e.y IS NOT NULL THEN 0 ELSE px.v END AS b,
  CASE WHEN side = 1 AND e.y IS NOT NULL THEN 0 ELSE px.v END AS g, CASE WHEN side = 1 AND e.y IS NOT NULL THEN 255 ELSE px.v END AS r
  FROM px, (SELECT unnest([0, 1]) AS side) LEFT JOIN edge e ON e.frame_id = px.frame_id AND e.y = px.y AND e.x = px.x""",
        """edge AS (SELECT DISTINCT frame_id, y + a AS y, x + c AS x FROM (SELECT box.*, unnest(range(height)) AS a FROM box) q, (SELECT unnest(range(64)) AS c)
  WHERE c < width AND (a < 2 OR a >= height - 2 OR c < 2 OR c >= width - 2))"""),
    "overlay_text": query(MOSAICS, last="SELECT frame_id, 64 AS width, printf('Fps: %.2f', 1000::DOUBLE / ((frame_id + 1) / 8::DOUBLE)) AS text FROM px GROUP BY frame_id"),
    "stage_report": query(MOSAICS, last="SELECT unnest(['grayscale', 'blur', 'difference', 'threshold', 'morphology', 'components and boxes']) AS stage, count(DISTINCT frame_id) - 1 AS frames, true AS sound FROM px"),
    "frames_from_arrays": "SELECT f AS frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((f * 100 + y * 7 + x) * 13 % 256 AS INTEGER) AS v FROM (SELECT unnest(range(3)) AS f), (SELECT unnest(range(5)) AS y), (SELECT unnest(range(7)) AS x)",
    "round_half_away": "SELECT (l_orderkey - 2 * l_suppkey - 20001) / 2::DOUBLE AS half, count(*) AS n, CAST(round((l_orderkey - 2 * l_suppkey - 20001) / 2::DOUBLE) AS INTEGER) AS whole FROM lineitem GROUP BY 1",
    "replay": query(*MOSAIC_B, last="SELECT pass, frame_id, n_moving FROM (SELECT frame_id, count(*) FILTER (v % 2 = 1) AS n_moving FROM b GROUP BY frame_id), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS pass)"),
    "printed_frames": query(TILES, "l AS (SELECT frame_id, y, string_agg(lpad(v::VARCHAR, 3, ' ') || ' ', '' ORDER BY x) AS line FROM px GROUP BY 1, 2)", last="SELECT frame_id, string_agg(line || chr(10), '' ORDER BY y) AS text FROM l GROUP BY frame_id"),
    "detect_relational": detect_sql(STRESS),
    "detect_streaming": detect_sql(CPU),
    "render_boxes_mask": detect_sql(CPU, """SELECT DISTINCT frame_id, CAST(y + a AS INTEGER) AS y, CAST(x + c AS INTEGER) AS x FROM (SELECT box.*, unnest(range(height)) AS a FROM box) q, (SELECT unnest(range(64)) AS c)
  WHERE c < width AND (a < 2 OR a >= height - 2 OR c < 2 OR c >= width - 2)"""),
    "stage_summary": summary_sql(CPU),
}
