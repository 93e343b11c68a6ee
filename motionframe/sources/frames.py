"""Frames as DataFrames.

packed: (frame_id long, height int, width int, n_channels int, data binary), row-major, colour bytes in B, G, R order.
pixels: (frame_id long, y int, x int, v int); pixels_bgr: (frame_id, y, x, b, g, r).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.shared import written

PACKED = "frame_id long, height int, width int, n_channels int, data binary"


def numbered(names: DataFrame, name: str) -> DataFrame:
    """(name, frame_id): distinct names in their order, from 0, without bringing them together in a task.

    Names are sorted by ranges; each task numbers its own and begins where the tasks before it end: one count a task goes
    through the driver.
    """
    own = written(names.select(name).distinct().orderBy(name).select(name, F.monotonically_increasing_id().alias("place")), "names")
    counts = own.groupBy(F.shiftright("place", 33).alias("task")).count().orderBy("task").collect()
    begin, at = [], 0
    for r in counts:
        begin.append((r["task"], at))
        at += r["count"]
    begins = own.sparkSession.createDataFrame(begin, "task long, begin long")
    out = own.join(F.broadcast(begins), F.shiftright("place", 33) == F.col("task"))
    return out.select(name, (F.col("begin") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("frame_id"))


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Packed frames of the image files below path (PNG, JPEG, GIF, BMP), numbered from 0 in the order of their names.

    Numbers come from a listing of the files, without their contents; each image is read and decoded once.  A file that is
    no image counts as well, and has no frame if drop_invalid, else one of size -1.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    images = spark.read.format("image").option("dropInvalid", drop_invalid).load(path).select("image.*")
    listed = spark.read.format("binaryFile").load(path).select(plain(F.col("path")).alias("name"))
    packed = images.select(plain(F.col("origin")).alias("name"), "height", "width", F.col("nChannels").alias("n_channels"), "data")
    return packed.join(numbered(listed, "name"), "name").select("frame_id", "height", "width", "n_channels", "data")


def replay(frames: DataFrame, times: int) -> DataFrame:
    """frames with a column pass, from 0: the capture from its beginning again and again."""
    return frames.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def from_arrays(spark: SparkSession, frames: list[np.ndarray]) -> DataFrame:
    """Packed frames of in-memory arrays (height, width) or (height, width, channels); values are kept modulo 256."""
    rows = []
    for i, a in enumerate(frames):
        a = np.asarray(a)
        channels = a.shape[2] if a.ndim == 3 else 1
        rows.append((i, a.shape[0], a.shape[1], channels, bytearray((a.astype(np.int64) % 256).astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, PACKED)


def blank(spark: SparkSession, height: int, width: int) -> DataFrame:
    """One packed frame of zeros."""
    return from_arrays(spark, [np.zeros((height, width), np.uint8)])


def unpack(packed: DataFrame) -> DataFrame:
    """pixels of packed one-channel frames, by SQL functions alone."""
    at = packed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)))
    value = F.expr("ascii(decode(substring(data, i + 1, 1), 'ISO-8859-1'))")
    y = F.floor(F.col("i") / F.col("width")).cast("int")
    return at.select("frame_id", y.alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), value.cast("int").alias("v"))


def unpack_bgr(packed: DataFrame) -> DataFrame:
    """pixels_bgr of packed three-channel frames."""
    at = packed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)))
    channel = lambda k: F.expr(f"ascii(decode(substring(data, 3 * i + {k + 1}, 1), 'ISO-8859-1'))").cast("int")
    y = F.floor(F.col("i") / F.col("width")).cast("int")
    x = (F.col("i") % F.col("width")).cast("int")
    return at.select("frame_id", y.alias("y"), x.alias("x"), channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r"))


def pack(pixels: DataFrame, height: int, width: int, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Packed frames of pixels; missing and null ones are 0, rows without place or frame are dropped.

    A frame's pixels meet in one row: frames are of bounded size.
    """
    value = F.struct((F.col("y") * width + F.col("x")).alias("i"), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in columns))
    rows = pixels.where("frame_id IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").groupBy("frame_id").agg(F.collect_list(value).alias("p"))
    n = len(columns)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data = []
            for p in b.column("p"):
                flat = p.values
                out = np.zeros((height * width, n), np.uint8)
                for k, c in enumerate(columns):
                    out[flat.field("i").to_numpy(), k] = flat.field(c).to_numpy()
                data.append(out.tobytes())
            m = b.num_rows
            cols = [b.column("frame_id"), *(pa.array([v] * m, pa.int32()) for v in (height, width, n)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["frame_id", "height", "width", "n_channels", "data"])

    return rows.mapInArrow(task, PACKED)


def metadata(frames: DataFrame, fps: float) -> DataFrame:
    """frame_count, height, width, fps, duration_ms of a capture of packed frames or pixels."""
    if "data" in frames.columns:
        size = (F.max("height"), F.max("width"))
    else:
        size = ((F.max("y") + 1).cast("int"), (F.max("x") + 1).cast("int"))
    out = frames.agg(F.countDistinct("frame_id").alias("frame_count"), size[0].alias("height"), size[1].alias("width"))
    rate = F.lit(float(fps))
    return out.select("frame_count", "height", "width", rate.alias("fps"), (F.lit(1000.0) * F.col("frame_count") / rate).alias("duration_ms"))


def frame_size(packed: DataFrame) -> tuple[int, int]:
    """The one size of all frames; frames of unlike size, or none, are an error."""
    sizes = packed.select("height", "width").distinct().limit(3).collect()
    if len(sizes) != 1:
        raise ValueError("no frames" if not sizes else f"frames of unlike size: {sorted(map(tuple, sizes))}")
    return sizes[0].height, sizes[0].width


def background_id(frames: DataFrame) -> int:
    """The first frame's number; no frame at all is an error."""
    first = frames.agg(F.min("frame_id")).head()[0]
    if first is None:
        raise ValueError("no first frame to take as background")
    return first


def embedding_value(c: Column) -> Column:
    """A component of an embedding as a grey value."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (c.cast("double") + 0.6) * 212.5))).cast("int")


def tiles(embeddings: DataFrame, side: int = 8) -> DataFrame:
    """pixels of one side x side frame for each embedding."""
    at = embeddings.select(F.col("vec_id").cast("long").alias("frame_id"), F.posexplode("embedding").alias("i", "e"))
    y = F.floor(F.col("i") / side).cast("int")
    return at.select("frame_id", y.alias("y"), (F.col("i") % side).cast("int").alias("x"), embedding_value(F.col("e")).alias("v"))


def mosaics(embeddings: DataFrame, side: int = 8) -> DataFrame:
    """pixels of frames of side x side embeddings each, as tiles; tiles that no embedding has are 0, in every frame."""
    n = side * side
    tile = F.pmod("frame_id", F.lit(n)).cast("int")
    at = tiles(embeddings, side)
    known = at.select(
        F.floor(F.col("frame_id") / n).cast("long").alias("frame_id"),
        (F.floor(tile / side).cast("int") * side + F.col("y")).alias("y"),
        ((tile % side) * side + F.col("x")).alias("x"),
        "v",
    )
    # gaps: a frame's tiles that aren't there, from the ids alone
    ids = embeddings.where("vec_id IS NOT NULL AND size(embedding) > 0").select(F.floor(F.col("vec_id") / n).cast("long").alias("frame_id"), F.pmod("vec_id", F.lit(n)).cast("int").alias("tile"))
    have = ids.groupBy("frame_id").agg(F.collect_set("tile").alias("have")).where(F.size("have") < n)
    lack = have.select("frame_id", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), "have")).alias("tile"))
    lack = lack.select("frame_id", "tile", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    gaps = lack.select(
        "frame_id",
        (F.floor(F.col("tile") / side) * side + F.floor(F.col("i") / side)).cast("int").alias("y"),
        ((F.col("tile") % side) * side + F.col("i") % side).cast("int").alias("x"),
        F.lit(0).alias("v"),
    )
    return known.unionByName(gaps)


def first_number(table: DataFrame, id_col: str = "vec_id", per_frame: int = 1) -> int:
    """The first frame's number of tiles, or mosaics of per_frame tiles, from the table of embeddings: one column is read."""
    first = table.where("size(embedding) > 0").agg(F.min(id_col)).head()[0]
    if first is None:
        raise ValueError("no first frame to take as background")
    return first // per_frame


def order_frames(lineitem: DataFrame, side: int = 32) -> DataFrame:
    """pixels_bgr of a frame for each supplier, of order lines: the greatest value of each channel where lines meet."""
    whole = lambda c: F.floor(F.col(c)).cast("long")
    byte = lambda c: (whole(c) % 256).cast("int")
    keys = (F.col("l_suppkey").cast("long").alias("frame_id"), (F.col("l_partkey") % side).cast("int").alias("y"), (F.col("l_orderkey") % side).cast("int").alias("x"))
    return lineitem.groupBy(*keys).agg(
        F.max(byte("l_partkey")).alias("b"), F.max(byte("l_orderkey")).alias("g"), F.max(byte("l_extendedprice")).alias("r")
    )
