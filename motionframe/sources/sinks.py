"""Sinks: frames as PNG files or one YUV4MPEG2 video, boxes and stages as parquet."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def png(data: bytes, height: int, width: int, channels: int) -> bytes:
    """A PNG file of 8-bit grey or B, G, R pixels."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    a = a[..., 2::-1] if channels >= 3 else a
    lines = np.concatenate([np.zeros((height, 1), np.uint8), a.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels >= 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_pngs(packed: DataFrame, path: str) -> int:
    """Write each packed frame to path/frame-<id>.png, put there by renaming; the number of files."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        fs.create_dir(root, recursive=True)
        for b in it:
            for r in b.to_pylist():
                temp = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as f:
                    f.write(png(r["data"], r["height"], r["width"], r["n_channels"]))
                fs.move(temp, f"{root}/frame-{r['frame_id']:08d}.png")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    done = packed.select("frame_id", "height", "width", "n_channels", "data").mapInArrow(task, "n long")
    return done.groupBy().sum("n").head()[0] or 0


def write_stages(stages: dict[str, DataFrame], path: str) -> None:
    """Each stage's pixels to path/<stage> as parquet."""
    for name, df in stages.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_y4m(packed: DataFrame, path: str, height: int, width: int, rate: int = 50) -> int:
    """Write one-channel frames, in the order of their numbers, as a mono video; the number of frames.

    A video is one file, so one task writes it as a stream; frames are sorted on disk, not held.  It comes to its place by
    renaming, and a second attempt replaces the first.
    """

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        n, temp = 0, f"{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as f:
            f.write(b"YUV4MPEG2 W%d H%d F%d:1 Cmono\n" % (width, height, rate))
            for b in it:
                for h, w, channels, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "n_channels", "data")), strict=True):
                    if (h, w, channels) != (height, width, 1):
                        raise ValueError(f"a frame of {(h, w, channels)} in a mono video of {(height, width)}")
                    f.write(b"FRAME\n" + data)
                    n += 1
        fs.move(temp, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = packed.select("frame_id", "height", "width", "n_channels", "data").repartition(1).sortWithinPartitions("frame_id")
    return rows.mapInArrow(task, "n long").groupBy().sum("n").head()[0] or 0
