"""A data source for uncompressed video: YUV4MPEG2 files (mono, 4:2:0, 4:2:2, 4:4:4) as packed B, G, R frames.

``spark.dataSource.register(Y4M)``, then ``spark.read.format("y4m").load(path)``.  A file splits at frames, which all
have one length, so that a long video is read by many tasks.

``Compressed``, format "video", reads other files where the workers have a decoder (the module cv2, or imageio with a
plug-in), one task a file; without one, that is a clear error: extract the frames as images and use ``frames.read_images``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from motionframe.sources.frames import PACKED

FRAME = b"FRAME"
CHROMA = {"mono": (0, 0), "420": (2, 2), "422": (2, 1), "444": (1, 1)}


def opened(path: str):
    fs, name = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return fs.open_input_file(name)


class Header:
    """width, height, frames per second, chroma divisors, place of the first frame and bytes a frame."""

    def __init__(self, file):
        line = file.read_at(4096, 0).split(b"\n", 1)[0]
        if not line.startswith(b"YUV4MPEG2"):
            raise ValueError("not a YUV4MPEG2 file")
        tags = {t[:1]: t[1:].decode() for t in line.split(b" ")[1:]}
        self.width, self.height = int(tags[b"W"]), int(tags[b"H"])
        num, den = (int(x) for x in tags.get(b"F", "25:1").split(":"))
        self.fps = num / den
        kind = tags.get(b"C", "420")
        name = "mono" if kind.startswith("mono") else kind[:3]
        if name not in CHROMA or "p1" in kind:
            raise ValueError(f"chroma {kind} can't be read")
        self.chroma = CHROMA[name]
        self.start = len(line) + 1
        mark = file.read_at(256, self.start).split(b"\n", 1)[0] if file.size() > self.start else FRAME
        self.mark = len(mark) + 1
        cx, cy = self.chroma
        self.planes = [self.width * self.height] + ([-(-self.width // cx) * -(-self.height // cy)] * 2 if cx else [])
        self.size = self.mark + sum(self.planes)
        self.frames = (file.size() - self.start) // self.size

    def bgr(self, data: bytes) -> bytes:
        """Full-range BT.601, rounded; a mono frame keeps its one channel."""
        flat = np.frombuffer(data, np.uint8)
        y = flat[: self.planes[0]].reshape(self.height, self.width)
        if not self.chroma[0]:
            return y.tobytes()
        cx, cy = self.chroma
        shape = (-(-self.height // cy), -(-self.width // cx))
        u, v = (
            flat[a : a + self.planes[1]].reshape(shape).repeat(cy, 0).repeat(cx, 1)[: self.height, : self.width].astype(np.float64) - 128
            for a in (self.planes[0], self.planes[0] + self.planes[1])
        )
        bgr = np.stack([y + 1.772 * u, y - 0.344136 * u - 0.714136 * v, y + 1.402 * v], axis=-1)
        return np.clip(np.rint(bgr), 0, 255).astype(np.uint8).tobytes()


class Frames(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class Y4MReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("framesPerTask", "64"))

    def partitions(self):
        with opened(self.path) as f:
            n = Header(f).frames
        return [Frames(i, min(n, i + self.step)) for i in range(0, n, self.step)] or [Frames(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as f:
            head = Header(f)
            channels = 3 if head.chroma[0] else 1
            for i in range(partition.start, partition.end):
                data = f.read_at(head.size, head.start + i * head.size)
                if not data.startswith(FRAME):
                    raise ValueError(f"frame {i} does not begin where it should")
                cols = [pa.array([i], pa.int64()), *(pa.array([v], pa.int32()) for v in (head.height, head.width, channels)), pa.array([head.bgr(data[head.mark :])], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["frame_id", "height", "width", "n_channels", "data"])


class Y4M(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return PACKED

    def reader(self, schema) -> DataSourceReader:
        return Y4MReader(self.options)


def decoded(path: str) -> Iterator[np.ndarray]:
    """Frames (height, width, B G R) of a video file, by whichever decoder is installed."""
    try:
        import cv2
    except ImportError:
        cv2 = None
    if cv2 is not None:
        capture = cv2.VideoCapture(path)
        if not capture.isOpened():
            raise ValueError(f"{path} can't be opened as a video")
        while True:
            good, frame = capture.read()
            if not good:
                return
            yield frame
    else:
        try:
            import imageio.v3 as iio
        except ImportError:
            raise RuntimeError("no video decoder (cv2 or imageio) is installed: extract images, or convert to YUV4MPEG2") from None
        for frame in iio.imiter(path):
            yield np.ascontiguousarray(frame[..., ::-1])


class CompressedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [Frames(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for i, frame in enumerate(decoded(self.path)):
            h, w, n = frame.shape
            cols = [pa.array([i], pa.int64()), *(pa.array([v], pa.int32()) for v in (h, w, n)), pa.array([frame.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["frame_id", "height", "width", "n_channels", "data"])


class Compressed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "video"

    def schema(self) -> str:
        return PACKED

    def reader(self, schema) -> DataSourceReader:
        return CompressedReader(self.options)
