"""Detection on a stream of packed frames.

With a given background the stream is stateless: one pass per micro-batch.  Where the background has to be the first
frame that a capture sends, ``with_first_frame`` keeps exactly that frame as each capture's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motionframe.operators import packed
from motionframe.params import DetectParams
from motionframe.sources.frames import PACKED

CAPTURED = f"capture string, {PACKED}"


def read_frames(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Packed frames from parquet files as they come to a folder."""
    return spark.readStream.schema(PACKED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def detect_stream(frames: DataFrame, background: np.ndarray, p: DetectParams) -> DataFrame:
    """Boxes of a stream of packed frames against one background."""
    return packed.detect(frames, background, p)


def with_first_frame(frames: DataFrame, p: DetectParams) -> DataFrame:
    """(capture, then the columns of a box): each capture's frames against the first of them to come.

    frames: CAPTURED.  State is one frame a capture; of the frames of one micro-batch the least frame_id counts as first, so a
    capture's first micro-batch is held in whole, later ones pass in parts.  Frames that repeat a number are answered one
    by one; frames without a capture are one of their own; a frame of another size is an error.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not state.exists:
            rows = pd.concat(parts).sort_values("frame_id", kind="stable")
            r = rows.iloc[0]
            state.update((int(r.height), int(r.width), int(r.n_channels), bytes(r.data)))
            parts = iter([rows.iloc[1:]])
        h, w, n, data = state.get
        shape = (h, w, n) if n > 1 else (h, w)
        ready = packed.prepared(np.frombuffer(bytes(data), np.uint8).reshape(shape)[None], p)[0].astype(np.int16)
        for rows in parts:
            for r in rows.itertuples():
                if (r.height, r.width, r.n_channels) != (h, w, n):
                    raise ValueError(f"frame of {(r.height, r.width)} against a background of {(h, w)}")
                on = packed.moving(np.frombuffer(bytes(r.data), np.uint8).reshape(shape)[None], ready, p)
                found = packed.boxes_of(on, np.array([r.frame_id]), p.external, p.label_base).to_pandas()
                found.insert(0, "capture", key[0])
                yield found

    return frames.groupBy("capture").applyInPandasWithState(
        step, f"capture string, {packed.BOXES}", "height int, width int, n_channels int, data binary", "append", GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append it to parquet files and stop; a later call goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
