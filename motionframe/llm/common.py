"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.shared import dropped, fresh_path, written

__all__ = ["by_size", "dropped", "fresh_path", "narrowed", "pool_of", "release_shuffles", "runs", "small_batches", "table", "written"]

def narrowed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that other columns of the caller can't clash with ours; a null text is empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )


def pool_of(*cols: str, pools: int) -> Column:
    """A pool number from 0 to pools-1 that depends on the key alone, so a rerun task gives the same rows."""
    return F.pmod(F.xxhash64(*cols), F.lit(pools)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(batches, keys: int = 1):
    """Tables of equal values in the first ``keys`` columns, from batches that come sorted by them; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in cols)
        at = 0
        for i in np.flatnonzero(new):
            if i > at:
                held.append(b.slice(at, i - at))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held, at = [], i
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_size(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text in a column, whole texts each."""
    lens = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    group = np.cumsum(lens) // most
    at = 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1), len(lens)]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS whole texts, so that neither side of the Python pipe holds many long ones.

    Spark reads this setting when a plan starts, which may be long after the operator returned its DataFrame.  So it is lowered
    for the session, and stays; a caller's lower value is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that nothing refers to when the driver's garbage is collected: ask for that now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
