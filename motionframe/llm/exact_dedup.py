"""Exact deduplication with a heavy-hitter split, all in DataFrame functions.

1. One scan normalises white space and hashes each text (sha256); digests go to a narrow table.
2. A frequent-items sketch of the Misra-Gries family (``approx_top_k``; ``tracked`` counters a task, so its
   memory is fixed) names digests that may be frequent.  Sketches meet in two levels, never all in one task.
3. The named digests - at most ``heavy_slots`` - are counted exactly (map-side sums) with their smallest doc_id;
   these winners are broadcast (heavy_slots rows of about 100 bytes) and answer the frequent rows in the map.
4. All other digests, each rarer than the sketch's error bound, are shuffled by digest once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.llm.common import narrowed, table, written

WHITE = r"[\x20\x09-\x0D]+"
HEAVY_SLOTS = 2048
TRACKED = 8192
SKETCH_GROUPS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def frequent_digests(rows: DataFrame, heavy_slots: int = HEAVY_SLOTS, tracked: int = TRACKED) -> DataFrame:
    """(digest): at most heavy_slots digests that a Misra-Gries sketch holds as frequent."""
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch")
    )
    # grouped by a value that all rows share: an ungrouped combine fails on partitions without rows
    whole = parts.groupBy((F.col("g") < 0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    return whole.select(F.expr(f"inline(approx_top_k_estimate(sketch, {heavy_slots}))")).select(
        F.col("item").alias("digest")
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    heavy_slots: int = HEAVY_SLOTS, tracked: int = TRACKED,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal when identical after each run of space, tab, LF, VT, FF or CR becomes one space.  A null text
    is empty, so null and empty texts form one group.  The smallest doc_id of a group stays; rows that repeat a
    doc_id are one document and get the same answer.  A null doc_id stays only if no row of its group has an id.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = written(
        narrowed(docs, id_col, text_col).select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("digest")),
        "digests",
    )
    named = F.broadcast(frequent_digests(rows, heavy_slots, tracked))
    winners = written(
        rows.join(named, "digest").groupBy("digest").agg(
            F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.lit(True).alias("heavy")
        ),
        "winners",
    )
    split = rows.join(F.broadcast(winners), "digest", "left")
    same = Window.partitionBy("digest")
    light = split.where(F.col("heavy").isNull()).select(
        "doc_id", "digest", F.min("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size")
    )
    both = split.where(F.col("heavy")).select("doc_id", "digest", "keep_id", "group_size").unionByName(light)
    return both.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
