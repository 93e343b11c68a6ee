"""Connected components of a graph in DataFrame rounds: small-star and large-star in turn.

Links are expected as stars around their least member, so that a vertex has few smaller neighbours but perhaps very
many larger ones.  Small-star works on the former, with a window; large-star on the latter, with a minimum that is
summed in the map and a join back, whose hot keys Spark can split.  Rounds grow with the logarithm of the largest
component; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.llm.common import written


def _small_star(links: DataFrame) -> DataFrame:
    """(u, v), v < u: each vertex and its smaller neighbours hang on the least of these."""
    least = links.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return written(least.select(pair.alias("p")).select("p.u", "p.v").where("u <> v").distinct(), "small-star")


def _large_star(links: DataFrame) -> DataFrame:
    """(u, v), v < u: each vertex's larger neighbours hang on the least of it and all its neighbours."""
    both = links.union(links.select("v", "u"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(out.where("u <> v").distinct(), "large-star")


def _is_stars(links: DataFrame) -> bool:
    """Whether each u has one v, which is no u itself: then v is the smallest of the component."""
    seen = links.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("v", F.lit(0), F.lit(1)))
    sums = seen.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).count() == 0


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(v, component): each vertex of links (a, b), with the smallest vertex it can reach."""
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    for i in range(most_rounds):
        now = _small_star(_large_star(now) if i else now)
        if _is_stars(now):
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    leaf = now.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return leaf.unionByName(now.select("v").distinct().withColumn("component", F.col("v")))
