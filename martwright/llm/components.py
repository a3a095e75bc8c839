"""Connected components of links by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import stored


def _stars(links: DataFrame) -> DataFrame:
    """Large stars: every larger neighbour of a node is linked to the least node around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    joined = both.join(least, "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    """Small stars: a node and its smaller neighbours are linked to the least of them. b < a."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    joined = links.join(least, "a")
    moved = joined.where(F.col("b") != F.col("least")).select(
        F.col("b").alias("a"), F.col("least").alias("b")
    )
    own = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(own).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the least node that links reach, for every node that has a link to another.

    Rounds of large and small stars until all links are stars; their number grows with the logarithm
    of the longest path. Least neighbours are aggregated before each shuffle and joined back, so the
    centre of a large star is split by adaptive execution and never gathered. Null ends and links
    to oneself say nothing.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    now = ends.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    now = stored(now.distinct())
    digest = _digest(now)
    while digest[0]:
        now = stored(_small_stars(_stars(now)))
        new = _digest(now)
        if new == digest:
            break
        digest = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _digest(links: DataFrame) -> tuple:
    # links are distinct, so equal sums of their hashes mean equal links
    h = F.xxhash64("a", "b").cast("decimal(20,0)")
    row = links.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
    return tuple(row)
