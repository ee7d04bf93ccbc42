"""Connected components of a table of links, by alternating large and small stars (Kiveris et al. 2014).

Both steps replace links by links to the least neighbour: group minima with partial sums in each task and one join, so no
node's neighbours are ever collected. Each round is written to the shared folder. Rounds grow with the logarithm of the
longest chain, not with the number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import removed, shared_dir, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` lead from larger to smaller nodes."""
    least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = links.join(least, links["a"] == least["u"]).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def _print_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component), the least node that can be reached; nodes without links are not listed."""
    spark = links.sparkSession
    path = shared_dir(spark)
    now = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    before = None
    while (print_ := _print_of(now)) != before and print_[0]:
        before, old, path = print_, path, shared_dir(spark)
        now = written(_small_star(_large_star(now)), path)
        removed(spark, old)
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
