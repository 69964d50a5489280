"""Connected components of a link table by alternating stars.

Every round hangs each node's larger neighbours on its smallest one
(large star), then each node with its smaller neighbours (small star), as in
Kiveris et al. 2014. Only minima per node are aggregated, so a node with very
many links is combined before the shuffle and its links stay separate rows;
the links of a round are a written table, so a lost executor repeats one
round at most. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize


def _is_star(links: DataFrame) -> bool:
    """Whether every node either hangs on one node, with none on itself, or on none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    sides = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sides.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns ``a`` and ``b``. One row per node that is not the
    smallest of its component: ``node`` and ``root``, the smallest one. Loops
    and repeated links are fine; no links give no rows."""
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _is_star(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_min")).select(F.col("a").alias("_node"), F.least("a", "_min").alias("_min"))
        # hang every neighbour larger than the node on the node's minimum
        large = both.where("b > a").join(least, F.col("a") == F.col("_node")).select(F.col("b").alias("a"), F.col("_min").alias("b"))
        large = materialize(large)
        # then the node itself and its smaller neighbours on the least of these
        lowest = large.groupBy("a").agg(F.min("b").alias("_min")).withColumnRenamed("a", "_node")
        hung = large.join(lowest, F.col("a") == F.col("_node"))
        small = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("_min").alias("b"))
        links = materialize(small.where("a <> b").distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
