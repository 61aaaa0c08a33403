"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins over edges; nothing is gathered per component. A node with many edges is
pre-aggregated for its minimum, and its join side can be split by adaptive execution. Rounds are written to the
shared folder, so a lost executor costs a re-read. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura.operators.ordered import stage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link every neighbour of a node (larger ones, or smaller ones and itself) to the smallest node around it."""
    if larger:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                  .unionByName(least.select("a", F.col("m").alias("b"))))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns ``a``, ``b`` (long) to ``node``, ``root``: the smallest node that can be reached, for nodes with an edge.

    Repeated edges and loops do no harm; an empty table gives an empty one.
    """
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        after = stage(_star(_star(current, True), False))
        # every change replaces an edge, and no round makes more edges than before
        changed = after.join(current, ["a", "b"], "left_anti").limit(1).count()
        if not changed and after.count() == current.count():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        current = after
