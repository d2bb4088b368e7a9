"""Connected components by alternating large-star and small-star steps.

Every step is aggregations and equi-joins whose aggregations combine before the
shuffle; the edges of a hub, which may be a large part of all, are joined where they
are. The edges are written to the shared folder after each round, so lineage stays
short. The number of rounds grows with the logarithm of the longest path. The
rounds are actions, so they run when ``components`` is called.

Defined results: edges with a null end are ignored, as are self loops; repeated
edges count once. No edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import discard, materialize, spread_join


def _round(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    least = counted.select("a", F.least("a", "m").alias("m"), "n")
    large = materialize(
        spread_join(both.filter("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
        "large",
    )
    lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = spread_join(large, lowest, "a", "n", total)
    small = materialize(
        joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(lowest.select("a", F.col("m").alias("b")))
        .filter("a <> b")
        .distinct(),
        "edges",
    )
    discard(large)
    return small


def _sum(edges: DataFrame) -> tuple:
    found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return found[0], found[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the least node reachable.

    Roots themselves aren't listed.
    """
    now = materialize(edges.select("a", "b").filter("a <> b"), "edges")
    before = None
    while (mark := _sum(now)) != before and mark[0]:
        before, last = mark, now
        now = _round(now, mark[0])
        discard(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
