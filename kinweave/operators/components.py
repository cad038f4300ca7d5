"""Connected components over an edge DataFrame.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Each round is two shuffles of the
edges; no vertex list, label map or edge list reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.lineage import cut


#: Edges of a vertex from which it is a hub, and the most hubs that are broadcast (two ids each).
HUB = 100_000
MOST_HUBS = 10_000


def _both(edges: DataFrame) -> DataFrame:
    """The edges in either direction."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _met(pairs: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): the pairs with the least vertex among u and its v; ``rows`` is how many there are at most.

    One shuffle by u brings all of a vertex together, where repeated pairs go.
    A vertex of very many edges would be one window: those with more than one in
    MOST_HUBS of all rows, so fewer than MOST_HUBS, are added up and broadcast.
    """
    bound = max(HUB, rows // MOST_HUBS)
    least = F.least(F.min("v").over(Window.partitionBy("u")), "u")
    if rows <= bound:
        return pairs.withColumn("m", least).distinct()
    hubs = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound)
    rest = pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").withColumn("m", least).distinct()
    return pairs.join(F.broadcast(hubs.select("u", "m")), "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    return _met(_both(edges), 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` lead down, from u to a lesser v, as the large-star leaves them."""
    # The edge to the least vertex stays, each other one becomes an edge from there.
    return _met(edges, n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each vertex has one lesser vertex and nothing else, or greater ones only."""
    ends = _both(edges).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ends.filter("low < u and low != high").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component): the least vertex reachable, for every vertex with an edge.

    ``edges`` has two columns of one orderable type; nulls and loops are left
    out.  Raises if ``max_rounds`` rounds do not suffice, rather than return a
    wrong answer.
    """
    a, b = edges.columns[:2]
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct())
    n = now.count()
    if not n:
        return now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # Neither star leaves more edges than it had.
        now = cut(_small_star(_large_star(now, n), n))
        if _settled(now):  # a set of stars is a fixed point
            ends = F.array(F.struct(F.col("u").alias("vertex"), F.col("v").alias("component")), F.struct(F.col("v").alias("vertex"), F.col("v").alias("component")))
            return now.select(F.explode(ends).alias("e")).groupBy("e.vertex").agg(F.min("e.component").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
