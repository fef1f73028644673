"""Connected components of links between documents, as joins and aggregations only.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
each step links the neighbours of a node to the smallest of them. Every step works on
edges grouped by node with partial aggregation, so a node that has a third of all
edges costs one row per task; the number of steps grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop_scratch


def _state(edges: DataFrame) -> tuple:
    # unchanged count and sum of hashes: the edges are stars
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns, a link each way round in any order, loops and repeats allowed. Returns (node, component):
    each node that has a link to another, and the smallest node it reaches. Nulls are ignored."""
    x, y = (F.col(c).cast("long") for c in edges.columns[:2])
    # a is the larger node
    now = cut(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    was = _state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b")
        # nodes whose own smallest neighbour is smaller keep their link to it
        large = large.union(least.where("low < n").select(F.col("n").alias("a"), F.col("low").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
            .select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a != b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        then = cut(small, "edges")
        is_ = _state(then)
        drop_scratch(now)
        now = then
        if is_ == was:
            break
        was = is_
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b")).distinct()
