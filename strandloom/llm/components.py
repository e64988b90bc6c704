"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, root long) for every node on an edge (a long, b long); root is the component's smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour,
    so that paths halve and the edge count never grows. State is one edge table per round on shared
    storage. A node's neighbours are only aggregated (with map-side minima) or joined, never gathered,
    and either side of a join is a written table behind its own exchange, so that a star's hot centre
    can be split. Null ends and loops link nothing.
    """
    a, b = F.col("a"), F.col("b")
    state = materialize(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "cc"
    )
    before = None
    while True:  # every round that changes the edges brings them nearer to stars, so that one without a change comes
        ends = state.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.*")
        least = materialize(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        large = materialize(ends.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "cc-large")
        low = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "cc-low")
        both = large.join(low, "hi")
        small = materialize(both.filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo"))).distinct(), "cc-small")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        release(state, least, large, low)
        state = small
        if before == now:
            break
        before = now
    roots = state.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
