"""Connected components of a graph of numbers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round links every node's neighbours to the smallest of them, first the larger
    ones, then the smaller ones (the alternating star method), until nothing changes.
    Minima are aggregated before the shuffle and joined back, so a node with very many
    neighbours is never gathered. Null ends and loops are left out."""
    down = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    down, before = stored(down, "edges"), None
    while True:
        state = down.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state.n:
            return down.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                down.select("v", "v").distinct()
            )
        before = state
        both = down.union(down.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        up = up.distinct()
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        stars = up.join(least, "u")
        down = stored(
            stars.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
