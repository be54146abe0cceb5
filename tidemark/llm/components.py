"""Connected components of a table of links, by alternating large-star and small-star rounds.

No node's neighbours are ever gathered: each round takes minima with partial aggregates and joins them back, so that a
node with any share of the links is as good as any other. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, links: DataFrame, name: str, most: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for all nodes of ``links`` (a, b: longs) but the smallest ones."""
    down = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    links = scratch.keep(down(links), f"{name}-0")
    for k in range(1, most + 1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(down(large), f"{name}-{k}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        links = scratch.keep(down(small), f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large", f"{name}-{k - 1}")
        # done when all hang on roots: no node has two parents, and no parent has a parent
        several = links.groupBy("a").count().filter("count > 1").limit(1)
        deep = links.join(links.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if several.isEmpty() and deep.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components: not settled after {most} rounds")
