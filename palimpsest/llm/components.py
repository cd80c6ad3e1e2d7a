"""Connected components of a graph of long ids, by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import cut, release


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u over v, are stars: no node has two edges down, and none with an edge down is a root.
    Neither step changes such edges."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.agg(F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0] is not True


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is the least node that it can reach.

    Nodes that are their own root are included. Every step is a grouped minimum and a join on it, so no neighbourhood
    is ever gathered; rows shrink to one for each node that is not a root. Self-links and nulls are ignored. After each
    round Spark is asked to drop what earlier ones left on disk; links that are stars already take no round.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        settled = _settled(edges)
        release(edges.sparkSession)  # its cleaner works beside the next jobs
        if settled:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        del both, low, large, least, tied
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.distinct())
