"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.storage import scratch, stored


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (u, v); the component is its smallest node.

    Each round moves links towards smaller nodes: first every larger neighbour of a node is linked to the smallest
    neighbour, then every smaller one. The number of links never grows, no node's neighbours are gathered, and the
    loop ends when a round changes nothing, each component then being a star.
    """
    with scratch(links.sparkSession):
        links = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        before = None
        while (now := _mark(links)) != before:
            before = now
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = stored(large, "large-star")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            met = large.join(least, "u")
            small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            links = stored(small.distinct(), "small-star")
        nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return stored(nodes.unionByName(roots), "components", result=True)
