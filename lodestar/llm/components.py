"""Connected components of a table of links, by alternating large-star and small-star rounds.

Links are kept distinct and every round only rewires them, so the table never outgrows the links it began with, and
each round is a written table in the shared folder. Nothing is collected but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.joins import join_keys
from lodestar.llm.common import drop, stage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, root): root is the least node that links reach. Nodes are those of links with a <> b."""
    spark = links.sparkSession
    edges, path = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = (edges.count(), None)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # The centre of a star may have most links: see join_keys.
        large = join_keys(both, least, "a", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Links now point from a node to one no greater. Each came from one of those before.
        large, wide = stage(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_keys(large, least, "a", mark[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges, new = stage(small, "links")
        drop(spark, path, wide)
        path = new
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")
