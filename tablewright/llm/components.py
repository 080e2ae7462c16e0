"""Connected components of a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.session import discard, written_once


def connected_components(edges: DataFrame) -> DataFrame:
    """k, label (the smallest k reachable) for every vertex of ``edges`` (a, b); vertices are longs.

    Large-star and small-star rounds shorten paths until every vertex hangs on
    its smallest one; each round is written, so a lost executor repeats one
    round at most.  Only two numbers per round go to the driver.
    """
    links = written_once(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        stars = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        used, links = links, written_once(stars.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        discard(used)
        if seen.get == before:
            break
        before = seen.get
    return links.select(F.col("u").alias("k"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("k"), F.col("v").alias("label")).distinct())
