"""Connected components of a link table: large-star and small-star turns, each a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize

#: Links for each task: tables of links are far smaller than what they were found in, so fewer tasks than the session's serve.
LINKS_PER_TASK = 100_000


def components(links: DataFrame, tag: str, most_turns: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of links (a, b).

    Each turn replaces links by links to smaller nodes; minima are taken before rows are dealt, so a node with very
    many links is no hot spot. It ends when every node links to its component alone, and raises if that
    is not so after most_turns (the number of turns grows with the logarithm of the longest path).
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    edges = materialize(edges, f"{tag}-cc")
    tasks = 4 + edges.count() // LINKS_PER_TASK
    before = None
    for _ in range(most_turns):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # large star: larger neighbours of u link to the least of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.coalesce(tasks), f"{tag}-cc")
        # small star: u and its smaller neighbours link to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(tasks)
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        old, edges = edges, materialize(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct().coalesce(tasks), f"{tag}-cc")
        state = edges.agg(F.count("*").alias("n"), F.count_distinct("hi").alias("h"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40))).alias("x")).first()
        drop_tables(old, large)
        if before == tuple(state) and state.n == state.h:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
