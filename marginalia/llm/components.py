"""Connected components of a link table, as joins and grouped minima that Spark shuffles.

Alternating large-star and small-star rounds: each round points every node at the least neighbour it sees, until no
link changes. Rounds grow with the logarithm of a component's width. No node's neighbour list is ever collected; only
minima are, so a node with very many links costs one row a task. Links and minima are kept as tables in the shared
folder: so both sides of a join are plain shuffles, and Spark can split the rows of such a node over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): every linked node and the least node it reaches. Links of a node with itself are ignored."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = saved(links.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = saved(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = saved(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
