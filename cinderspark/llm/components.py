"""Connected components of links, as Spark jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderspark.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(``node``, ``component``): the smallest node reachable over links (``a``, ``b``), for nodes that have links.

    Alternates two rewritings until nothing changes: every node hands its larger neighbours to the smallest
    one, then its smaller neighbours. Least neighbours are written before the joins, so that the rows of a
    node with very many links can be dealt to several tasks.
    """
    both = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.keep(both.distinct(), f"{name}-0")
    state, step = _state(edges), 0
    while True:
        step += 1
        either = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(either.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-{step}-l")
        large = either.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.where(F.col("a") != F.col("b")).distinct(), f"{name}-{step}-large")
        least = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{step}-s")
        moved = large.join(least, "a")
        small = moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{step}")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
