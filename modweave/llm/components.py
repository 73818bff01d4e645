"""Connected components of a graph given as links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.llm import runtime
from modweave.llm.runtime import cut


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(links: DataFrame, frequent: bool) -> DataFrame:
    """Links with m, the smallest v of their u. Where a node is ``frequent``, those that are get theirs by a broadcast."""
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if not frequent:
        return links.join(low.drop("n"), "u")
    often = F.broadcast(low.where(F.col("n") > runtime.FREQUENT).drop("n"))
    rest = links.join(often.select("u"), "u", "left_anti").join(low.where(F.col("n") <= runtime.FREQUENT).drop("n"), "u")
    return links.join(often, "u").unionByName(rest)


def _large_star(links: DataFrame, frequent: bool) -> DataFrame:
    """Each larger neighbour of a node goes to the node's smallest neighbour or the node itself."""
    return _with_least(_both(links), frequent).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(links: DataFrame, frequent: bool) -> DataFrame:
    """Each smaller neighbour of a node, and the node, go to the smallest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("v"))
    return _with_least(links, frequent).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: root is the smallest node that the links reach.

    Alternating large and small stars: each round halves the depth of the trees at least, hubs are aggregated
    before they are shuffled and their links stay where they are, and every round is cut in the shared checkpoint folder.
    Nulls and self-links are ignored; an empty input gives an empty result.
    """
    now = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    while True:
        per = _both(now).groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        state = per.agg(F.sum("n"), F.sum("s"), F.max("n")).first()
        if state[0] is None or state == before:
            break
        before, frequent = state, state[2] > runtime.FREQUENT
        now = cut(_small_star(_large_star(now, frequent), frequent).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
