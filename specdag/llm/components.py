"""Connected components of distributed links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdag.llm.common import discard, materialize


#: Fixed value: the most links of which the nodes are broadcast, so that a centre's links need not meet in one task.
MOST_BROADCAST = 400_000


def _star(links: DataFrame, large: bool, few: bool) -> DataFrame:
    """Tie each node's larger (``large``) or smaller neighbours to the least node among them and itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(F.broadcast(least) if few else least, "u")
    if large:
        found = tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        found = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.filter("a <> b").distinct()


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) for every node of ``links`` (a, b) that is not the least itself.

    Rounds alternate until nothing changes; their number grows with the logarithm of the longest path. Links may
    repeat and point either way; each round is written to the shared folder."""
    links = materialize(links.filter("a <> b").select("a", "b").distinct(), "links")
    before = _sign(links)
    while before[0]:
        few = before[0] <= MOST_BROADCAST
        last, links = links, materialize(_star(_star(links, large=True, few=few), large=False, few=few), "links")
        discard(last)
        now = _sign(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
