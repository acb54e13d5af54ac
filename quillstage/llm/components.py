"""Connected components of links, as DataFrames: alternating large and small stars until nothing changes.

In a large star every node hands the smallest of its neighbourhood to its larger neighbours, in a small star to itself and
its smaller ones. The smallest of a neighbourhood is an aggregate that is combined before the shuffle and joined back, so a
node with very many neighbours is no task's burden: few of them are broadcast, beyond that the join may be split. The links of
each round are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstage.llm.common import discard, written


#: Nodes whose smallest neighbours are broadcast: 16 bytes each.
MOST_BROADCAST = 2_000_000


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.max("u"), F.min("v")).first())


def _star(links: DataFrame, large: bool, few: bool) -> DataFrame:
    """Links (u, v) with u > v to links of the same kind, after one star."""
    ends = links if not large else links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = ends.join(F.broadcast(least) if few else least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node of links (a, b) between integers but the smallest of each component: the smallest that can be reached."""
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = _signature(now)
    for _ in range(rounds):
        few = 2 * before[0] <= MOST_BROADCAST  # a link has two ends
        last, now = now, written(_star(_star(now, True, few), False, few), "links")
        discard(last)
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found.written_to = now.written_to  # so that a caller can discard it
    return found
