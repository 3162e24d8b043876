"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every step is an aggregate or an equi-join, so no component, however large, meets in one
task: ``min`` combines map-side, and each aggregate is written before it is joined, so that
the joins are plain shuffled ones whose hot partitions (a hub's links) adaptive execution
can split. Rounds grow with the logarithm of a component's size; a round's tables go with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) integer links, any order, repeats and self-links allowed -> (node, component).

    ``component`` is the smallest node reachable. Nodes without a link to another node are
    left out; null ends are ignored. Raises if ``max_rounds`` do not suffice.
    """
    links = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links)
    mark = _mark(links)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        release(links, least, large, low)
        links = after
        seen, mark = mark, _mark(links)
        if seen == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
