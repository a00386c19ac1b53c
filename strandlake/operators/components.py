"""Connected components of a graph by alternating star contractions on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Nodes with more neighbours than this, and than an even part of all, get their smallest neighbour by broadcast.
HUB = 1024


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, component) of every node that has an edge (a, b), as a stored table; the component is its smallest node.

    Each node passes its neighbours on to the smallest node it knows, first the larger ones, then the smaller ones, until every node is either
    smaller than all its neighbours or has one neighbour only: its component. Only counts reach the driver.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        facts = least.agg(F.sum("n").alias("n"), F.count_if(F.expr("m < u and n > 1")).alias("open")).first()
        if not facts["open"]:
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        # There are fewer hubs than shuffle partitions, as each has more than an even part of the rows.
        bound = max(hub, facts["n"] // int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        hubs = F.broadcast(least.where(F.col("n") > bound).select("u", F.col("m").alias("hub_m")))
        upward = both.where("v > u").join(hubs, "u", "left")
        of_hubs = upward.where("hub_m is not null").select(F.col("v").alias("u"), F.col("hub_m").alias("v"))
        of_others = upward.where("hub_m is null").select("u", "v").join(least.where(F.col("n") <= bound), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = of_hubs.union(of_others).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = written(linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
