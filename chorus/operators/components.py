"""Connected components of an edge list, as joins and minima over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.session import ensure_checkpoint_dir


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component = smallest node reachable) of the nodes with an edge to another node.

    Alternating large-star / small-star rounds (Kiveris et al. 2014): every round is two map-side
    combined minima and two equi-joins over the edge list, which never grows; the rounds number
    O(log^2) of the longest chain.  Each round's edges are checkpointed, nothing is collected.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = (edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint(eager=True))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint(eager=True)
        same = nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty()
        e = nxt
        if same:
            break
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
