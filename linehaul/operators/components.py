"""Connected components of an edge table by min-label hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.scratch import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    In each round every node hooks onto its smallest neighbour, hooks are followed to their ends by doubling, and
    edges are rewritten to those ends; those inside a component go. At least half of the nodes that still have edges
    go with them, so rounds are logarithmic and each is smaller. A hub's neighbours meet in a map-side minimum, never
    in one group. Self loops keep a node; null ends are dropped.
    """
    scratch = scratch or Scratch(spark, "components")
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    labels = scratch.table(ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct().select("node", F.col("node").alias("component")), "labels")
    left = scratch.table(ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "left")
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = scratch.table(both.groupBy("u").agg(F.min("v").alias("_low")).select(F.col("u").alias("node"), F.least("u", "_low").alias("root")), "hooks")
        while True:
            further = hooks.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
            new = scratch.table(hooks.join(further, F.col("root") == F.col("_at")).select("node", F.col("_next").alias("root"), (F.col("root") != F.col("_next")).alias("moved")), "hooks")
            scratch.drop(hooks)
            hooks = new
            if not new.where("moved").limit(1).count():
                break
        hooks = hooks.select("node", "root")
        of_u, of_v = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru")), hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        fewer = left.join(of_u, "u").join(of_v, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        fewer = scratch.table(fewer, "left")
        moved = labels.join(hooks.withColumnRenamed("node", "_label"), F.col("component") == F.col("_label"), "left")
        labels, old = scratch.table(moved.select("node", F.coalesce("root", "component").alias("component")), "labels"), labels
        scratch.drop(old, left)
        left = fewer
    return labels
