"""The control store's reads as tables: newest rows, lineage, leases, unions, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linehaul.scratch import Scratch


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; appended versions replace updates in place."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def lineage(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(root, node, depth)``: all that each start reaches over (child, parent) edges, at its least depth.

    A pass per generation; nodes seen before are not followed again, so cycles end.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "lineage")
    front = scratch.table(start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct(), "front")
    seen = front
    while True:
        step = front.join(edges, front["node"] == edges["child"]).select("root", F.col("parent").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        front = scratch.table(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"), "front")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)


def stale(leases: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """Running leases whose heartbeat is older than ``seconds``."""
    return leases.where((F.col("status") == "running") & (F.col("heartbeat") < now - F.expr(f"INTERVAL {seconds} SECONDS")))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def flatten_metrics(df: DataFrame, keys: list[str], metrics: str) -> DataFrame:
    """A row per metric of a map column, finite values only."""
    rows = df.select(*keys, F.explode(metrics).alias("metric", "value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def split_integrity(examples: DataFrame) -> DataFrame:
    """Systems that are in more than one split."""
    return examples.groupBy("system").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def fold_events(events: DataFrame) -> DataFrame:
    """Per run what its log in order amounts to: last sequence, status, step, heartbeat and number of checkpoints."""
    by = F.struct("ts", "event_id")
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, by))
    return events.groupBy("run").agg(
        F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_event"), F.max_by("type", by).alias("status"),
        last(F.col("value"), F.col("type") == "view").alias("progress"), F.max("ts").alias("heartbeat"), F.count(F.when(F.col("type") == "purchase", 1)).alias("checkpoints"),
    )


def first_match(runs: DataFrame, reports: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """Each run with the first report of its keys, or none."""
    return runs.join(latest(reports, on, order), on, "left")


def zipped(names: Column, values: Column) -> Column:
    """Names and values, as many as both have, as a map; null names and repeats of a name are left out."""
    pairs = F.zip_with(F.slice(names, 1, F.least(F.size(names), F.size(values))), F.slice(values, 1, F.least(F.size(names), F.size(values))), lambda n, v: F.struct(n.alias("key"), v.alias("value")))
    seen = F.transform(F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: (F.array_position(F.transform(pairs, lambda p: p["key"]), F.get(pairs, i)["key"]) == i + 1)), lambda i: F.get(pairs, i))
    return F.map_from_entries(seen)


def training_examples(lines: DataFrame, labels: DataFrame, targets: list[str]) -> DataFrame:
    """Lines with their labels of the same snapshot, finite targets alone; ``weight`` shares a snapshot's one among its rows."""
    finite = F.lit(True)
    for t in targets:
        finite = finite & F.col(t).isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    rows = lines.join(labels.where(finite), ["snapshot", "line"])
    return rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("snapshot")))
