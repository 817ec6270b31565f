"""Counterfactual labels: what the network loses when a line is removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linehaul.operators.network import nearest_rank

THRESHOLDS = (900, 1800, 2700, 3600, 5400)


def impact(baseline: DataFrame, damaged: DataFrame, pairs: DataFrame, stations: int, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Per removed line: accessibility loss, share of destinations lost, mean and 95 % delay, mean extra transfers.

    ``baseline`` and ``damaged``: query_id, station, arrival, transfers. ``pairs``: query_id, base, removed, departure.
    The origin counts as a destination of its own.
    """
    within = [F.count(F.when(F.col("arrival") - F.col("departure") <= t, 1)).alias(f"t{i}") for i, t in enumerate(thresholds)]
    queries = pairs.select(F.col("base").alias("query_id"), "departure").distinct()
    intact = baseline.join(queries, "query_id").groupBy(F.col("query_id").alias("base")).agg(*within)
    hurt = damaged.join(pairs.select("query_id", "departure"), "query_id").groupBy("query_id").agg(*[c.alias(f"d{i}") for i, c in enumerate(within)])
    loss = pairs.join(intact, "base").join(hurt, "query_id", "left")
    each = sum(F.greatest(F.col(f"t{i}") - F.coalesce(f"d{i}", F.lit(0)), F.lit(0)) / stations for i in range(len(thresholds))) / len(thresholds)
    accessibility = loss.groupBy("removed").agg(F.avg(each).alias("accessibility_auc_loss"), F.count(F.lit(1)).alias("query_count"))
    b = baseline.select(F.col("query_id").alias("base"), "station", F.col("arrival").alias("b_arrival"), F.col("transfers").alias("b_transfers"))
    both = pairs.select("query_id", "base", "removed").join(b, "base").join(damaged, ["query_id", "station"], "left")
    delay = F.greatest(F.col("arrival") - F.col("b_arrival"), F.lit(0))
    both = both.withColumn("delay", F.when(F.col("arrival").isNotNull(), delay))
    sums = both.groupBy("removed").agg(
        (F.count(F.when(F.col("arrival").isNull(), 1)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("unreachable_share"),
        F.coalesce(F.avg("delay"), F.lit(0.0)).alias("mean_delay"),
        F.coalesce(F.avg(F.when(F.col("arrival").isNotNull(), F.greatest(F.col("transfers") - F.col("b_transfers"), F.lit(0)))), F.lit(0.0)).alias("mean_extra_transfers"),
    )
    p95 = nearest_rank(both, ["removed"], "delay", 0.95, "p95_delay")
    return accessibility.join(sums, "removed", "left").join(p95, "removed", "left")


def service_loss(calls: DataFrame, stations: int) -> DataFrame:
    """Per line the share of all stations that no other line serves."""
    own = calls.select("line", "station").distinct()
    lines = own.groupBy("station").agg(F.count(F.lit(1)).alias("lines"))
    one = F.count(F.when(F.col("lines") == 1, 1))
    return own.join(lines, "station").groupBy("line").agg((one / F.lit(max(stations, 1))).alias("service_loss_share"))
