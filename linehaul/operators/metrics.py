"""Ranking metrics and percentiles, per group of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch


def average_rank(group: list[str], value: str) -> Column:
    """Rank from 1 with ties at their mean."""
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2.0


def spearman(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks; null with fewer than two rows or without variance."""
    ranks = df.select(*group, average_rank(group, a).alias("ra"), average_rank(group, b).alias("rb"))
    n = F.count(F.lit(1))
    cov = F.sum(F.col("ra") * F.col("rb")) - F.sum("ra") * F.sum("rb") / n
    va, vb = (F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / n for c in ("ra", "rb"))
    return ranks.groupBy(*group).agg(n.alias("n"), cov.alias("cov"), va.alias("va"), vb.alias("vb")).select(*group, F.when((F.col("n") >= 2) & (F.col("va") > 0) & (F.col("vb") > 0), F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).alias("spearman"))


def ndcg_at_k(df: DataFrame, group: list[str], prediction: str, target: str, index: str, k: int) -> DataFrame:
    """Gain 2^max(target, 0) - 1, discount log2(rank + 2), ties by ``index``; 0 where the ideal gain is 0."""
    w = Window.partitionBy(*group)
    rows = df.withColumn("_p", F.row_number().over(w.orderBy(F.desc(prediction), index)) - 1).withColumn("_t", F.row_number().over(w.orderBy(F.desc(target), index)) - 1)
    gain = F.pow(F.lit(2.0), F.greatest(F.col(target), F.lit(0.0))) - 1
    part = lambda rank: F.sum(F.when(F.col(rank) < k, gain / F.log2(F.col(rank) + 2.0)).otherwise(0.0))
    return rows.groupBy(*group).agg(part("_p").alias("_dcg"), part("_t").alias("_ideal")).select(*group, F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def top_k_recall(df: DataFrame, group: list[str], prediction: str, target: str, index: str, k: int) -> DataFrame:
    """Share of the k largest targets among the k largest predictions; of all rows where there are fewer."""
    w = Window.partitionBy(*group)
    rows = df.withColumn("_p", F.row_number().over(w.orderBy(F.desc(prediction), index))).withColumn("_t", F.row_number().over(w.orderBy(F.desc(target), index)))
    return rows.groupBy(*group).agg((F.count(F.when((F.col("_p") <= k) & (F.col("_t") <= k), 1)) / F.least(F.lit(k), F.count(F.lit(1)))).alias("recall"))


#: Rows of a block whose inversions a task counts, and the most blocks of an order: beyond both, blocks grow.
BLOCK, BLOCKS = 1 << 16, 1024


def _earlier_larger(values: np.ndarray) -> np.ndarray:
    """For each of distinct values the number of earlier ones that are larger, by merging halves of doubling width."""
    n, at, found = len(values), np.arange(len(values)), np.zeros(len(values), np.int64)
    x, width = np.argsort(np.argsort(values)), 1
    while width < n:
        block, right = at // (2 * width), (at // width) % 2 == 1
        key = block * n + x
        # the left half of a block that has a right one is whole
        found[right] += (block[right] + 1) * width - np.searchsorted(np.sort(key[~right]), key[right])
        width *= 2
    return found


def _discordant(rows: DataFrame, group: list[str], first: list[Column], second: list[Column], scratch: Scratch, block: int) -> DataFrame:
    """Per group the pairs of rows that the two orders put differently: ``discordant``; rows equal in both are not.

    Rows get their places in both orders, the group ahead of each, and the places are cut into blocks. Pairs of different
    blocks in both orders are counted from the numbers of rows per pair of blocks, the others inside their blocks: those
    of one block of the first order, those of one of the second, less those of both. No task sees a whole group.
    """
    found = T.StructType([*rows.select(*group).schema, T.StructField("found", T.LongType())])
    names = found.fieldNames()

    def inside(table: pa.Table) -> pa.Table:
        t = table.sort_by("_a")
        out = t.select(group).append_column("found", pa.array(_earlier_larger(t["_b"].to_numpy()))).group_by(group).aggregate([("found", "sum")])
        return out.rename_columns({"found_sum": "found"}).select(names)

    if (n := rows.count()) <= block:  # one block
        for order, name in ((first, "_a"), ([*second, "_a"], "_b")):
            rows = rows.withColumn(name, F.row_number().over(Window.orderBy(*group, *order)))
        return rows.withColumn("_x", F.lit(0)).groupBy("_x").applyInArrow(inside, found).withColumnRenamed("found", "discordant")
    rows = numbered(rows, [*group, *first], "_a", scratch)
    rows = scratch.table(numbered(rows, [*group, *second, "_a"], "_b", scratch), "places")
    width = max(block, -(-n // BLOCKS))
    rows = rows.select(*group, "_a", "_b", F.floor(F.col("_a") / width).alias("_x"), F.floor(F.col("_b") / width).alias("_y"))

    def across(table: pa.Table) -> pa.Table:
        x, y = (table[c].to_numpy() - table[c].to_numpy().min() for c in ("_x", "_y"))
        cells = np.zeros((x.max() + 1, y.max() + 1), np.int64)
        cells[x, y] = table["n"].to_numpy()
        later = cells[::-1].cumsum(0)[::-1] - cells
        pairs = int((cells[:, 1:] * later.cumsum(1)[:, :-1]).sum())
        return table.select(group).slice(0, 1).append_column("found", pa.array([pairs]))

    cells = rows.groupBy(*group, "_x", "_y").agg(F.count(F.lit(1)).alias("n"))
    many = cells.groupBy(*group).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high")).where("_low < _high").select(*group)
    parts = cells.join(many, group).groupBy(*group).applyInArrow(across, found)
    for keys, sign in ((["_x"], 1), (["_y"], 1), (["_x", "_y"], -1)):
        parts = parts.unionByName(rows.groupBy(*keys).applyInArrow(inside, found).withColumn("found", F.col("found") * sign))
    return parts.groupBy(*group).agg(F.sum("found").alias("discordant"))


def pairwise_accuracy(df: DataFrame, group: list[str], prediction: str, target: str, index: str, scratch: Scratch | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of rows of a group that predictions and targets order alike: ``pairs`` and ``pairwise_accuracy``.

    Of two rows, the one of smaller ``index`` first, an equal value counts as the larger. So values with the index
    downwards are total orders, and the pairs not alike are those that the two orders put differently. Rows of one index
    are no pair; pairs with a null value count but are left out of the share.
    """
    scratch = scratch or Scratch(df.sparkSession, "pairs")
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in group)
    rows = scratch.table(df.select(*group, F.col(index).alias("_i"), F.col(prediction).alias("_p"), F.col(target).alias("_t")).where(f"{known} AND _i IS NOT NULL"), "rows")
    full = rows.where("_p IS NOT NULL AND _t IS NOT NULL")
    two = lambda n: F.shiftright(n * (n - 1), 1)
    same = rows.groupBy(*group, "_i").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_p").isNotNull() & F.col("_t").isNotNull(), 1)).alias("m"))
    sizes = same.groupBy(*group).agg(*[(two(F.sum(c)) - F.sum(two(F.col(c)))).alias(name) for c, name in (("n", "pairs"), ("m", "full"))]).where("pairs > 0")
    unlike = _discordant(full, group, ["_t", F.desc("_i"), "_p"], ["_p", F.desc("_i"), "_t"], scratch, block)
    again = same.where("m > 1").select(*group, "_i")
    if again.limit(1).count():
        of_one = _discordant(full.join(again, [*group, "_i"]), [*group, "_i"], ["_t", "_p"], ["_p", "_t"], scratch, block).select(*group, -F.col("discordant"))
        unlike = unlike.union(of_one).groupBy(*group).agg(F.sum("discordant").alias("discordant"))
    alike = 1 - F.coalesce("discordant", F.lit(0)) / F.nullif("full", F.lit(0))
    return sizes.join(unlike, group, "left").select(*group, "pairs", alike.alias("pairwise_accuracy"))


def cume_dist(group: list[str], value: str) -> Column:
    return F.cume_dist().over(Window.partitionBy(*group).orderBy(value))


def midrank_percentile(group: list[str], value: str) -> Column:
    """(below + half of the equal ones) / all; 0.5 for a single row."""
    w = Window.partitionBy(*group)
    below, equal, n = F.rank().over(w.orderBy(value)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*group, value)), F.count(F.lit(1)).over(w)
    return F.when(n <= 1, 0.5).otherwise((below + equal * F.lit(0.5).cast("double")) / n)


def standardized(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population standard deviation of at least 1e-6."""
    w = Window.partitionBy(*group)
    return df.select("*", *[((F.col(c) - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(1e-6))).alias(f"{c}_std") for c in columns])
