"""Numbers and running sums in a total order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linehaul.scratch import Scratch


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, scratch: Scratch, before: dict[str, str] | None = None) -> DataFrame:
    """``df`` with each row's place in ``order``, from 0, and in ``before`` (new name: column) the sums over the rows ahead of it.

    Rows are dealt to ranges of the order and counted inside them; what the ranges ahead hold is added, and only that,
    a row for each shuffle partition, is put in order as a whole. The order should be total; equal rows stand in any order.
    """
    before = before or {}
    rows = scratch.table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in before.items()])
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = sizes.select("_range", zero(F.sum("_rows").over(ranges)).alias("_rows"), *[zero(F.sum(f"_sum_{n}").over(ranges)).alias(f"_sum_{n}") for n in before])
    rows = rows.select("*", F.row_number().over(inside).alias("_row"), *[zero(F.sum(c).over(ahead)).alias(f"_own_{n}") for n, c in before.items()])
    # a row for each range: as many as there are shuffle partitions
    rows = rows.join(F.broadcast(offsets), "_range")
    return rows.select(*df.columns, (F.col("_rows") + F.col("_row") - 1).cast("long").alias(name), *[(F.col(f"_sum_{n}") + F.col(f"_own_{n}")).alias(n) for n in before])
