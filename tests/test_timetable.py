"""The derived timetable: the same whatever number of tasks its trips are dealt to."""

import re

from linehaul.operators import network as N
from linehaul.sources import timetable as T

FOLDER = "/root/testdata/sf0.001"


def test_stop_times_are_dealt_by_size(spark):
    items = T.table(spark, FOLDER, "lineitem").count()
    few, many = T.stop_times(spark, FOLDER, items), T.stop_times(spark, FOLDER, -(-items // 13))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert many.rdd.getNumPartitions() == 13  # more than the session's shuffle partitions
    assert rows(few) == rows(many) and rows(N.merge_calls(few)) == rows(N.merge_calls(many))


def test_merging_calls_keeps_the_tasks_of_the_trips(spark):
    items = T.table(spark, FOLDER, "lineitem").count()
    assert N.segments(N.merge_calls(T.stop_times(spark, FOLDER, -(-items // 13)))).rdd.getNumPartitions() == 13


def test_suppliers_are_held_or_dealt_like_the_trips(spark):
    items, suppliers = (T.table(spark, FOLDER, t).count() for t in ("lineitem", "supplier"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    few, limit = T.stop_times(spark, FOLDER, items), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held, dealt = (T.stop_times(spark, FOLDER, -(-items // 13), n) for n in (suppliers, suppliers - 1))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (held, dealt)]
        by_supplier = [re.findall(r"hashpartitioning\([ls]_suppkey#\d+L?, (\d+)\)", p) for p in plans]
        assert by_supplier == [[], ["13", "13"]]  # never the session's shuffle partitions
        assert rows(held) == rows(dealt) == rows(few)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
