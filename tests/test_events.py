"""The event log: numbers per run under redelivery, imports that read their own folders."""

import datetime

import pytest

from linehaul.scratch import Scratch
from linehaul.sources import artifacts as A
from linehaul.streaming import events as E

T0 = datetime.datetime(2026, 1, 1)


def rows(*specs):
    return [(run, event, T0 + datetime.timedelta(seconds=s), "step", f"{run}{event}") for run, event, s in specs]


def deliver(spark, folder, target, cursor, part):
    spark.createDataFrame(part, E.ARRIVING).coalesce(1).write.mode("append").json(folder)
    E.append_numbered(spark.readStream.schema(E.ARRIVING).json(folder), target, cursor).awaitTermination()
    return {(r["run"], r["event"]): r["seq"] for r in E.numbered_events(spark, target).collect()}


def test_numbers_have_no_gap_and_stay_under_redelivery(spark):
    s = Scratch(spark, "t")
    folder, target, cursor = s.path("in"), s.path("log"), s.path("cursor")
    one = rows(("a", "x", 5), ("a", "y", 1), ("b", "x", 0), ("a", "y", 1))
    got = deliver(spark, folder, target, cursor, one)
    assert got == {("a", "y"): 0, ("a", "x"): 1, ("b", "x"): 0}
    two = rows(("a", "z", 0), ("b", "y", 9), ("c", "q", 1), ("a", "x", 5))
    got = deliver(spark, folder, target, cursor, one + two)
    want = {("a", "y"): 0, ("a", "x"): 1, ("b", "x"): 0, ("a", "z"): 2, ("b", "y"): 1, ("c", "q"): 0}
    assert got == want
    # the cursor is lost: all comes again and nothing is added; an attempt that died is not read
    spark.createDataFrame([("a", "dead", T0, "step", "", 99, 0)], f"{E._NUMBERED}, bucket int").write.partitionBy("bucket").parquet(f"{target}/_attempts/dead")
    E.append_numbered(spark.readStream.schema(E.ARRIVING).json(folder), target, s.path("cursor")).awaitTermination()
    assert {(r["run"], r["event"]): r["seq"] for r in E.numbered_events(spark, target).collect()} == want


def test_event_without_run_stops_before_anything_is_written(spark):
    s = Scratch(spark, "t")
    folder, target, cursor = s.path("in"), s.path("log"), s.path("cursor")
    with pytest.raises(Exception, match="lacks its run"):
        deliver(spark, folder, target, cursor, [*rows(("a", "x", 1)), (None, "y", T0, "step", "")])
    assert not A.exists(spark, f"{target}/batches")


def test_one_run_with_nearly_all_events(spark):
    s = Scratch(spark, "t")
    part = rows(*(("hot", f"{k:05d}", k // 7) for k in range(900)), ("cold", "1", 3))
    got = deliver(spark, s.path("in"), s.path("log"), s.path("cursor"), part)
    assert sorted(v for (r, _), v in got.items() if r == "hot") == list(range(900)) and got["cold", "1"] == 0
    assert all(got["hot", f"{k:05d}"] == k for k in range(900))
