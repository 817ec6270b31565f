"""A feed's stop times are dealt to as many tasks as they fill, with the same issues and network."""

import datetime

from linehaul import commands as M
from linehaul.operators import network as N
from linehaul.sources import gtfs as G
from tests.test_feed import write


def test_network_is_the_same_in_many_tasks(spark, tmp_path, monkeypatch):
    write(tmp_path)
    feed = G.read_feed(spark, str(tmp_path))
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    net = lambda: {k: rows(v) for k, v in M.compile_network(feed, datetime.date(2026, 9, 7), "feed").items() if k in ("calls", "edges", "edge_bins", "patterns", "transfers")}
    few, tasks, merge = net(), [], N.merge_calls
    monkeypatch.setattr(G, "TIMES_AT_ONCE", 2)
    monkeypatch.setattr(N, "merge_calls", lambda t: tasks.append(merge(t).rdd.getNumPartitions()) or merge(t))
    assert net() == few and few["edges"]
    assert tasks == [6]  # 12 stop times, 4 shuffle partitions


def test_issues_are_the_same_in_many_tasks(spark, tmp_path, monkeypatch):
    write(tmp_path)
    feed = G.read_feed(spark, str(tmp_path))
    broken = G.Feed(feed.tables | {"trips": feed.trips.where("trip_id <> 'blue-2'").unionByName(feed.trips.where("trip_id = 'red-1'"))})
    few = sorted(map(tuple, G.validate(broken).collect()))
    monkeypatch.setattr(G, "TIMES_AT_ONCE", 2)
    assert G.tasks_for(feed.stop_times) == 6 and sorted(map(tuple, G.validate(broken).collect())) == few
    assert few == [("duplicate trip_id", "red-1"), *[("stop time without trip", "blue-2")] * 3]
