"""Whole trips answer what calls and segments answer, a runtime is counted once, and the graph puts items in order once."""

from pyspark.sql import functions as F

from linehaul.operators import network as N
from linehaul.plans import encoder as P
from linehaul.scratch import Scratch
from linehaul.sources import timetable as T

#: trip, line, stations; trip 3 leaves its second stop before it comes, trip 4 has the pattern of trip 3, trip 5 starts with a loop.
TRIPS = [(1, "a", (1, 2, 3)), (2, "a", (1, 2, 3)), (3, "b", (2, 3, 1, 2, 3)), (4, "b", (2, 3, 1, 2, 3)), (5, "b", (4, 4, 1)), (6, "a", (3, 1, 2))]


def _calls(spark):
    rows = [(t, line, s, k, 1000 * t + 100 * k - (500 if (t, k) == (3, 1) else 0), 1000 * t + 100 * k + 10 * t, k % 2, 0) for t, line, stops in TRIPS for k, s in enumerate(stops)]
    return spark.createDataFrame(rows, "trip_id long, line string, station int, pos int, arrival int, departure int, pickup int, drop_off int")


def _rows(df, columns=None):
    return sorted(map(tuple, df.select(*(columns or sorted(df.columns))).collect()))


def test_whole_trips_have_the_same_calls_segments_and_signatures(spark):
    calls = _calls(spark)
    trips = N.whole_trips(calls)
    assert _rows(N.trip_calls(trips)) == _rows(calls)
    assert _rows(N.trip_segments(trips)) == _rows(N.segments(calls)) != []
    assert _rows(N.trip_signatures(trips).drop("rides")) == _rows(N.signatures(calls))


def test_patterns_give_the_edge_positions_that_trips_give(spark):
    calls, scratch = _calls(spark), Scratch(spark, "test")
    signed = N.trip_signatures(N.whole_trips(calls))
    pats, counted = N.patterns(calls, scratch), N.numbered_patterns(signed, scratch)
    assert _rows(counted, [*N.SIGNATURE, "pattern"]) == _rows(pats.select(*N.SIGNATURE, F.col("pattern").cast("long").alias("pattern")).distinct(), [*N.SIGNATURE, "pattern"])
    want = _rows(N.edge_positions(N.segments(calls), pats), [*N.EDGE, "relative_position"])
    assert _rows(N.pattern_edge_positions(counted), [*N.EDGE, "relative_position"]) == want
    # trip 4 could ride 2>3 at the start, but trip 3, the first of the pattern, can do so at its end only
    assert (2, 3, "b", 0.75) in want


def test_edges_count_runtimes_in_one_shuffle(spark):
    segs = N.segments(_calls(spark))
    edges = N.transit_edges(segs)
    want = segs.groupBy(*N.EDGE).agg(F.count(F.lit(1)).alias("trips"), F.min("runtime").alias("min_runtime")).join(N.upper_median(segs, N.EDGE, "runtime", "median_runtime"), N.EDGE)
    assert _rows(edges) == _rows(want) and edges.schema["trips"].dataType.simpleString() == "bigint"
    assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_the_graph_puts_items_in_order_once(spark, monkeypatch):
    asked, stop_times = [], T.stop_times
    monkeypatch.setattr(T, "stop_times", lambda *a, **k: asked.append(a) or stop_times(*a, **k))
    P.graph(spark, "/root/testdata/sf0.001", Scratch(spark, "test"))
    assert len(asked) == 1


def test_edge_queries_read_items_no_more_than_once(spark):
    from linehaul import catalogue

    for name in ("segment_edge_lookup", "graph_edge_features"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan, name
