"""A sound network has no issues, and each fault is named."""

import pytest

from linehaul.operators import network as N
from linehaul.operators import validation as V

CALL = "trip_id string, line string, station int, pos int, arrival int, departure int, pickup int, drop_off int"


def network(spark, **other):
    sound = spark.createDataFrame([("t", "a", s, p, p * 100, p * 100 + 20, 0, 0) for p, s in enumerate((0, 1, 2))] + [("u", "b", s, p, p * 50, p * 50, 0, 0) for p, s in enumerate((2, 0))], CALL)
    segs = N.segments(sound)
    make = lambda r, schema: spark.createDataFrame(r, schema)
    return {
        "stations": make([(0,), (1,), (2,)], "station int"), "lines": make([("a",), ("b",)], "line string"), "calls": sound, "patterns": N.patterns(sound), "edges": N.transit_edges(segs), "edge_bins": N.edge_bins(segs),
        "transfers": make([(0, 2)], "from_station int, to_station int"), "interchanges": N.interchanges(sound), "stop_to_station": make([("s", 1)], "stop_id string, station int"),
    } | other


def found(net):
    return {(r["entity"], r["key"], r["issue"]) for r in V.network_issues(net).collect()}


def test_sound_network(spark):
    assert found(network(spark)) == set()


@pytest.mark.parametrize("fault, want", [
    (lambda s: {"stations": s.createDataFrame([(0,), (1,), (1,), (4,)], "station int")}, {("station", "1", "number comes twice"), ("station", "4", "number is not contiguous"), ("calls", "station 2", "points to nothing"), ("edges", "from_station 2", "points to nothing"), ("edges", "to_station 2", "points to nothing"), ("transfers", "to_station 2", "points to nothing")}),
    (lambda s: {"lines": s.createDataFrame([("a",), ("a",), ("b",)], "line string")}, {("line", "a", "comes twice")}),
    (lambda s: {"transfers": s.createDataFrame([(9, None)], "from_station int, to_station int")}, {("transfers", "from_station 9", "points to nothing"), ("transfers", "to_station null", "points to nothing")}),
    (lambda s: {"edge_bins": s.createDataFrame([(0, 1, "a", 128)], "from_station int, to_station int, line string, bin int")}, {("edge_bins", "0 1 a 128", "bin is not of the day")}),
    (lambda s: {"calls": s.createDataFrame([("t", "a", 0, 0, 50, 20, 0, 0), ("t", "a", 1, 1, 10, 30, 0, 0), ("u", "b", 2, 0, 0, 0, 0, 0), ("u", "b", 0, 1, 50, 50, 0, 0), ("w", "b", 0, 0, 1, 1, 0, 0)], CALL)}, {("trip", "t at 0", "arrives after it departs"), ("trip", "t at 1", "arrives before it left the stop before"), ("trip", "t", "does not have a call for each stop"), ("trip", "w", "has no pattern")}),
])
def test_faults_are_named(spark, fault, want):
    assert found(network(spark, **fault(spark))) == want
