"""Scope files and boundaries: nesting, holes, buffers, errors, and a feed cut by a file."""

import random

import pytest
from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.scratch import Scratch
from linehaul.sources import artifacts as A
from linehaul.sources import scope as SC

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]


def written(spark, value, name="b.geojson"):
    path = f"{Scratch(spark, 't').path('files')}/{name}"
    A.write_json(spark, path, value)
    return path


def test_nested_collections_holes_and_buffer_equal_the_scalar_rule(spark):
    far = [[170.0, -80.0], [179.0, -80.0], [175.0, -70.5]]
    deep = {"type": "FeatureCollection", "features": [{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [far], [[[0, 0], [1, 1]]]]}}]}, {"type": "Feature", "geometry": None}]}
    rings = SC.polygon_rings(spark, written(spark, deep))
    assert sorted((r["ring"], len(r["points"])) for r in rings.collect()) == [(0, 3), (0, 5), (1, 4)]
    rng = random.Random(3)
    stops = [(k, rng.uniform(-1, 5), rng.uniform(-1, 5)) for k in range(300)] + [(900, -75.0, 175.0), (901, None, 1.0), (902, 1.5, 1.5), (903, 0.5, 0.5)]
    df = spark.createDataFrame([(*s, "x") for s in stops], "stop_id int, lat double, lon double, polygon string")
    polygons = [[[tuple(p) for p in SQUARE], [tuple(p) for p in HOLE]], [[tuple(p) for p in far]]]
    for km in (0.0, 30.0):
        want = {r["stop_id"] for r in df.where(S.contains_stop(F.col("lat"), F.col("lon"), polygons, km)).collect()}
        got = SC.stops_inside(df, rings, km)
        assert got.columns == df.columns and {r["stop_id"] for r in got.collect()} == want and {900, 903} <= want


@pytest.mark.parametrize("value, said", [({"type": "Point", "coordinates": [1, 2]}, "unsupported"), ({"coordinates": []}, "unsupported"), ({"type": "Feature", "geometry": {"type": "LineString", "coordinates": []}}, "unsupported"), ({"type": "Polygon"}, "without coordinates"), ({"type": "FeatureCollection", "features": []}, "no polygon"), ({"type": "Polygon", "coordinates": [[[1], [2], [3]]]}, "longitude")])
def test_other_geometry_is_an_error(spark, value, said):
    with pytest.raises(Exception, match=said):
        SC.polygon_rings(spark, written(spark, value)).collect()


def test_scope_file_cuts_a_feed(spark):
    from types import SimpleNamespace

    path = written(spark, {"boundary": "b.geojson", "modes": [" Light-Rail", "bus"], "minimum_stops_inside": 2}, "vienna.json")
    A.write_json(spark, path.replace("vienna.json", "b.geojson"), {"type": "Polygon", "coordinates": [SQUARE]})
    scope = SC.read_scope(spark, path)
    assert (scope.name, scope.modes, scope.minimum_stops_inside) == ("vienna", ["light_rail", "bus"], 2)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    feed = SimpleNamespace(
        stops=df([("in1", "1", "1", "hub"), ("in2", "2", "2", None), ("out", "9", "9", None), ("bad", "x", "1", None), ("hub", "99", "99", None)], "stop_id string, stop_lat string, stop_lon string, parent_station string"),
        routes=df([("r", "3"), ("ship", "4")], "route_id string, route_type string"),
        trips=df([("t", "r"), ("short", "r"), ("boat", "ship")], "trip_id string, route_id string"),
        stop_times=df([(t, s) for t, stops in (("t", ("in1", "out", "in2")), ("short", ("in1", "out")), ("boat", ("in1", "in2"))) for s in stops], "trip_id string, stop_id string"),
    )
    cut = SC.apply_scope(feed, scope)
    names = lambda t, c: sorted(r[c] for r in cut[t].collect())
    assert names("trips", "trip_id") == ["t"] and names("stop_times", "stop_id") == ["in1", "in2"] and names("stops", "stop_id") == ["hub", "in1", "in2"] and names("routes", "route_id") == ["r"]
    for buffer in (-1, float("inf")):
        with pytest.raises(ValueError, match="buffer_km"):
            SC.read_scope(spark, written(spark, {"buffer_km": buffer}, "s.json"))
