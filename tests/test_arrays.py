"""Arrays on disk: exact bytes, gaps refused, graphs saved, read back and validated."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from linehaul.scratch import Scratch
from linehaul.sources import arrays as R


def test_parts_put_together_are_the_array(spark):
    path = Scratch(spark, "t").path("x.u32")
    values = spark.range(1000).select(F.col("id").alias("place"), (F.col("id") * 7 % 1001).alias("value"))
    R.write_array(values.orderBy(F.rand(1)), path, "u32", part=300)
    files = sorted(f for f in glob.glob(path.removeprefix("file://") + "/*") if not f.endswith(".json"))
    raw = b"".join(open(f, "rb").read() for f in files)
    assert len(files) > 1 and (np.frombuffer(raw, "<u4") == np.arange(1000) * 7 % 1001).all()
    assert {(r["place"], r["value"]) for r in R.read_array(spark, path).collect()} == {(k, k * 7 % 1001) for k in range(1000)}


def test_gaps_and_wrong_values_leave_nothing(spark):
    s = Scratch(spark, "t")
    frame = lambda rows: spark.createDataFrame(rows, "place long, value double")
    for rows, said in (([(0, 1.0), (2, 1.0)], "missing"), ([(0, 1.0), (0, 2.0)], "missing|twice"), ([(0, -1.0)], "32-bit"), ([(0, 0.5)], "32-bit")):
        path = s.path("bad")
        with pytest.raises(Exception, match=said):
            R.write_array(frame(rows), path, "u32")
        assert not glob.glob(path.removeprefix("file://") + "*")
    path = s.path("none")
    R.write_array(frame([]), path, "f32")
    assert R.read_array(spark, path).count() == 0


def test_graph_round_trip_and_issues(spark):
    vec = lambda n, k: [float(i + k) for i in range(n)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    graph = {
        "station_features": make([(7, vec(16, 1)), (3, vec(16, 2))], "station int, features array<double>"),
        "line_features": make([("b", vec(18, 3)), ("a", vec(18, 4))], "line string, features array<double>"),
        "edge_features": make([(3, 7, "b", vec(7, 5)), (7, 3, "a", vec(7, 6))], "from_station int, to_station int, line string, features array<double>"),
        "serves": make([(3, "b"), (7, "a")], "station int, line string"),
        "transfers": make([(3, 7)], "from_station int, to_station int"),
        "interchanges": make([("a", "b"), ("b", "a")], "line string, other string"),
    }
    folder = Scratch(spark, "t").path("graph")
    R.save_graph(graph, folder)
    assert {(r["row"], tuple(r["features"])) for r in R.read_matrix(spark, f"{folder}/station_features.f32", 16).collect()} == {(0, tuple(vec(16, 2))), (1, tuple(vec(16, 1)))}
    assert sorted(tuple(r) for r in R.load_relation(spark, folder, "transit").collect()) == [(0, 0, 1, 1), (1, 1, 0, 0)]
    assert R.graph_issues(spark, folder).count() == 0
    for name, kind, rows in (("transfers_to_station.u32", "u32", [(0, 9.0)]), ("line_features.f32", "f32", [(k, float("nan") if k == 4 else 1.0) for k in range(35)])):
        import shutil

        shutil.rmtree(f"{folder}/{name}".removeprefix("file://"))
        R.write_array(make(rows, "place long, value double"), f"{folder}/{name}", kind)
    assert {(r["file"], r["issue"], r["n"]) for r in R.graph_issues(spark, folder).collect()} == {("transfers_to_station", "index out of range", 1), ("line_features", "not finite", 1), ("line_features", "values too many or too few", 1)}
