import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from linehaul.operators import calendar as C
from linehaul.operators import network as N
from linehaul.operators import router as R
from linehaul.operators import stations as ST
from linehaul.sources import gtfs as G

STOPS = "﻿stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station,extra\n" + "\n".join(
    f"station_{c},{n},48.1{i}00,16.1{i}00,1,,x" for i, (c, n) in enumerate(zip("abcde", ("Alpha", "Bravo", "Central", "Delta", "Echo"), strict=True))
) + "\n" + "\n".join(f"platform_{c},{n},48.1{i}00,16.1{i}00,0,station_{c}," for i, (c, n) in ((0, ("a1", "Alpha")), (1, ("b", "Bravo")), (2, ("c", "Central")), (3, ("d", "Delta")), (4, ("e", "Echo"))))
ROUTES = "route_id,agency_id,route_short_name,route_long_name,route_type\nblue,agency,Blue,,1\ngreen,agency,Green,,3\nred,agency,Red,,3\n"
TRIPS = "route_id,service_id,trip_id\nblue,weekday,blue-1\nblue,weekday,blue-2\ngreen,weekday,green-1\nred,weekday,red-1\n"


def times(trip, stops, start):
    out = []
    for i, s in enumerate(stops):
        arr = start + 300 * i
        clock = lambda t: f"{t // 3600}:{t // 60 % 60:02d}:{t % 60:02d}"
        out.append(f"{trip},{clock(arr)},{clock(arr + 30)},{s},{i + 1},,")
    return out


def write(folder):
    rows = times("blue-1", ["platform_a1", "platform_b", "platform_c"], 27000) + times("blue-2", ["platform_a1", "platform_b", "platform_c"], 90900)
    rows += times("green-1", ["platform_a1", "platform_b", "platform_c"], 27060) + times("red-1", ["platform_c", "platform_d", "platform_e"], 27720)
    files = {"stops": STOPS, "routes": ROUTES, "trips": TRIPS, "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type\n" + "\n".join(rows)}
    files["calendar"] = "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nweekday,1,1,1,1,1,0,0,20260101,20261231\n"
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text)


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    write(folder)
    return G.read_feed(spark, str(folder))


def test_reads_and_validates(spark, feed, tmp_path):
    assert feed.stops.count() == 10 and feed.trips.count() == 4 and feed.transfers.count() == 0
    assert feed.stops.where("stop_id = 'station_a'").collect()[0]["stop_name"] == "Alpha"
    assert G.validate(feed).count() == 0
    write(tmp_path)
    (tmp_path / "trips.txt").write_text(TRIPS + "none,weekday,lost\nblue,weekday,blue-1\n")
    bad = {(r["issue"], r["key"]) for r in G.validate(G.read_feed(spark, str(tmp_path))).collect()}
    assert bad == {("trip without route", "none"), ("duplicate trip_id", "blue-1")}
    (tmp_path / "stops.txt").unlink()
    with pytest.raises(FileNotFoundError):
        G.read_feed(spark, str(tmp_path))


def test_archive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in")
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for f in (tmp_path / "in").iterdir():
            z.write(f, f"nested/{f.name}")
    assert G.read_feed(spark, str(tmp_path / "feed.zip"), str(tmp_path / "out")).trips.count() == 4


def test_calendar(spark, feed):
    services = feed.trips.select("service_id")
    monday, sunday = datetime.date(2026, 9, 7), datetime.date(2026, 9, 6)
    assert C.active_trips(feed.trips, C.active_services(feed.calendar, feed.calendar_dates, services, monday)).count() == 4
    assert C.active_services(feed.calendar, feed.calendar_dates, services, sunday).count() == 0
    added = spark.createDataFrame([("weekday", "20260906", "2", 1), ("weekday", "20260906", "1", 2)], "service_id string, date string, exception_type string, row_no long")
    assert C.active_services(feed.calendar, added, services, sunday).count() == 1
    with pytest.raises(ValueError):
        C.active_services(feed.calendar, spark.createDataFrame([("weekday", "20260906", "9", 1)], added.schema), services, sunday)


def network(feed):
    stops = feed.stops.select("stop_id", F.col("stop_name").alias("name"), F.col("stop_lat").cast("double").alias("lat"), F.col("stop_lon").cast("double").alias("lon"), F.col("location_type").cast("int").alias("location_type"), "parent_station")
    parents = ST.link_pairs(stops, stops.where("parent_station IS NOT NULL").select(F.col("stop_id").alias("a"), F.col("parent_station").alias("b")), "parent", 1.0, None)
    stations, of = ST.merge_stations(stops, parents.unionByName(ST.exact_name_pairs(stops)))
    lines = G.lines_of(feed.trips, feed.routes, "feed")
    rows = G.typed_stop_times(feed.stop_times).join(of, "stop_id").join(lines.select("trip_id", "line"), "trip_id")
    return stations, N.merge_calls(rows.select("trip_id", "line", "station", "seq", "arrival", "departure", "pickup", "drop_off"))


def test_network_of_the_fixture(spark, feed):
    stations, calls = network(feed)
    assert [r["name"] for r in stations.orderBy("station").collect()] == ["Alpha", "Bravo", "Central", "Delta", "Echo"]
    edges = N.transit_edges(N.segments(calls)).collect()
    assert len(edges) == 6 and {r["median_runtime"] for r in edges} == {270}
    pats = N.patterns(calls)
    assert pats.select("pattern").distinct().count() == 3
    heads = {r["line"]: r["headway"] for r in N.line_headways(pats).collect()}
    assert heads == {"feed:agency:Blue:1": 63900, "feed:agency:Green:3": 0, "feed:agency:Red:3": 0}
    shared = {r["line"]: r["shared_fraction"] for r in N.line_sharing(N.segments(calls)).collect()}
    assert shared == {"feed:agency:Blue:1": 1.0, "feed:agency:Green:3": 1.0, "feed:agency:Red:3": 0.0}
    assert sum(r["departures"] for r in N.station_bins(calls).collect()) == calls.count()


def routes(spark, calls, **how):
    walks = spark.createDataFrame([(2, 3, 120)], "from_station int, to_station int, seconds int")
    q = spark.createDataFrame([(1, 0, 27000, how.get("disabled"), how.get("closed"), None, None)], R.QUERY)
    return {r["station"]: (r["arrival"], r["transfers"]) for r in R.one_to_all(calls, walks, q).collect()}


def test_routes_of_the_fixture(spark, feed):
    calls = network(feed)[1].cache()
    assert routes(spark, calls) == {0: (27000, 0), 1: (27300, 0), 2: (27600, 0), 3: (27720, 0), 4: (28320, 1)}
    blue = routes(spark, calls, disabled=["feed:agency:Blue:1"])
    assert blue == {0: (27000, 0), 1: (27360, 0), 2: (27660, 0), 3: (27780, 0), 4: (28320, 1)}
    assert routes(spark, calls, disabled=["feed:agency:Red:3"]) == {0: (27000, 0), 1: (27300, 0), 2: (27600, 0), 3: (27720, 0)}
    assert routes(spark, calls, closed=0) == {}


def test_compile_and_label(spark, feed):
    from linehaul import commands as M

    net = M.compile_network(feed, datetime.date(2026, 9, 7), "feed")
    counts = {k: net[k].count() for k in ("stations", "lines", "edges", "interchanges", "transfers")}
    assert counts == {"stations": 5, "lines": 3, "edges": 6, "interchanges": 6, "transfers": 0}
    graph = M.build_graph(net)
    assert {len(r["features"]) for r in graph["line_features"].collect()} == {18} and {len(r["features"]) for r in graph["station_features"].collect()} == {16}
    labels = {r["removed"]: r for r in M.line_removal_labels(net, [0], [27000], 3).collect()}
    assert labels["feed:agency:Red:3"]["unreachable_share"] == 0.4 and labels["feed:agency:Blue:1"]["mean_delay"] > 0
    assert labels["feed:agency:Red:3"]["service_loss_share"] == 0.4
    assert [r["line"] for r in M.find_lines(net["lines"], "red").collect()] == ["feed:agency:Red:3"]
    with pytest.raises(ValueError):
        M.compile_network(feed, datetime.date(2026, 9, 6), "feed")
