"""What a user runs: validate, compile, graph, route, label, search and evaluate, as functions over DataFrames."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.operators import calendar as C
from linehaul.operators import graph as G
from linehaul.operators import labels as L
from linehaul.operators import network as N
from linehaul.operators import router as R
from linehaul.operators import stations as ST
from linehaul.scratch import Scratch
from linehaul.sources import gtfs


def validate(feed: gtfs.Feed) -> DataFrame:
    """Issues of a feed; none means it can be compiled."""
    return gtfs.validate(feed)


def compile_network(feed: gtfs.Feed, day: datetime.date, feed_id: str, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """One service day of a valid feed: stations, stop_to_station, lines, calls, patterns, edges, edge_bins, transfers, interchanges.

    An invalid feed, a day without trips and a feed without usable patterns are errors.
    """
    spark: SparkSession = feed.stops.sparkSession
    scratch = Scratch(spark, "compile")
    if validate(feed).limit(1).count():
        raise ValueError("the feed has issues; see validate()")
    services = C.active_services(feed.calendar, feed.calendar_dates, feed.trips, day)
    trips = scratch.table(C.active_trips(feed.trips, services), "trips")
    if trips.isEmpty():
        raise ValueError(f"no trip runs on {day}")
    tasks = gtfs.tasks_for(feed.stop_times)
    by_trip = lambda t: gtfs.dealt(t, "trip_id", tasks)
    times = scratch.table(by_trip(gtfs.typed_stop_times(feed.stop_times)).join(by_trip(trips.select("trip_id")), "trip_id", "left_semi"), "times")
    ends = [t.select(F.col(c).alias("stop_id")) for t in (feed.transfers, feed.pathways) for c in ("from_stop_id", "to_stop_id")]
    wanted = times.select("stop_id")
    for e in ends:
        wanted = wanted.union(e)
    used = ST.parent_closure(feed.stops, wanted.join(feed.stops.select("stop_id"), "stop_id", "left_semi"))
    stops = feed.stops.join(used, "stop_id", "left_semi").select("stop_id", F.coalesce("stop_name", F.lit("")).alias("name"), S.coordinate_or_zero(F.col("stop_lat")).alias("lat"), S.coordinate_or_zero(F.col("stop_lon")).alias("lon"), F.coalesce(F.col("location_type").try_cast("int"), F.lit(0)).alias("location_type"), "parent_station")
    stops = scratch.table(stops, "stops")
    pair = lambda t: t.select(F.col("from_stop_id").alias("a"), F.col("to_stop_id").alias("b"))
    evidence = ST.link_pairs(stops, stops.where("parent_station IS NOT NULL").select(F.col("stop_id").alias("a"), F.col("parent_station").alias("b")), "parent", 1.0, None)
    for part in (ST.link_pairs(stops, pair(feed.pathways), "pathway", 1.0), ST.link_pairs(stops, pair(feed.transfers), "transfer", 0.95, same_name=True), ST.exact_name_pairs(stops), ST.fuzzy_name_pairs(stops)):
        evidence = evidence.unionByName(part)
    stations, of = ST.merge_stations(stops, scratch.table(evidence, "evidence"))
    stations, of = scratch.table(stations, "stations"), scratch.table(of, "of")
    lines = scratch.table(gtfs.lines_of(trips, feed.routes, feed_id, overrides), "lines")
    rows = by_trip(times.join(of, "stop_id")).join(by_trip(lines.select("trip_id", "line")), "trip_id")
    whole = scratch.table(N.whole_trips(N.merge_calls(rows.select("trip_id", "line", "station", "seq", "arrival", "departure", "pickup", "drop_off"))), "whole")
    calls = N.trip_calls(whole)
    if whole.isEmpty():
        raise ValueError("no trip has two stations")
    index = by_trip(lines).join(by_trip(whole.select("trip_id")), "trip_id", "left_semi").groupBy("line").agg(F.min_by("display", "row_no").alias("display"), F.min_by("route_type", "row_no").alias("route_type"), F.array_sort(F.collect_set("route_id")).alias("routes")).withColumn("bucket", S.mode_bucket(F.col("route_type")))
    segs = N.trip_segments(whole)
    at = lambda t, c, name: t.join(of.select(F.col("stop_id").alias(c), F.col("station").alias(name)), c)
    explicit = at(at(feed.transfers, "from_stop_id", "from_station"), "to_stop_id", "to_station").select("from_station", "to_station", F.coalesce(S.small_code(F.col("transfer_type"), 5), F.lit(0)).alias("transfer_type"), F.coalesce(F.col("min_transfer_time").try_cast("int"), F.lit(0)).alias("seconds"), "row_no")
    ways = at(at(feed.pathways, "from_stop_id", "from_station"), "to_stop_id", "to_station").select("from_station", "to_station", F.when(F.col("is_bidirectional") == "1", 1).otherwise(0).alias("bidirectional"), F.coalesce(F.col("traversal_time").try_cast("int"), F.lit(0)).alias("seconds"), "row_no")
    return {
        "stations": stations, "stop_to_station": of, "lines": index, "calls": calls, "patterns": N.patterns(calls, scratch, N.trip_signatures(whole).drop("rides")), "edges": N.transit_edges(segs), "edge_bins": N.edge_bins(segs),
        "transfers": N.dedupe_transfers(explicit, ways), "interchanges": N.interchanges(calls), "evidence": evidence,
    }


def build_graph(network: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Feature rows of a compiled network."""
    calls, stations, modes = network["calls"], network["stations"], network["lines"].select("line", "bucket")
    platforms = network["stop_to_station"].groupBy("station").agg(F.count(F.lit(1)).alias("platform_count"))
    segs = N.segments(calls)
    return {
        "station_features": G.station_features(stations.select("station", "lat", "lon"), calls, network["patterns"], modes, network["transfers"], platforms),
        "line_features": G.line_features(G.line_statistics(calls, stations, modes)),
        "edge_features": G.edge_features(network["edges"], N.edge_positions(segs, network["patterns"]), stations),
        "station_temporal": G.temporal(calls, "station"), "line_temporal": G.temporal(calls, "line"), "serves": G.serves(calls),
    }


def line_removal_labels(network: dict[str, DataFrame], origins: list[int], departures: list[int], rides: int = 5, cap: int = 7200) -> DataFrame:
    """Impact of removing each line, over all pairs of origin and departure, with the share of stations that lose all service."""
    calls = network["calls"]
    spark = calls.sparkSession
    scratch, stations = Scratch(spark, "labels"), network["stations"].count()
    starts = [(k, o, d, None, None, None, None) for k, (o, d) in enumerate((o, d) for o in origins for d in departures)]
    queries = spark.createDataFrame(starts, R.QUERY)
    removed = scratch.table(R.line_removals(queries, network["lines"]), "removed")
    intact = scratch.table(R.one_to_all(calls, network["transfers"], queries, rides, cap, scratch), "intact")
    hurt = scratch.table(R.one_to_all(calls, network["transfers"], removed.select(*queries.columns), rides, cap, scratch), "hurt")
    out = L.impact(intact, hurt, removed.select("query_id", "base", "removed", "departure"), stations)
    return out.join(L.service_loss(calls, stations).withColumnRenamed("line", "removed"), "removed", "left")


def find_lines(lines: DataFrame, text: str) -> DataFrame:
    """Lines that a text names: the exact key or display, else those that contain it, in any case."""
    t = text.lower()
    exact = lines.where((F.lower("line") == t) | (F.lower("display") == t))
    return exact if not exact.isEmpty() else lines.where(F.lower("display").contains(t) | F.lower("line").contains(t))


def bench_routing(network: dict[str, DataFrame], origins: list[int], departures: list[int], runs: int = 3) -> dict[str, float]:
    """Queries per second and nearest-rank seconds of whole batches, after one warm-up."""
    spark = network["calls"].sparkSession
    queries = spark.createDataFrame([(k, o, d, None, None, None, None) for k, (o, d) in enumerate((o, d) for o in origins for d in departures)], R.QUERY)
    took = []
    for _ in range(runs + 1):
        began = time.time()
        R.one_to_all(network["calls"], network["transfers"], queries).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    took = sorted(took[1:])
    rank = lambda share: took[max(0, -(-int(len(took) * share * 100) // 100) - 1)]
    return {"queries_per_second": len(origins) * len(departures) * len(took) / sum(took), "p50_seconds": rank(0.5), "p95_seconds": rank(0.95)}
