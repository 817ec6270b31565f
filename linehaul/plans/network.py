"""Queries on the derived timetable: calls, patterns, edges, lines, stations and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.operators import network as N
from linehaul.operators import validation as V
from linehaul.sources import timetable as T
from linehaul.sources.timetable import with_sql


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.merge_calls(T.stop_times(spark, sf_dir))


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.segments(calls(spark, sf_dir))


def pats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.patterns(calls(spark, sf_dir))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("transit_edges", with_sql("SELECT a AS from_station, b AS to_station, line, trips, least AS min_runtime, median AS median_runtime FROM edge"))
def transit_edges(spark, sf_dir):
    return N.transit_edges(segs(spark, sf_dir))


@query("edge_departure_bins", with_sql("""SELECT a AS from_station, b AS to_station, line, CAST(least(dep // 900, 127) AS INT) AS bin, count(*) AS departures,
       list_sort(list(arr - dep))[count(*) // 2 + 1] AS median_runtime FROM seg GROUP BY 1, 2, 3, 4"""))
def edge_departure_bins(spark, sf_dir):
    return N.edge_bins(segs(spark, sf_dir))


@query("edge_runtime_upper_median", with_sql("SELECT line, list_sort(list(arr - dep))[count(*) // 2 + 1] AS median_runtime FROM seg GROUP BY line"))
def edge_runtime_upper_median(spark, sf_dir):
    return N.upper_median(segs(spark, sf_dir), ["line"], "runtime", "median_runtime")


@query("edge_relative_position", with_sql("""
SELECT a AS from_station, b AS to_station, s.line, round(arg_min(pos / CAST(greatest(s.n - 1, 1) AS DOUBLE), (pattern, trip_rank, pos)), 6) AS relative_position
FROM seg s JOIN (SELECT trip_id, pattern, row_number() OVER (PARTITION BY pattern ORDER BY first_departure, trip_id) - 1 AS trip_rank FROM pat) p ON s.trip_id = p.trip_id GROUP BY 1, 2, 3"""))
def edge_relative_position(spark, sf_dir):
    c = calls(spark, sf_dir)
    return rounded(N.edge_positions(N.segments(c), N.patterns(c)), "relative_position")


@query("consecutive_stop_merge", with_sql("SELECT trip_id, line, station, pos, arrival, departure, pickup, drop_off FROM calls"))
def consecutive_stop_merge(spark, sf_dir):
    return calls(spark, sf_dir)


@query("stop_time_violations", with_sql("SELECT trip_id, seq, arrival, departure, before FROM (SELECT *, lag(departure) OVER (PARTITION BY trip_id ORDER BY seq) AS before FROM (SELECT trip_id, seq, CAST(arrival - CASE WHEN (trip_id + seq) % 17 = 0 THEN 400 ELSE 0 END AS INT) AS arrival, CAST(departure - CASE WHEN (trip_id + seq) % 13 = 0 THEN 450 ELSE 0 END AS INT) AS departure FROM tt)) WHERE departure < arrival OR arrival < before"))
def stop_time_violations(spark, sf_dir):
    t, late = T.stop_times(spark, sf_dir), lambda n, s: F.when((F.col("trip_id") + F.col("seq")) % n == 0, s).otherwise(0)  # clocks put wrong here and there
    return N.violations(t.withColumn("arrival", F.col("arrival") - late(17, 400)).withColumn("departure", F.col("departure") - late(13, 450)))


@query("line_summary", with_sql("""
SELECT c.line, stations, first_departure, last_arrival, patterns, trips, greatest(last_arrival - first_departure, 0) AS span
FROM (SELECT line, count(DISTINCT station) AS stations, min(departure) AS first_departure, max(arrival) AS last_arrival FROM calls GROUP BY line) c
JOIN (SELECT line, count(DISTINCT pattern) AS patterns, count(*) AS trips FROM pat GROUP BY line) p ON c.line = p.line"""))
def line_summary(spark, sf_dir):
    c = calls(spark, sf_dir)
    return N.line_summary(c, N.signatures(c))


_GAPS = """(SELECT line, list_sort(list(gap))[count(*) // 2 + 1] AS h FROM (SELECT line, first_departure - lag(first_departure) OVER (PARTITION BY line ORDER BY first_departure) AS gap
 FROM sig WHERE {}) WHERE gap IS NOT NULL GROUP BY line)"""
_PEAK = "((first_departure // 3600) % 24 BETWEEN 7 AND 10 OR (first_departure // 3600) % 24 BETWEEN 16 AND 19)"


@query("line_headways", with_sql(f"""
SELECT l.line, CAST(coalesce(a.h, 0) AS INT) AS headway, CAST(coalesce(p.h, 0) AS INT) AS peak_headway, CAST(coalesce(o.h, 0) AS INT) AS offpeak_headway
FROM (SELECT DISTINCT line FROM sig) l LEFT JOIN {_GAPS.format('true')} a ON l.line = a.line LEFT JOIN {_GAPS.format(_PEAK)} p ON l.line = p.line
LEFT JOIN {_GAPS.format('NOT ' + _PEAK)} o ON l.line = o.line"""))
def line_headways(spark, sf_dir):
    return N.line_headways(N.first_departures(calls(spark, sf_dir)))


@query("line_branching", with_sql("""SELECT line, round(avg(CASE WHEN split_part(stops, ',', 1) <> split_part(stops, ',', -1) THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS branching
FROM (SELECT DISTINCT line, pattern, stops FROM pat) GROUP BY line"""))
def line_branching(spark, sf_dir):
    return rounded(N.line_branching(N.signatures(calls(spark, sf_dir))), "branching")


@query("line_shared_segments", with_sql("""
SELECT line, count(*) AS segments, round(avg(CASE WHEN lines > 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS shared_fraction
FROM (SELECT a, b, line, count(*) OVER (PARTITION BY a, b) AS lines FROM (SELECT DISTINCT a, b, line FROM seg)) GROUP BY line"""))
def line_shared_segments(spark, sf_dir):
    return rounded(N.line_sharing(segs(spark, sf_dir)), "shared_fraction")


_HAVERSINE = "2 * 6371000.0 * asin(least(sqrt(power(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * power(sin(radians({3} - {2}) / 2), 2)), 1.0))"


@query("line_length", with_sql(f"""
SELECT line, round(sum({_HAVERSINE.format('x.lat', 'y.lat', 'x.lon', 'y.lon')}), 3) AS metres
FROM (SELECT DISTINCT a, b, line FROM seg) s JOIN st x ON x.station = a JOIN st y ON y.station = b GROUP BY line"""))
def line_length(spark, sf_dir):
    out = N.line_lengths(segs(spark, sf_dir), T.stations(spark, sf_dir), S.station_distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return out.withColumn("metres", F.round("metres", 3))


@query("line_stations", with_sql("""
SELECT line, count(*) AS stations, round(avg(CASE WHEN lines = 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS unique_fraction, CAST(sum(CASE WHEN lines = 1 THEN 0 ELSE 1 END) AS BIGINT) AS transfer_stations
FROM (SELECT line, station, count(*) OVER (PARTITION BY station) AS lines FROM (SELECT DISTINCT line, station FROM calls)) GROUP BY line"""))
def line_stations(spark, sf_dir):
    return rounded(N.line_stations(calls(spark, sf_dir)), "unique_fraction")


@query("station_summary", with_sql("SELECT station, count(DISTINCT line) AS lines, count(*) AS daily_calls, min(departure) AS first_departure, max(arrival) AS last_departure FROM calls GROUP BY station"))
def station_summary(spark, sf_dir):
    return N.station_summary(calls(spark, sf_dir))


@query("station_transfer_degree", with_sql("SELECT from_station AS station, count(DISTINCT to_station) AS degree FROM (SELECT from_station, to_station FROM tf UNION ALL SELECT to_station, from_station FROM tf) GROUP BY 1"))
def station_transfer_degree(spark, sf_dir):
    return N.transfer_degree(T.transfers(spark, sf_dir))


@query("station_temporal_dense", with_sql("""
SELECT s.station, array_to_string(list(coalesce(n, 0) ORDER BY bin), ',') AS departures
FROM (SELECT DISTINCT station FROM calls) s CROSS JOIN (SELECT unnest(range(128)) AS bin) b
LEFT JOIN (SELECT station, least(departure // 900, 127) AS bin, count(*) AS n FROM calls GROUP BY 1, 2) c USING (station, bin) GROUP BY s.station"""))
def station_temporal_dense(spark, sf_dir):
    bins = N.station_bins(calls(spark, sf_dir))
    return N.dense(bins, ["station"], "bin", "departures").select("station", F.array_join("values", ",").alias("departures"))


@query("station_bin_lines", with_sql("SELECT station, CAST(least(departure // 900, 127) AS INT) AS bin, count(*) AS departures, count(DISTINCT line) AS lines FROM calls GROUP BY 1, 2"))
def station_bin_lines(spark, sf_dir):
    return N.station_bins(calls(spark, sf_dir))


@query("pattern_signatures", with_sql("SELECT line, stops, pu AS pickups, dr AS drop_offs, count(*) AS trips, min(first_departure) AS first_departure FROM sig GROUP BY 1, 2, 3, 4"))
def pattern_signatures(spark, sf_dir):
    return N.signatures(calls(spark, sf_dir)).groupBy("line", "stops", "pickups", "drop_offs").agg(F.count(F.lit(1)).alias("trips"), F.min("first_departure").alias("first_departure"))


@query("pattern_trip_rank", with_sql("SELECT trip_id, pattern, CAST(row_number() OVER (PARTITION BY pattern ORDER BY first_departure, trip_id) - 1 AS INT) AS trip_rank FROM pat"))
def pattern_trip_rank(spark, sf_dir):
    return pats(spark, sf_dir).select("trip_id", "pattern", "trip_rank")


@query("pattern_csr_offsets", with_sql("""
SELECT line, pattern, stops, CAST(sum(stops) OVER (PARTITION BY line ORDER BY pattern ROWS UNBOUNDED PRECEDING) - stops AS BIGINT) AS first FROM (SELECT line, pattern, max(n) AS stops FROM pat GROUP BY 1, 2)"""))
def pattern_csr_offsets(spark, sf_dir):
    from pyspark.sql import Window

    each = pats(spark, sf_dir).groupBy("line", "pattern").agg(F.max("calls").alias("stops"))
    upto = F.sum("stops").over(Window.partitionBy("line").orderBy("pattern").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("line", "pattern", "stops", (upto - F.col("stops")).alias("first"))


@query("interchange_counts", with_sql("""
SELECT x.line, y.line AS other, count(*) AS shared_stations FROM (SELECT DISTINCT line, station FROM calls) x JOIN (SELECT DISTINCT line, station FROM calls) y
ON x.station = y.station AND x.line <> y.line GROUP BY 1, 2"""))
def interchange_counts(spark, sf_dir):
    return N.interchanges(calls(spark, sf_dir))


_EXPLICIT = "SELECT CAST(l_suppkey % 25 AS INT) AS from_station, CAST(l_partkey % 25 AS INT) AS to_station, CAST(l_linenumber % 4 AS INT) AS transfer_type, CAST(60 + (l_orderkey * 7) % 600 AS INT) AS seconds, l_orderkey * 8 + l_linenumber AS row_no FROM lineitem WHERE l_orderkey % 3 = 0"
_PATHWAY = "SELECT CAST(l_partkey % 30 AS INT) AS from_station, CAST(l_suppkey % 30 AS INT) AS to_station, CAST(l_linenumber % 2 AS INT) AS bidirectional, CAST(30 + (l_orderkey * 11) % 300 AS INT) AS seconds, l_orderkey * 8 + l_linenumber AS row_no FROM lineitem WHERE l_orderkey % 3 <> 0"


@query("transfer_dedupe", f"""
WITH e AS ({_EXPLICIT}), p AS ({_PATHWAY}), u AS (SELECT from_station, to_station, seconds, row_no, 0 AS source FROM e WHERE transfer_type <> 3 AND from_station <> to_station
UNION ALL SELECT from_station, to_station, seconds, row_no, 1 FROM p WHERE from_station <> to_station
UNION ALL SELECT to_station, from_station, seconds, row_no, 1 FROM p WHERE from_station <> to_station AND bidirectional = 1)
SELECT from_station, to_station, seconds, CAST(source AS INT) AS source FROM (SELECT *, row_number() OVER (PARTITION BY from_station, to_station ORDER BY source, seconds, row_no) AS r FROM u) WHERE r = 1""")
def transfer_dedupe(spark, sf_dir):
    item = T.table(spark, sf_dir, "lineitem")
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no")
    explicit = item.where("l_orderkey % 3 = 0").select((F.col("l_suppkey") % 25).cast("int").alias("from_station"), (F.col("l_partkey") % 25).cast("int").alias("to_station"), (F.col("l_linenumber") % 4).alias("transfer_type"), (60 + (F.col("l_orderkey") * 7) % 600).cast("int").alias("seconds"), row)
    pathways = item.where("l_orderkey % 3 <> 0").select((F.col("l_partkey") % 30).cast("int").alias("from_station"), (F.col("l_suppkey") % 30).cast("int").alias("to_station"), (F.col("l_linenumber") % 2).alias("bidirectional"), (30 + (F.col("l_orderkey") * 11) % 300).cast("int").alias("seconds"), row)
    return N.dedupe_transfers(explicit, pathways)


@query("network_faults", with_sql("""
SELECT 'trip' AS entity, trip_id || ' at ' || pos AS key, 'arrives before it left the stop before' AS issue FROM (SELECT *, lag(departure) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM (
  SELECT trip_id, pos, arrival, CASE WHEN trip_id % 11 = 0 AND pos = 0 THEN departure + 5000 ELSE departure END AS departure FROM calls)) WHERE arrival < b
UNION ALL SELECT 'calls', 'station ' || station, 'points to nothing' FROM (SELECT DISTINCT station FROM calls) WHERE station % 9 = 4
UNION ALL SELECT 'edges', 'from_station ' || a, 'points to nothing' FROM (SELECT DISTINCT a FROM edge) WHERE a % 9 = 4
UNION ALL SELECT 'edges', 'to_station ' || b, 'points to nothing' FROM (SELECT DISTINCT b FROM edge) WHERE b % 9 = 4
UNION ALL SELECT 'transfers', 'from_station ' || from_station, 'points to nothing' FROM (SELECT DISTINCT from_station FROM tf) WHERE from_station % 9 = 4
UNION ALL SELECT 'transfers', 'to_station ' || to_station, 'points to nothing' FROM (SELECT DISTINCT to_station FROM tf) WHERE to_station % 9 = 4
UNION ALL SELECT 'station', CAST(station AS VARCHAR), 'number is not contiguous' FROM st WHERE station % 9 <> 4 AND station >= (SELECT count(*) FROM st WHERE station % 9 <> 4)"""))
def network_faults(spark, sf_dir):
    """The timetable with some stations gone and some first departures late."""
    c = calls(spark, sf_dir)
    late = F.when((F.col("trip_id") % 11 == 0) & (F.col("pos") == 0), F.col("departure") + 5000).otherwise(F.col("departure"))
    net = {
        "stations": T.stations(spark, sf_dir).where("station % 9 <> 4"), "lines": c.select("line").distinct(), "calls": c.withColumn("departure", late), "patterns": N.patterns(c),
        "edges": N.transit_edges(N.segments(c)), "edge_bins": N.edge_bins(N.segments(c)), "transfers": T.transfers(spark, sf_dir), "interchanges": N.interchanges(c),
    }
    return V.network_issues(net).where("issue <> 'arrives after it departs'")
