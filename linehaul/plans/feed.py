"""Scalar, feed, validation and station-merge queries, with the driver's tables as carriers."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.operators import calendar as C
from linehaul.operators import stations as ST
from linehaul.operators.components import connected_components
from linehaul.plans.network import rounded
from linehaul.scratch import Scratch
from linehaul.sources import artifacts as A
from linehaul.sources import gtfs as G
from linehaul.sources import scope as SC
from linehaul.sources import timetable as T
from linehaul.sources.timetable import with_sql

QUERIES, ORACLES = {}, {}
DAY = datetime.date(1996, 6, 3)
SCOPE = [[[(16.1, 48.1), (16.9, 48.1), (16.9, 48.9), (16.1, 48.9)], [(16.4, 48.4), (16.6, 48.4), (16.6, 48.6), (16.4, 48.6)]]]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("gtfs_clock_parse", """
SELECT event_id, lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(s AS VARCHAR), 2, '0') AS clock, CASE WHEN m < 60 AND s < 60 THEN CAST(h * 3600 + m * 60 + s AS INT) END AS seconds
FROM (SELECT event_id, event_id % 33 AS h, event_id % 67 AS m, event_id % 61 AS s FROM events)""")
def gtfs_clock_parse(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    two = lambda n: F.lpad((F.col("event_id") % n).cast("string"), 2, "0")
    return e.select("event_id", F.concat_ws(":", two(33), two(67), two(61)).alias("clock")).withColumn("seconds", S.clock_seconds(F.col("clock")))


@query("service_day_bins", "SELECT CAST(least((CAST(floor(epoch(ts)) AS BIGINT) % 86400 + (event_id % 2) * 86400) // 900, 127) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1")
def service_day_bins(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.date_trunc("second", "ts")) % 86400 + (F.col("event_id") % 2) * 86400
    return e.select(S.service_day_bin(seconds).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("mode_buckets", """
SELECT p_size * 4 AS route_type, CASE WHEN p_size * 4 IN (0, 5) THEN 0 WHEN p_size * 4 IN (1, 6, 7, 12) THEN 1 WHEN p_size * 4 = 2 OR p_size * 4 BETWEEN 100 AND 199 THEN 2 WHEN p_size * 4 IN (3, 11) THEN 3 ELSE 4 END AS bucket,
p_size % 13 IN (2, 12) AS is_rail, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def mode_buckets(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select((F.col("p_size") * 4).alias("route_type"), (F.col("p_size") % 13).cast("string").alias("small"))
    return p.select("route_type", S.mode_bucket(F.col("route_type")).alias("bucket"), S.mode_matches(F.col("small"), "Rail").alias("is_rail")).groupBy("route_type", "bucket", "is_rail").agg(F.count(F.lit(1)).alias("n"))


@query("name_normalize", "SELECT p_partkey, lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')) AS name, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def name_normalize(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select("p_partkey", S.normalize_name(F.col("p_name")).alias("name"), S.slug(F.col("p_type")).alias("slug"))


_PAIR = "FROM st a JOIN st b ON a.station < b.station"


@query("haversine_pairs", with_sql(f"""SELECT a.station AS a, b.station AS b,
round(2 * 6371000.0 * asin(least(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)), 1.0)), 3) AS metres {_PAIR}"""))
def haversine_pairs(spark, sf_dir):
    return _pair(spark, sf_dir).select("a", "b", F.round(S.station_distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 3).alias("metres"))


@query("edge_bearing", with_sql(f"""SELECT a, b, round(sin(g), 6) AS sine, round(cos(g), 6) AS cosine FROM (SELECT a.station AS a, b.station AS b,
atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon))) AS g {_PAIR})"""))
def edge_bearing(spark, sf_dir):
    g = S.bearing_radians(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return _pair(spark, sf_dir).select("a", "b", F.round(F.sin(g), 6).alias("sine"), F.round(F.cos(g), 6).alias("cosine"))


def _pair(spark, sf_dir):
    st = T.stations(spark, sf_dir)
    x = st.select(F.col("station").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    y = st.select(F.col("station").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return x.crossJoin(y).where("a < b")  # stations, 25 rows


@query("point_in_polygon_scope", "SELECT s_suppkey, lat, lon, (lon >= 16.1 AND lon < 16.9 AND lat >= 48.1 AND lat < 48.9) AND NOT (lon >= 16.4 AND lon < 16.6 AND lat >= 48.4 AND lat < 48.6) AS inside FROM (SELECT s_suppkey, 48 + ((s_suppkey * 37) % 1000) / 1000.0::DOUBLE + 0.0005 AS lat, 16 + ((s_suppkey * 53) % 1000) / 1000.0::DOUBLE + 0.0005 AS lon FROM supplier)")
def point_in_polygon_scope(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    lat, lon = F.lit(48.0) + ((F.col("s_suppkey") * 37) % 1000) / 1000.0 + 0.0005, F.lit(16.0) + ((F.col("s_suppkey") * 53) % 1000) / 1000.0 + 0.0005
    return s.select("s_suppkey", lat.alias("lat"), lon.alias("lon")).withColumn("inside", S.contains_stop(F.col("lat"), F.col("lon"), SCOPE))


_SQUARE = lambda x, y, d: [[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]
#: A collection in a collection, with a polygon that has a hole, a multi-polygon and a feature without geometry.
_BOUNDARY = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"name": "ring"}, "geometry": {"type": "Polygon", "coordinates": [_SQUARE(16.1, 48.1, 0.5), _SQUARE(16.2, 48.2, 0.2)]}},
    {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[_SQUARE(16.7, 48.0, 0.2)], [_SQUARE(16.8, 48.8, 0.1)]]}}, {"type": "Feature", "geometry": None}]},
]}


@query("geojson_scope", """
SELECT s_suppkey, trips FROM (SELECT s_suppkey, 48 + ((s_suppkey * 37) % 1000) / 1000.0::DOUBLE + 0.0005 AS lat, 16 + ((s_suppkey * 53) % 1000) / 1000.0::DOUBLE + 0.0005 AS lon FROM supplier)
JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS trips FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
WHERE (lon >= 16.1 AND lon < 16.6 AND lat >= 48.1 AND lat < 48.6) AND NOT (lon >= 16.2 AND lon < 16.4 AND lat >= 48.2 AND lat < 48.4)
OR (lon >= 16.7 AND lon < 16.9 AND lat >= 48.0 AND lat < 48.2) OR (lon >= 16.8 AND lon < 16.9 AND lat >= 48.8 AND lat < 48.9)""")
def geojson_scope(spark, sf_dir):
    """Suppliers inside the boundary of a scope file, with the orders that they are in."""
    root = Scratch(spark, "scope").path("files")
    A.write_json(spark, f"{root}/boundary.geojson", _BOUNDARY)
    A.write_json(spark, f"{root}/region.json", {"boundary": "boundary.geojson", "modes": ["Rail", " "], "minimum_stops_inside": 0})
    scope = SC.read_scope(spark, f"{root}/region.json")
    s = T.table(spark, sf_dir, "supplier")
    lat, lon = F.lit(48.0) + ((F.col("s_suppkey") * 37) % 1000) / 1000.0 + 0.0005, F.lit(16.0) + ((F.col("s_suppkey") * 53) % 1000) / 1000.0 + 0.0005
    inside = SC.stops_inside(s.select("s_suppkey", lat.alias("lat"), lon.alias("lon")), scope.rings, scope.buffer_km)
    trips = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_orderkey").alias("trips"))
    return inside.join(trips, "s_suppkey").select("s_suppkey", "trips")


@query("scope_trip_trim", with_sql("""
SELECT trip_id, seq, station FROM (SELECT *, count(*) OVER (PARTITION BY trip_id) AS n FROM tt WHERE station IN (SELECT station FROM st WHERE lat >= 48.02 AND lat < 48.08)) WHERE n >= 2 AND line IN ('1-URGENT', '2-HIGH')"""))
def scope_trip_trim(spark, sf_dir):
    t, st = T.stop_times(spark, sf_dir), T.stations(spark, sf_dir)
    box = [[[(15.0, 48.02), (18.0, 48.02), (18.0, 48.08), (15.0, 48.08)]]]
    stops = st.select(F.col("station").alias("stop_id"), F.lit(None).cast("int").alias("parent_station"), "lat", "lon")
    cut = C.scope(stops, t.select(F.col("line").alias("route_id")).distinct(), t.select("trip_id", F.col("line").alias("route_id")).distinct(), t.withColumnRenamed("station", "stop_id"), stops.where(S.contains_stop(F.col("lat"), F.col("lon"), box)), F.col("route_id").isin("1-URGENT", "2-HIGH"), 2)
    return cut["stop_times"].select("trip_id", "seq", F.col("stop_id").alias("station"))


def _calendar(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    flags = [F.when((F.col("o_orderkey") + i) % 3 == 0, "1").otherwise("0").alias(d) for i, d in enumerate(C.DAYS)]
    regular = o.select(F.col("o_orderkey").cast("string").alias("service_id"), *flags, day("o_orderdate").alias("start_date"), day(F.date_add("o_orderdate", 200)).alias("end_date"))
    odd = T.table(spark, sf_dir, "orders").where("o_custkey % 5 = 0")
    exceptions = odd.select(F.col("o_orderkey").cast("string").alias("service_id"), F.lit("19960603").alias("date"), (F.col("o_custkey") % 2 + 1).cast("string").alias("exception_type"), F.col("o_orderkey").alias("row_no"))
    return regular, exceptions


_ACTIVE = """
SELECT CAST(o_orderkey AS VARCHAR) AS service_id FROM orders WHERE o_orderkey % 3 = 0 AND CAST(o_orderdate AS DATE) <= DATE '1996-06-03' AND CAST(o_orderdate AS DATE) + 200 >= DATE '1996-06-03'
AND NOT (o_custkey % 5 = 0 AND o_custkey % 2 = 1) UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 5 = 0 AND o_custkey % 2 = 0"""


@query("active_services", _ACTIVE)
def active_services(spark, sf_dir):
    regular, exceptions = _calendar(spark, sf_dir)
    return C.active_services(regular, exceptions, regular.select("service_id"), DAY)


@query("active_trips", f"SELECT l_orderkey, count(*) AS n FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN ({_ACTIVE}) GROUP BY 1")
def active_trips(spark, sf_dir):
    regular, exceptions = _calendar(spark, sf_dir)
    trips = T.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_orderkey").cast("string").alias("service_id"))
    return C.active_trips(trips, C.active_services(regular, exceptions, regular.select("service_id"), DAY)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("dangling_refs", "SELECT 'item without order' AS issue, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
def dangling_refs(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0")
    return G.dangling(T.table(spark, sf_dir, "lineitem"), "l_orderkey", orders, "o_orderkey", "item without order")


@query("duplicate_ids", "SELECT 'duplicate item' AS issue, key FROM (SELECT CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS key, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r > 1")
def duplicate_ids(spark, sf_dir):
    return G.duplicates(T.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key")), "key", "item")


def _stops(spark, sf_dir):
    """Parts as stops: names of a few dozen, places on a fine grid."""
    p = T.table(spark, sf_dir, "part")
    lat, lon = F.lit(48.0) + (F.col("p_partkey") % 40) / 2000.0 + 0.0001, F.lit(16.0) + (F.col("p_partkey") % 45) / 1500.0 + 0.0001
    return p.select(F.col("p_partkey").alias("stop_id"), F.col("p_name").alias("name"), lat.alias("lat"), lon.alias("lon"), (F.col("p_size") % 2).alias("location_type"))


_STOPS = """s AS (SELECT p_partkey AS stop_id, p_name AS name, lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')) AS key, 48 + (p_partkey % 40) / 2000.0::DOUBLE + 0.0001 AS lat,
 16 + (p_partkey % 45) / 1500.0::DOUBLE + 0.0001 AS lon, p_size % 2 AS location_type FROM part),
pr AS (SELECT a.stop_id AS a, b.stop_id AS b, a.key AS ka, b.key AS kb, 2 * 6371000.0 * asin(least(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)), 1.0)) AS metres
FROM s a JOIN s b ON abs(floor(a.lat * 1000) - floor(b.lat * 1000)) <= 1 AND abs(floor(a.lon * 1000) - floor(b.lon * 1000)) <= 1 AND a.stop_id > b.stop_id),
ex AS (SELECT a, b, 0.98::DOUBLE AS confidence FROM pr WHERE ka = kb AND ka <> '' AND metres <= 150),
fz AS (SELECT a, b, 0.9 * (1 - levenshtein(ka, kb) / CAST(greatest(length(ka), length(kb)) AS DOUBLE)) AS confidence FROM pr WHERE ka <> kb AND metres <= 90 AND 1 - levenshtein(ka, kb) / CAST(greatest(length(ka), length(kb)) AS DOUBLE) >= 0.92)"""


@query("exact_name_merge", f"WITH {_STOPS} SELECT a, b, confidence FROM ex")
def exact_name_merge(spark, sf_dir):
    return ST.exact_name_pairs(_stops(spark, sf_dir)).select("a", "b", "confidence")


@query("fuzzy_name_merge", f"WITH {_STOPS} SELECT a, b, round(confidence, 6) AS confidence FROM fz".replace("metres <= 90", "metres <= 150").replace(">= 0.92", ">= 0.5"))
def fuzzy_name_merge(spark, sf_dir):
    return rounded(ST.fuzzy_name_pairs(_stops(spark, sf_dir), 150.0, 0.5).select("a", "b", "confidence"), "confidence")


@query("station_merge", f"""
WITH RECURSIVE {_STOPS}, ev AS (SELECT * FROM ex UNION ALL SELECT * FROM fz), l AS (SELECT a, b FROM ev UNION SELECT b, a FROM ev),
re AS (SELECT stop_id AS a, stop_id AS b FROM s UNION SELECT re.a, l.b FROM re JOIN l ON re.b = l.a), c AS (SELECT a AS stop_id, min(b) AS root FROM re GROUP BY a),
t AS (SELECT stop_id, min(confidence) AS confidence FROM (SELECT a AS stop_id, confidence FROM ev UNION ALL SELECT b, confidence FROM ev) GROUP BY 1)
SELECT root, count(*) AS members, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, arg_min(s.stop_id, (CASE WHEN location_type = 1 THEN 0 ELSE 1 END, s.stop_id)) AS canonical_id,
round(least(1, coalesce(min(confidence), 1)), 6) AS merge_confidence, CAST(row_number() OVER (ORDER BY root) - 1 AS INT) AS station FROM c JOIN s ON s.stop_id = c.stop_id LEFT JOIN t ON t.stop_id = c.stop_id GROUP BY root""")
def station_merge(spark, sf_dir):
    stops = _stops(spark, sf_dir)
    stations, _ = ST.merge_stations(stops, Scratch(spark, "links").table(ST.name_links(stops), "links"))
    return rounded(stations.select("root", "members", "lat", "lon", "canonical_id", "merge_confidence", "station"), "lat", "lon", "merge_confidence")


@query("station_components", """
WITH RECURSIVE l AS (SELECT DISTINCT c_nationkey AS a, (c_custkey * 7 % 100000 + 1000) AS b FROM customer), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a""")
def station_components(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    return connected_components(spark, c.select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") * 7 % 100000 + 1000).alias("b")))


@query("line_keys", """
SELECT o_orderpriority || ':' || o_orderstatus AS line, count(*) AS trips, min(o_orderkey) AS first_trip, CAST(row_number() OVER (ORDER BY o_orderpriority || ':' || o_orderstatus) - 1 AS INT) AS line_index FROM orders GROUP BY 1""")
def line_keys(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").groupBy(F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("line")).agg(F.count(F.lit(1)).alias("trips"), F.min("o_orderkey").alias("first_trip"))
    return o.withColumn("line_index", (F.row_number().over(Window.orderBy("line")) - 1).cast("int"))
