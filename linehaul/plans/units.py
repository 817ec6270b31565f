"""Queries of single rules and of feeds, files and logs that are written and read back."""

from __future__ import annotations

import math

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from linehaul import commands
from linehaul.functions import scalars as S
from linehaul.operators import catalog as C
from linehaul.operators import network as N
from linehaul.operators import sampling as SA
from linehaul.operators import schedule as SC
from linehaul.operators import search as R
from linehaul.operators import stations as ST
from linehaul.plans.network import _HAVERSINE, calls, rounded
from linehaul.plans.routing import _RANKED, ranked
from linehaul.scratch import Scratch
from linehaul.sources import artifacts as A
from linehaul.sources import gtfs as G
from linehaul.sources import timetable as T
from linehaul.sources.timetable import with_sql
from linehaul.streaming import events as E

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# --- scalars


@query("short_clock_parse", """
SELECT event_id, CASE WHEN event_id % 71 < 60 THEN CAST((event_id % 30) * 3600 + (event_id % 71) * 60 AS INT) END AS short, CASE WHEN event_id % 5 = 0 AND event_id % 71 < 60 THEN CAST((event_id % 30) * 3600 + (event_id % 71) * 60 + 7 AS INT) END AS long FROM events""")
def short_clock_parse(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    clock = F.concat_ws(":", (F.col("event_id") % 30).cast("string"), F.lpad((F.col("event_id") % 71).cast("string"), 2, "0"))
    return e.select("event_id", S.clock_seconds(clock, True).alias("short"), S.clock_seconds(F.concat(clock, F.when(F.col("event_id") % 5 == 0, ":07").otherwise(""))).alias("long"))


@query("scope_modes", """
SELECT p_size % 14 AS route_type, p_size % 14 IN (0, 5, 6, 7) AS tram, p_size % 14 IN (2, 12) AS suburban_rail, p_size % 14 = 3 AS bus, p_size % 14 NOT IN (0, 5, 6, 7, 1, 2, 12, 3, 4, 11) AS other, count(*) AS n FROM part GROUP BY ALL""")
def scope_modes(spark, sf_dir):
    t = F.col("route_type").cast("string")
    kinds = {"tram": "Tram", "suburban_rail": " Suburban-Rail", "bus": "BUS", "other": "other"}
    p = T.table(spark, sf_dir, "part").select((F.col("p_size") % 14).alias("route_type"))
    return p.groupBy("route_type", *[S.mode_matches(t, w).alias(n) for n, w in kinds.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("optional_codes", """
SELECT event_id, CASE WHEN event_id % 9 = 8 THEN 0 WHEN event_id % 9 <= 3 THEN CAST(event_id % 9 AS INT) END AS pickup, CASE WHEN event_id % 9 = 8 THEN 0 WHEN event_id % 9 <= 5 THEN CAST(event_id % 9 AS INT) END AS transfer FROM events""")
def optional_codes(spark, sf_dir):
    text = F.when(F.col("event_id") % 9 == 8, " ").when(F.col("event_id") % 9 == 7, "x").otherwise((F.col("event_id") % 9).cast("string"))
    return T.table(spark, sf_dir, "events").select("event_id", S.small_code(text, 3).alias("pickup"), S.small_code(text, 5).alias("transfer"))


@query("coordinate_texts", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 WHEN event_id % 4 = 1 THEN 0.0 ELSE CAST(event_id AS DOUBLE) / 8 END AS coordinate FROM events""")
def coordinate_texts(spark, sf_dir):
    n = F.col("event_id")
    text = F.when(n % 4 == 0, "").when(n % 4 == 1, "12,5").when(n % 4 == 2, F.concat(F.lit(" "), (n / 8).cast("string"))).otherwise((n / 8).cast("string"))
    return T.table(spark, sf_dir, "events").select("event_id", S.coordinate_or_zero(text).alias("coordinate"))


@query("scope_buffer", with_sql("""
SELECT station, abs(lat - 48.03) <= 1.5 / 111.0 AND abs(lon - 16.03) <= 1.5 / 111.0 / greatest(abs(cos(radians(lat))), 0.1) OR abs(lat - 48.05) <= 1.5 / 111.0 AND (abs(lon - 16.03) <= 1.5 / 111.0 / greatest(abs(cos(radians(lat))), 0.1) OR abs(lon - 16.05) <= 1.5 / 111.0 / greatest(abs(cos(radians(lat))), 0.1))
 OR abs(lat - 48.03) <= 1.5 / 111.0 AND abs(lon - 16.05) <= 1.5 / 111.0 / greatest(abs(cos(radians(lat))), 0.1) OR (lon >= 16.03 AND lon < 16.05 AND lat >= 48.03 AND lat < 48.05) AS inside
FROM (SELECT station, lat + 0.0003 AS lat, lon + 0.0003 AS lon FROM st)"""))
def scope_buffer(spark, sf_dir):
    box = [[[(16.03, 48.03), (16.05, 48.03), (16.05, 48.05), (16.03, 48.05)]]]
    return T.stations(spark, sf_dir).select("station", S.contains_stop(F.col("lat") + 0.0003, F.col("lon") + 0.0003, box, 1.5).alias("inside"))


@query("comparison_ratios", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 1 ELSE round(greatest(p_retailprice / (p_size % 5), (p_size % 5) / p_retailprice), 6) END AS ratio,
round(CASE WHEN abs(p_size / 10.0::DOUBLE - 2) <= 1 THEN 0.5 * power(p_size / 10.0::DOUBLE - 2, 2) ELSE abs(p_size / 10.0::DOUBLE - 2) - 0.5 END, 6) AS loss, round(greatest(least(p_size / 10.0::DOUBLE - 2, 1), -1), 6) AS gradient FROM part""")
def comparison_ratios(spark, sf_dir):
    error = F.col("p_size") / 10.0 - 2
    p = T.table(spark, sf_dir, "part").select("p_partkey", S.ratio(F.col("p_retailprice"), (F.col("p_size") % 5).cast("double")).alias("ratio"), S.huber_loss(error).alias("loss"), S.huber_gradient(error).alias("gradient"))
    return rounded(p, "ratio", "loss", "gradient")


@query("target_scales", """
SELECT p_partkey, round(p_size / 3600.0::DOUBLE, 9) AS third, round(p_retailprice, 6) AS back FROM part""")
def target_scales(spark, sf_dir):
    v = F.array(*[F.lit(1.0)] * 2, F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"), *[F.lit(0.5)] * 2)
    n = T.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(S.normalize_targets(v))).alias("n"))
    return n.select("p_partkey", F.round(F.get("n", F.lit(2)), 9).alias("third"), F.round(F.get(S.denormalize_targets(F.col("n")), F.lit(3)), 6).alias("back"))


@query("system_ids", "SELECT lower(trim(s_name)) || '|' || lower(trim(n_name)) AS system, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def system_ids(spark, sf_dir):
    s, n = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "nation")
    ids = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(S.network_system_id(F.concat(F.lit(" "), F.upper("s_name")), F.col("n_name")).alias("system"))
    return ids.groupBy("system").agg(F.count(F.lit(1)).alias("n"))


# --- joins, sets and orders


@query("line_overrides", """
SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'X1' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'U1' ELSE 'feed:' || o_orderstatus || ':' || o_orderpriority || ':3' END AS line,
CASE WHEN o_orderkey % 7 = 0 THEN 'Express' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Urgent' ELSE o_orderpriority END AS display, count(*) AS trips FROM orders GROUP BY 1, 2""")
def line_overrides(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").withColumn("route_id", F.concat_ws("/", "o_orderstatus", "o_orderpriority"))
    trips = o.select("route_id", F.lit("daily").alias("service_id"), F.col("o_orderkey").cast("string").alias("trip_id"), F.lit(None).cast("string").alias("direction_id"), F.when(F.col("o_orderkey") % 7 == 0, "shape-x").alias("shape_id"), F.col("o_orderkey").alias("row_no"))
    routes = o.select("route_id", F.col("o_orderstatus").alias("agency_id"), F.col("o_orderpriority").alias("route_short_name"), F.lit(None).cast("string").alias("route_long_name"), F.lit(None).cast("string").alias("route_type")).distinct()
    urgent = [r["route_id"] for r in routes.where("route_short_name IN ('1-URGENT', '2-HIGH')").select("route_id").collect()]  # a policy's rules, a few
    rules = spark.createDataFrame([("shape", "shape-x", "X1", "Express"), *(("route", r, "U1", "Urgent") for r in urgent)], "kind string, raw_id string, line string, display string")
    return G.lines_of(trips, routes, "feed", rules).groupBy("line", "display").agg(F.count(F.lit(1)).alias("trips"))


@query("parent_closure", """
WITH RECURSIVE s AS (SELECT 's' || s_suppkey AS stop_id, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
c AS (SELECT 's' || s_suppkey AS stop_id FROM supplier WHERE s_acctbal < 1000 UNION SELECT s.parent FROM c JOIN s USING (stop_id) WHERE s.parent IS NOT NULL) SELECT stop_id FROM c""")
def parent_closure(spark, sf_dir):
    s, n, r = (T.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    stops = s.select(named("s", "s_suppkey").alias("stop_id"), named("n", "s_nationkey").alias("parent_station")).unionByName(n.select(named("n", "n_nationkey").alias("stop_id"), named("r", "n_regionkey").alias("parent_station"))).unionByName(r.select(named("r", "r_regionkey").alias("stop_id"), F.lit(None).cast("string").alias("parent_station")))
    return ST.parent_closure(stops, s.where("s_acctbal < 1000").select(named("s", "s_suppkey").alias("stop_id")))


@query("line_end_to_end", with_sql(f"""
SELECT line, round(max({_HAVERSINE.format('x.lat', 'y.lat', 'x.lon', 'y.lon')}), 3) AS metres FROM (SELECT DISTINCT line, CAST(split_part(stops, ',', 1) AS INT) AS a, CAST(split_part(stops, ',', -1) AS INT) AS b FROM sig) p
JOIN st x ON x.station = a JOIN st y ON y.station = b GROUP BY line"""))
def line_end_to_end(spark, sf_dir):
    from linehaul.operators.graph import end_to_end

    return end_to_end(N.signatures(calls(spark, sf_dir)), T.stations(spark, sf_dir)).select("line", F.round("end_to_end", 3).alias("metres"))


@query("segment_edge_lookup", with_sql("""
SELECT w.line, w.a AS from_station, w.b AS to_station, coalesce(e.trips, 0) AS trips, CAST(coalesce(e.median, 0) AS INT) AS median_runtime FROM (SELECT DISTINCT line, b AS a, a AS b FROM seg) w LEFT JOIN edge e ON e.a = w.a AND e.b = w.b AND e.line = w.line"""))
def segment_edge_lookup(spark, sf_dir):
    edges = Scratch(spark, "lookup").table(N.transit_edges(N.segments(calls(spark, sf_dir))), "edges")
    back = edges.select("line", F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"))  # an edge has a row
    found = N.edge_lookup(back, edges, ["trips", "median_runtime"])
    return found.select("line", "from_station", "to_station", "trips", "median_runtime")


@query("query_grid", with_sql("SELECT station AS origin, departure FROM st CROSS JOIN (SELECT unnest([27000, 43200, 61200]) AS departure)"))
def query_grid(spark, sf_dir):
    from linehaul.operators.router import query_grid as grid

    return grid(T.stations(spark, sf_dir).select(F.col("station").alias("origin")), [27000, 43200, 61200]).select("origin", "departure")


@query("used_stop_ids", with_sql("SELECT station FROM tt UNION SELECT from_station FROM tf UNION SELECT to_station FROM tf"))
def used_stop_ids(spark, sf_dir):
    t = T.transfers(spark, sf_dir)
    return T.stop_times(spark, sf_dir).select("station").union(t.select("from_station")).union(t.select("to_station")).distinct()


@query("stop_time_order", """
SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 100 END NULLS LAST, event_id) AS INT) AS place FROM events""")
def stop_time_order(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    seq = F.when(F.col("event_id") % 6 == 0, "n/a").otherwise((F.col("event_id") % 100).cast("string"))
    order = Window.partitionBy("user_id").orderBy(seq.try_cast("int").asc_nulls_last(), "event_id")
    return e.select("event_id", "user_id", F.row_number().over(order).alias("place"))


@query("evenly_spaced_origins", """
WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT DISTINCT s_suppkey FROM p WHERE i IN (SELECT k * (SELECT max(n) FROM p) // 7 FROM (SELECT unnest(range(7)) AS k))""")
def evenly_spaced_origins(spark, sf_dir):
    return SA.evenly_spaced(T.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], 7).select("s_suppkey")


_SEED = 7
_U64 = 1 << 64


def _key_sql(seed: int) -> str:
    """The seeded key of a place (a, b, d) in 128-bit numbers, cut to 64 bits."""
    cut = lambda x: f"(({x}) % {_U64}::UHUGEINT)"
    turned = lambda x, n: f"({cut(f'{x} * {1 << n}::UHUGEINT')} + ({x} // {1 << (64 - n)}::UHUGEINT))"
    mixed = lambda x, n, f: cut(f"xor({x}, {x} // {1 << n}::UHUGEINT) * {f}::UHUGEINT")
    return f"""(SELECT xor(z, z // {1 << 31}::UHUGEINT) FROM (SELECT {mixed('y', 27, 0x94D049BB133111EB)} AS z FROM (SELECT {mixed('x', 30, 0xBF58476D1CE4E5B9)} AS y FROM (
    SELECT xor(xor({seed}::UHUGEINT, {cut(f'a * {0x9E3779B97F4A7C15}::UHUGEINT')}), xor({turned('b', 17)}, {turned('d', 31)})) AS x))))"""


def _origins_sql(most: int, geographic: float = 0.5, hubs: float = 0.25) -> str:
    n = math.floor(most * geographic + 0.5)
    m = min(math.floor(most * hubs + 0.5), most - n)
    gap = lambda k: f"pow(radians(c.lat - p{k}.lat), 2) + pow(radians(c.lon - p{k}.lon) * cos(radians(c.lat + p{k}.lat) / 2), 2)"
    picks = "p0 AS (SELECT * FROM c ORDER BY start, a, b, d, id LIMIT 1)"
    for k in range(1, n):
        before = ", ".join(f"p{j}" for j in range(k))
        least = f"least({', '.join(gap(j) for j in range(k))})"
        picks += f",\np{k} AS (SELECT c.* FROM c, {before} WHERE {' AND '.join(f'c.id <> p{j}.id' for j in range(k))} ORDER BY {least} DESC, c.a, c.b, c.d, c.id LIMIT 1)"
    parts = " UNION ALL ".join([*(f"SELECT id, 0 AS part, {k} AS k FROM p{k}" for k in range(n)), f"SELECT * FROM (SELECT id, 1 AS part, row_number() OVER (ORDER BY d DESC, a, b, id) AS k FROM c) WHERE k <= {m}", f"SELECT * FROM (SELECT id, 2 AS part, row_number() OVER (ORDER BY draw, a, b, d, id) AS k FROM c) WHERE k <= {most - n - m}", "SELECT id, 3 AS part, row_number() OVER (ORDER BY a, b, d, id) AS k FROM c"])
    return f"""
g AS (SELECT s.station AS id, lat, lon, CAST(round(lat * 1e6) AS UHUGEINT) AS a, CAST(round(lon * 1e6) AS UHUGEINT) AS b, CAST(coalesce(n, 0) AS UHUGEINT) AS d FROM st s LEFT JOIN (
  SELECT from_station AS station, count(DISTINCT to_station) AS n FROM (SELECT from_station, to_station FROM tf UNION ALL SELECT to_station, from_station FROM tf) GROUP BY 1) t ON t.station = s.station),
c AS MATERIALIZED (SELECT *, {_key_sql(_SEED ^ 0x9E3779B97F4A7C15)} AS start, {_key_sql(_SEED)} AS draw FROM g),
{picks}
SELECT CAST(id AS BIGINT) AS id, CAST(row_number() OVER (ORDER BY part, k) AS INT) AS rank FROM (SELECT id, min((part, k))[1] AS part, min((part, k))[2] AS k FROM ({parts}) GROUP BY id) ORDER BY part, k LIMIT {most}"""


@query("sampled_origins", with_sql("SELECT 1").replace("\nSELECT 1", "," + _origins_sql(10)))
def sampled_origins(spark, sf_dir):
    s = T.stations(spark, sf_dir).select(F.col("station").cast("long").alias("id"), "lat", "lon").join(N.transfer_degree(T.transfers(spark, sf_dir)).select(F.col("station").cast("long").alias("id"), "degree"), "id", "left")
    return SA.sample_origins(s.na.fill(0, ["degree"]), 10)


@query("hub_ranking", with_sql("SELECT line, CAST(row_number() OVER (ORDER BY count(DISTINCT station) DESC, line) AS INT) AS rank FROM calls GROUP BY line"))
def hub_ranking(spark, sf_dir):
    lines = calls(spark, sf_dir).groupBy("line").agg(F.countDistinct("station").alias("n"))
    from linehaul.operators.numbering import numbered

    return numbered(lines, [F.desc("n"), "line"], "rank", Scratch(spark, "rank")).select("line", (F.col("rank") + 1).cast("int").alias("rank"))


@query("nearest_rank_percentiles", """
SELECT event_type, list_sort(list(value))[CAST(ceil(count(*) * 0.5) AS BIGINT)] AS p50, list_sort(list(value))[CAST(ceil(count(*) * 0.95) AS BIGINT)] AS p95 FROM events GROUP BY 1""")
def nearest_rank_percentiles(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    return N.nearest_rank(e, ["event_type"], "value", 0.5, "p50").join(N.nearest_rank(e, ["event_type"], "value", 0.95, "p95"), "event_type")


@query("coordinate_box", with_sql("SELECT station, round((lat - min(lat) OVER ()) / (max(lat) OVER () - min(lat) OVER ()), 6) AS y, round((lon - min(lon) OVER ()) / (max(lon) OVER () - min(lon) OVER ()), 6) AS x FROM st"))
def coordinate_box(spark, sf_dir):
    from linehaul.operators.graph import normalized_coordinates

    return rounded(normalized_coordinates(T.stations(spark, sf_dir)).select("station", "y", "x"), "y", "x")


@query("vector_pools", """
SELECT label, CAST(pos AS INT) AS pos, round(avg(x), 6) AS mean, round(greatest(max(x), 0), 6) AS most FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2""")
def vector_pools(spark, sf_dir):
    return rounded(R.pooled(T.table(spark, sf_dir, "embeddings"), ["label"], "embedding"), "mean", "most")


@query("line_sequence_bins", with_sql("""
SELECT line, CAST(least(pos * 16 // greatest(n - 1, 1), 15) AS INT) AS bin, round(avg(y.lat - x.lat), 9) AS dlat, round(avg(y.lon - x.lon), 9) AS dlon FROM seg JOIN st x ON x.station = a JOIN st y ON y.station = b GROUP BY 1, 2"""))
def line_sequence_bins(spark, sf_dir):
    s, st = N.segments(calls(spark, sf_dir)), T.stations(spark, sf_dir)
    side = lambda n, c: st.select(F.col("station").alias(c), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
    both = s.join(side(1, "from_station"), "from_station").join(side(2, "to_station"), "to_station")
    moved = both.select("line", "pos", (F.col("calls") - 1).alias("size"), (F.col("lat2") - F.col("lat1")).alias("dlat"), (F.col("lon2") - F.col("lon1")).alias("dlon"))
    out = R.sequence_bins(moved, ["line"], "pos", "size", ["dlat", "dlon"])
    return out.select("line", "bin", F.round("dlat", 9).alias("dlat"), F.round("dlon", 9).alias("dlon"))


# --- catalogue


@query("training_examples", f"""
WITH {_RANKED}, l AS (SELECT snapshot, line, CASE WHEN line % 11 <> 0 THEN target END AS target FROM x WHERE line % 3 <> 1)
SELECT x.snapshot, x.line, l.target, round(1.0::DOUBLE / count(*) OVER (PARTITION BY x.snapshot), 9) AS weight FROM x JOIN l ON x.snapshot = l.snapshot AND x.line = l.line WHERE l.target IS NOT NULL""")
def training_examples(spark, sf_dir):
    x = ranked(spark, sf_dir)
    labels = x.where("line % 3 <> 1").select("snapshot", "line", F.when(F.col("line") % 11 == 0, float("nan")).otherwise(F.col("target")).alias("target"))
    return C.training_examples(x.select("snapshot", "line"), labels, ["target"]).select("snapshot", "line", "target", F.round("weight", 9).alias("weight"))


@query("first_matching_report", """
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey AND r = 1""")
def first_matching_report(spark, sf_dir):
    reports = T.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return C.first_match(T.table(spark, sf_dir, "customer").select("c_custkey"), reports, ["c_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("predictions_of_lines", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 10")
def predictions_of_lines(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").where("l_quantity >= 10").join(T.table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("runs_with_attempts", """
SELECT c_custkey, count(o_orderkey) AS attempts, count(o_orderkey) FILTER (o_orderstatus = 'O') AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def runs_with_attempts(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("attempts"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open"))
    return T.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0)


@query("metric_maps", """
SELECT user_id, v AS value, n AS metric FROM (SELECT user_id, event_type AS n, max(value) AS v FROM events GROUP BY 1, 2)""")
def metric_maps(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    lists = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "value"))).alias("l"))  # a metric for each of a few types
    maps = lists.select("user_id", C.zipped(F.transform("l", lambda x: x["event_type"]), F.transform("l", lambda x: x["value"])).alias("m"))
    return maps.select("user_id", F.explode("m").alias("metric", "value"))


@query("overview", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def overview(spark, sf_dir):
    return T.table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(8).select("event_id", "user_id", "event_type")


WINDOWS = (SC.Weekly((1, 2, 3, 4, 5), 22 * 60, 6 * 60, "Europe/Vienna"), SC.Weekly((6, 7), 9 * 60 + 30, 17 * 60, "America/New_York"))


@query("schedule_windows", """
WITH l AS (SELECT event_id, ts, timezone('Europe/Vienna', timezone('UTC', ts)) AS v, timezone('America/New_York', timezone('UTC', ts)) AS n FROM events)
SELECT event_id, (isodow(v) BETWEEN 1 AND 5 AND hour(v) >= 22) OR (isodow(v - INTERVAL 1 DAY) BETWEEN 1 AND 5 AND hour(v) < 6) OR (isodow(n) IN (6, 7) AND hour(n) * 60 + minute(n) >= 570 AND hour(n) < 17) AS allowed FROM l""")
def schedule_windows(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", SC.allowed(F.col("ts"), WINDOWS).alias("allowed"))


# --- feeds, files and logs, written and read back


def _feed(spark, sf_dir):
    return G.read_feed(spark, T.write_feed(spark, sf_dir, Scratch(spark, "feed").path("gtfs")))


_FEED = """SELECT 'stops' AS name, count(*) AS n FROM nation UNION ALL SELECT 'routes', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'trips', count(*) FROM orders
UNION ALL SELECT 'stop_times', count(*) FROM tt UNION ALL SELECT 'calendar', 1 UNION ALL SELECT 'calendar_dates', 0 UNION ALL SELECT 'transfers', count(*) FROM tf UNION ALL SELECT 'pathways', 0"""


@query("feed_tables", with_sql(_FEED))
def feed_tables(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    return spark.createDataFrame([(name, df.count()) for name, df in feed.tables.items()], "name string, n long")


@query("feed_stop_times", with_sql("SELECT CAST(trip_id AS VARCHAR) AS trip_id, 'n' || lpad(CAST(station AS VARCHAR), 2, '0') AS stop_id, arrival, departure, seq, pickup, drop_off FROM tt"))
def feed_stop_times(spark, sf_dir):
    return G.typed_stop_times(_feed(spark, sf_dir).stop_times).drop("row_no")


@query("feed_issues", with_sql("SELECT 'trip without route' AS issue, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'stop time without stop', count(*) FROM tt WHERE station < 5 UNION ALL SELECT 'duplicate stop_id', count(*) FROM nation WHERE n_nationkey >= 20"))
def feed_issues(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    broken = G.Feed(feed.tables | {"routes": feed.routes.where("route_id <> '5-LOW'"), "stops": feed.stops.where("stop_id >= 'n05'").unionByName(feed.stops.where("stop_id >= 'n20'"))})
    return commands.validate(broken).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("compiled_edges", with_sql("SELECT 'n' || lpad(CAST(a AS VARCHAR), 2, '0') AS origin, 'n' || lpad(CAST(b AS VARCHAR), 2, '0') AS destination, 'f::' || line || ':3' AS line, trips, least AS min_runtime, median AS median_runtime FROM edge"))
def compiled_edges(spark, sf_dir):
    net = commands.compile_network(_feed(spark, sf_dir), datetime.date(1996, 6, 3), "f")
    name = lambda c: net["stations"].select(F.col("station").alias(c), F.col("canonical_id").alias(f"{c}_id"))
    e = net["edges"].join(name("from_station"), "from_station").join(name("to_station"), "to_station")
    return e.select(F.col("from_station_id").alias("origin"), F.col("to_station_id").alias("destination"), "line", "trips", "min_runtime", "median_runtime")


@query("line_search", with_sql("SELECT DISTINCT 'f::' || o_orderpriority || ':3' AS line FROM orders WHERE lower(o_orderpriority) LIKE '%-h%' OR lower(o_orderpriority) LIKE '%h%'"))
def line_search(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    lines = G.lines_of(feed.trips, feed.routes, "f").select("line", "display").distinct()
    return commands.find_lines(lines, "H").select("line")


@query("snapshot_round_trip", with_sql("SELECT station, lat, lon, name, zone FROM st"))
def snapshot_round_trip(spark, sf_dir):
    root = Scratch(spark, "snapshots").path("store")
    tables = {"stations": T.stations(spark, sf_dir), "transfers": T.transfers(spark, sf_dir)}
    key = A.save_snapshot(tables, root, {"feed": "orders", "day": "1996-06-03"})
    assert A.save_snapshot(tables, root, {"day": "1996-06-03", "feed": "orders"}) == key  # the same snapshot is not written again
    return A.load_snapshot(spark, root, key)["stations"]


@query("dataset_split", "SELECT c_custkey, 'nation-' || c_nationkey AS system FROM customer WHERE c_nationkey % 5 = 3")
def dataset_split(spark, sf_dir):
    split = F.when(F.col("c_nationkey") % 5 == 3, "validation").when(F.col("c_nationkey") % 5 == 4, "test").otherwise("train")
    rows = T.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("system"), split.alias("split"))
    path = Scratch(spark, "datasets").path("dataset")
    A.save_dataset(rows, path)
    return A.load_split(spark, path, "validation").select("c_custkey", "system")


@query("label_lines", "SELECT p_brand AS snapshot, p_partkey AS line, p_retailprice AS loss FROM part")
def label_lines(spark, sf_dir):
    path = Scratch(spark, "labels").path("labels")
    rows = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("snapshot"), F.col("p_partkey").alias("line"), F.col("p_retailprice").alias("loss"), F.lit("r1").alias("router_algorithm_version"), F.lit("p1").alias("policy_fingerprint"))
    rows.write.json(path)
    return A.load_labels(spark, path, rows.schema, "r1").select("snapshot", "line", "loss")


_TEXT = "n_nationkey || ' ' || n_name || ' ' || n_regionkey || chr(10)"


@query("manifest_differences", f"""
WITH f AS (SELECT n_nationkey AS k, {_TEXT} AS body FROM nation),
m AS (SELECT k, length(body) AS bytes, CASE WHEN k % 5 = 1 THEN 'stale' ELSE sha256(body) END AS sha FROM f WHERE k % 7 <> 3 UNION ALL SELECT k + 100, length(body), sha256(body) FROM f WHERE k % 9 = 0)
SELECT CAST(coalesce(f.k, m.k) AS INT) AS file, CAST(m.bytes AS BIGINT) AS bytes, m.sha AS expected, sha256(f.body) AS found FROM f FULL JOIN m ON f.k = m.k WHERE f.k IS NULL OR m.k IS NULL OR m.sha <> sha256(f.body)""")
def manifest_differences(spark, sf_dir):
    """A file for each nation; the manifest lacks some, has stale digests of some and names some that are not there."""
    path = Scratch(spark, "files").path("files")
    rows = T.table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(" ", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    key = F.regexp_extract("path", r"n_nationkey=(\d+)/", 1)
    found = A.file_digests(spark, path).where(key != "").select(key.alias("path"), "bytes", "sha256")
    line = F.concat("value", F.lit("\n"))  # as the text writer ends a row
    own = rows.select(F.col("n_nationkey").alias("k"), F.octet_length(line).cast("long").alias("bytes"), F.sha2(line, 256).alias("sha256"))
    stale = F.when(F.col("k") % 5 == 1, "stale").otherwise(F.col("sha256")).alias("sha256")
    manifest = own.where("k % 7 <> 3").select(F.col("k").cast("string").alias("path"), "bytes", stale)
    manifest = manifest.unionByName(own.where("k % 9 = 0").select((F.col("k") + 100).cast("string").alias("path"), "bytes", "sha256"))
    return A.differences(manifest, found).select(F.col("path").cast("int").alias("file"), "bytes", F.col("sha256").alias("expected"), "found")


def _log(spark, sf_dir):
    """Events as run events: a user is a run; some come twice."""
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("type"), F.col("props").alias("payload"))
    return e, e.where("seq % 10 = 0").withColumn("payload", F.when(F.col("seq") % 20 == 0, "changed").otherwise(F.col("payload")))


@query("log_import", "SELECT CAST(user_id AS VARCHAR) AS run, count(*) AS n, max(event_id) AS seq FROM events GROUP BY 1")
def log_import(spark, sf_dir):
    first, again = _log(spark, sf_dir)
    scratch = Scratch(spark, "log")
    folder, target, cursor = scratch.path("in"), scratch.path("log"), scratch.path("cursor")
    for part in (first, again):  # the second delivery repeats a tenth of the first
        part.write.mode("append").json(folder)
        E.import_log(E.read_events(spark, folder), target, cursor).awaitTermination()
    return spark.read.schema(E.EVENT).parquet(target).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))


@query("log_conflicts", "SELECT CAST(user_id AS VARCHAR) AS run, event_id AS seq FROM events WHERE event_id % 20 = 0")
def log_conflicts(spark, sf_dir):
    first, again = _log(spark, sf_dir)
    return E.conflicts(first.unionByName(again)).select("run", "seq")


@query("log_replay", "SELECT event_id AS seq, event_type AS type FROM events WHERE user_id = 8 AND event_id > 500")
def log_replay(spark, sf_dir):
    return E.replay(_log(spark, sf_dir)[0], "8", 500).select("seq", "type")


@query("numbered_events", """
SELECT CAST(user_id AS VARCHAR) AS run, CAST(event_id AS VARCHAR) AS event, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, ts, CAST(event_id AS VARCHAR)) - 1 AS BIGINT) AS seq FROM events""")
def numbered_events(spark, sf_dir):
    """Three deliveries, the second with all of the first once more."""
    rows = T.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").cast("string").alias("event"), "ts", F.col("event_type").alias("type"), F.col("props").alias("payload"))
    scratch = Scratch(spark, "append")
    folder, target, cursor = scratch.path("in"), scratch.path("log"), scratch.path("cursor")
    for part in ("event % 3 = 0", "event % 3 < 2", "event % 3 = 2"):
        rows.where(part).write.mode("append").json(folder)
        E.append_numbered(spark.readStream.schema(E.ARRIVING).json(folder), target, cursor).awaitTermination()
    return E.numbered_events(spark, target).select("run", "event", "seq")
