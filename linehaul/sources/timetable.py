"""A timetable derived from the order tables: an order is a trip, its priority a line, the suppliers' nations its stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Items that a task puts in order and merges, with all that is done per trip after it; fewer than that are left to Spark.
ITEMS_AT_ONCE = 300_000
#: Suppliers that every executor may hold (two numbers each); more are dealt by their key, in as many tasks as the trips.
SUPPLIERS_HELD = 1_000_000


def stop_times(spark: SparkSession, sf_dir: str, at_once: int = ITEMS_AT_ONCE, held: int = SUPPLIERS_HELD) -> DataFrame:
    """trip_id, line, station, seq, arrival, departure (seconds), pickup and drop_off codes.

    Rows are dealt by trip to as many tasks as the items fill, whatever the number of shuffle partitions is, and so they
    are by supplier where these are more than ``held``.
    """
    item, supplier, orders = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders"))
    rows = item.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    places, lines = supplier.select("s_suppkey", "s_nationkey"), orders.select("o_orderkey", "o_orderpriority")
    tasks = -(-item.count() // at_once)
    if tasks > 1:
        tasks = max(tasks, spark.sparkContext.defaultParallelism)
        if supplier.count() <= held:
            places = F.broadcast(places)
        else:
            rows, places = rows.repartition(tasks, "l_suppkey"), places.repartition(tasks, "s_suppkey")
    rows = rows.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    if tasks > 1:
        rows, lines = rows.repartition(tasks, "l_orderkey"), lines.repartition(tasks, "o_orderkey")
    rows = rows.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    along = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.select(F.col("l_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("line"), F.col("s_nationkey").cast("int").alias("station"), F.row_number().over(along).cast("int").alias("seq"), "l_returnflag")
    arrival = (18000 + (F.col("trip_id") * 97) % 64800 + F.col("seq") * 300).cast("int")
    return rows.select("trip_id", "line", "station", "seq", arrival.alias("arrival"), (arrival + 30).cast("int").alias("departure"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("pickup"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("drop_off"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    lat = F.lit(48.0) + ((F.col("n_nationkey") * 37) % 100) / 1000.0
    lon = F.lit(16.0) + ((F.col("n_nationkey") * 53) % 100) / 1000.0
    return n.select(F.col("n_nationkey").cast("int").alias("station"), lat.alias("lat"), lon.alias("lon"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("zone"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks between stations of one zone whose numbers differ by at most ten."""
    a = stations(spark, sf_dir).select(F.col("station").alias("from_station"), "zone")
    b = a.select(F.col("from_station").alias("to_station"), "zone")
    gap = F.abs(F.col("from_station") - F.col("to_station"))
    return a.join(b, "zone").where((gap > 0) & (gap <= 10)).select("from_station", "to_station", (60 * (1 + gap)).cast("int").alias("seconds"))


def write_feed(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The timetable as the tables of a GTFS feed, comma-separated text in ``folder``."""
    from linehaul.functions.scalars import clock_text

    t, st = stop_times(spark, sf_dir), stations(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    stop = lambda c: F.concat(F.lit("n"), F.lpad(text(c), 2, "0"))
    trips = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("route_id"), F.lit("daily").alias("service_id"), text("o_orderkey").alias("trip_id"))
    tables = {
        "stops": st.select(stop("station").alias("stop_id"), F.col("name").alias("stop_name"), text("lat").alias("stop_lat"), text("lon").alias("stop_lon")),
        "routes": trips.select("route_id", F.col("route_id").alias("route_short_name"), F.lit("3").alias("route_type")).distinct(),
        "trips": trips,
        "stop_times": t.select(text("trip_id").alias("trip_id"), clock_text(F.col("arrival")).alias("arrival_time"), clock_text(F.col("departure")).alias("departure_time"), stop("station").alias("stop_id"), text("seq").alias("stop_sequence"), text("pickup").alias("pickup_type"), text("drop_off").alias("drop_off_type")),
        "calendar": spark.createDataFrame([("daily", *"1111111", "19900101", "20301231")], "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string"),
        "transfers": transfers(spark, sf_dir).select(stop("from_station").alias("from_stop_id"), stop("to_station").alias("to_stop_id"), F.lit("2").alias("transfer_type"), text("seconds").alias("min_transfer_time")),
    }
    for name, df in tables.items():
        df.write.csv(f"{folder}/{name}.txt", header=True)
    return folder


#: The same views in SQL, for the checks.
SQL = """
tt AS (SELECT *, CAST(18000 + (trip_id * 97) % 64800 + seq * 300 AS INT) AS arrival,
              CAST(18000 + (trip_id * 97) % 64800 + seq * 300 + 30 AS INT) AS departure
       FROM (SELECT l_orderkey AS trip_id, o_orderpriority AS line, CAST(s_nationkey AS INT) AS station,
                    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS INT) AS seq,
                    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS pickup, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS drop_off
             FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey)),
st AS (SELECT CAST(n_nationkey AS INT) AS station, 48 + ((n_nationkey * 37) % 100) / CAST(1000 AS DOUBLE) AS lat,
              16 + ((n_nationkey * 53) % 100) / CAST(1000 AS DOUBLE) AS lon, n_name AS name, CAST(n_regionkey AS INT) AS zone FROM nation),
tf AS (SELECT a.station AS from_station, b.station AS to_station, CAST(60 * (1 + abs(a.station - b.station)) AS INT) AS seconds
       FROM st a JOIN st b ON a.zone = b.zone AND abs(a.station - b.station) BETWEEN 1 AND 10),
isl AS (SELECT *, sum(new) OVER (PARTITION BY trip_id ORDER BY seq) AS k FROM
        (SELECT *, CASE WHEN lag(station) OVER (PARTITION BY trip_id ORDER BY seq) = station THEN 0 ELSE 1 END AS new FROM tt)),
mg AS (SELECT trip_id, line, station, CAST(k - 1 AS INT) AS pos, min(arrival) AS arrival, max(departure) AS departure, min(pickup) AS pickup, min(drop_off) AS drop_off
       FROM isl GROUP BY trip_id, line, station, k),
calls AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY trip_id) AS n FROM mg) WHERE n >= 2),
sig AS (SELECT trip_id, line, string_agg(station, ',' ORDER BY pos) AS stops, string_agg(pickup, ',' ORDER BY pos) AS pu, string_agg(drop_off, ',' ORDER BY pos) AS dr,
               min(departure) FILTER (pos = 0) AS first_departure, max(n) AS n FROM calls GROUP BY trip_id, line),
pat AS (SELECT *, CAST(dense_rank() OVER (ORDER BY line, stops, pu, dr) - 1 AS INT) AS pattern FROM sig),
seg AS (SELECT * FROM (SELECT trip_id, line, pos, station AS a, departure AS dep, lead(station) OVER w AS b, lead(arrival) OVER w AS arr, n
        FROM calls WINDOW w AS (PARTITION BY trip_id ORDER BY pos)) WHERE b IS NOT NULL AND a <> b AND arr >= dep),
edge AS (SELECT a, b, line, count(*) AS trips, min(arr - dep) AS least, list_sort(list(arr - dep))[count(*) // 2 + 1] AS median FROM seg GROUP BY a, b, line)
"""


def with_sql(query: str) -> str:
    """A checking query over the views above."""
    return f"WITH RECURSIVE {SQL.strip()}\n{query.strip()}"
