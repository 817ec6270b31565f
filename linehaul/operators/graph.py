"""Feature rows of the network's graph: stations, lines, edges, transfers, serves edges and pattern offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.operators import network as N
from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch

#: Fixed orders of the features: a place in a row is part of the format.
STATION_FEATURES = ("x", "y", "platform_count", "line_count", "pattern_count", "mode_0", "mode_1", "mode_2", "mode_3", "mode_4", "first_departure", "last_departure", "daily_departures", "daily_arrivals", "transfer_degree", "terminal")
LINE_FEATURES = ("mode_0", "mode_1", "mode_2", "mode_3", "mode_4", "station_count", "pattern_count", "route_length_metres", "end_to_end_distance_metres", "branching_factor", "service_span_seconds", "daily_trip_count_log1p", "median_headway_seconds", "peak_headway_seconds", "off_peak_headway_seconds", "transfer_station_count", "unique_station_fraction", "shared_segment_fraction")


def _float(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("double")


def _log(c) -> Column:
    return F.log1p(_float(c))


def serves(calls: DataFrame) -> DataFrame:
    """Distinct (station, line)."""
    return calls.select("station", "line").distinct()


def station_features(stations: DataFrame, calls: DataFrame, pats: DataFrame, modes: DataFrame, transfers: DataFrame, platforms: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(station, features) in the order of ``STATION_FEATURES``. ``modes``: line, bucket. ``platforms``: station, platform_count.

    ``pats`` has the trips' signatures; ``counted``: a row for each of them, where they are there already.
    """
    placed = S.placed(F.col("lat"), F.col("lon")) & ~F.isnan("lat") & ~F.isnan("lon")
    box = stations.where(placed).agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    unit = lambda c: F.when(placed, F.least(F.greatest((F.col(c) - F.col(f"min_{c}")) / F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(2.0**-52)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    each = pats.select(*N.SIGNATURE).distinct() if counted is None else counted
    of_mode = serves(calls).join(modes, "line").groupBy("station").agg(*[F.count(F.when(F.col("bucket") == k, 1)).alias(f"mode_{k}") for k in range(5)])
    of_pattern = each.select(F.explode(F.array_distinct(F.split("stops", ","))).alias("station")).groupBy(F.col("station").cast("int").alias("station")).agg(F.count(F.lit(1)).alias("pattern_count"))
    ends = each.select(F.explode(F.array(F.element_at(F.split("stops", ","), 1), F.element_at(F.split("stops", ","), -1))).alias("station")).select(F.col("station").cast("int").alias("station")).distinct().withColumn("terminal", F.lit(1))
    # the box is one row
    rows = stations.crossJoin(F.broadcast(box))
    for part in (platforms, N.station_summary(calls), of_mode, of_pattern, N.transfer_degree(transfers), ends):
        rows = rows.join(part, "station", "left")
    values = [unit("lon"), unit("lat"), _float("platform_count"), _float("lines"), _float("pattern_count"), *[_float(f"mode_{k}") for k in range(5)], S.normalized_time(F.col("first_departure")), S.normalized_time(F.col("last_departure")), _log("daily_calls"), _log("daily_calls"), _float("degree"), _float("terminal")]
    return rows.select("station", F.array(*values).alias("features"))


def line_features(lines: DataFrame) -> DataFrame:
    """(line, features) in the order of ``LINE_FEATURES`` from a row per line with its bucket and statistics."""
    values = [*[F.when(F.col("bucket") == k, 1.0).otherwise(0.0) for k in range(5)], _log("stations"), _log("patterns"), _float("metres") / 10_000, _float("end_to_end") / 10_000, _float("branching"), _float("span") / (32 * 3600.0), _log("trips"), _float("headway") / 3600, _float("peak_headway") / 3600, _float("offpeak_headway") / 3600, _log("transfer_stations"), _float("unique_fraction"), _float("shared_fraction")]
    return lines.select("line", F.array(*values).alias("features"))


def end_to_end(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Per line the largest distance between the ends of a pattern; ``trips`` have signatures."""
    metres = S.station_distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    ends = trips.select("line", F.split("stops", ",").alias("s")).select("line", F.element_at("s", 1).cast("int").alias("from_station"), F.element_at("s", -1).cast("int").alias("to_station")).distinct()
    a = stations.select(F.col("station").alias("from_station"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = stations.select(F.col("station").alias("to_station"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return ends.join(a, "from_station").join(b, "to_station").groupBy("line").agg(F.coalesce(F.max(metres), F.lit(0.0)).alias("end_to_end"))


def normalized_coordinates(stations: DataFrame) -> DataFrame:
    """x and y of all stations between the smallest and the largest, 0 where these are the same."""
    box = stations.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    unit = lambda c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), (F.col(c) - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}"))).otherwise(0.0)
    # the box is one row
    return stations.crossJoin(F.broadcast(box)).withColumns({"x": unit("lon"), "y": unit("lat")})


def line_statistics(calls: DataFrame, stations: DataFrame, modes: DataFrame, trips: DataFrame | None = None, counted: DataFrame | None = None, edges: DataFrame | None = None, served: DataFrame | None = None) -> DataFrame:
    """All per-line statistics that features need, one row per line.

    Given where they are there already: signatures of ``trips``, their patterns ``counted``, ``edges`` and (station, line) ``served``.
    """
    pats = N.signatures(calls) if trips is None else trips
    each = pats.select(*N.SIGNATURE).distinct() if counted is None else counted
    segs, served = N.segments(calls) if edges is None else edges, calls if served is None else served
    metres = S.station_distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    reach = end_to_end(each, stations)
    rows = N.line_summary(calls, pats, counted)
    for part in (modes, N.line_lengths(segs, stations, metres), reach, N.pattern_branching(each), N.line_headways(pats), N.line_stations(served).drop("stations"), N.line_sharing(segs)):
        rows = rows.join(part, "line", "left")
    return rows


def edge_features(edges: DataFrame, positions: DataFrame, stations: DataFrame) -> DataFrame:
    """Per edge: distance, median and minimum runtime, log trips, relative position, sine and cosine of the bearing."""
    a = stations.select(F.col("station").alias("from_station"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = stations.select(F.col("station").alias("to_station"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rows = edges.join(positions, N.EDGE).join(a, "from_station").join(b, "to_station")
    where = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    bearing = S.bearing_radians(*where)
    values = [_float(S.station_distance(*where)) / 10_000, _float("median_runtime") / 3600, _float("min_runtime") / 3600, _log("trips"), _float("relative_position"), F.sin(bearing), F.cos(bearing)]
    return rows.select(*N.EDGE, F.array(*values).alias("features"))


def transfer_features(transfers: DataFrame) -> DataFrame:
    """Per transfer: time, walking distance, explicit, confidence, same physical station."""
    values = [_float("seconds") / 3600, _float("metres") / 1000, _float("explicit"), _float("confidence"), _float("same_station")]
    return transfers.select("from_station", "to_station", F.array(*values).alias("features"))


def temporal(calls: DataFrame, key: str) -> DataFrame:
    """Per key and quarter-hour: departures, arrivals, distinct partners (lines of a station, stations of a line) and trips."""
    other = "line" if key == "station" else "station"
    departures = calls.withColumn("bin", S.service_day_bin(F.col("departure"))).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("departures"), F.countDistinct(other).alias("partners"), F.countDistinct("trip_id").alias("trips"))
    arrivals = calls.withColumn("bin", S.service_day_bin(F.col("arrival"))).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("arrivals"))
    return departures.join(arrivals, [key, "bin"], "full").na.fill(0)


def offsets(counts: DataFrame, key: str, size: str, scratch: Scratch | None = None) -> DataFrame:
    """Start of each key's run in the order of keys."""
    scratch = scratch or Scratch(counts.sparkSession, "offsets")
    return numbered(counts.select(key, size), [key], "_place", scratch, {"start": size}).select(key, size, F.col("start").cast("long").alias("start"))
