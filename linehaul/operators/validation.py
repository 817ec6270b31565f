"""Whether a compiled network fits together: numbering, references between its tables, patterns and the times of their trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linehaul.functions.scalars import BINS

ISSUE = ["entity", "key", "issue"]
#: Columns that point into other tables: table, column, the table it points into.
REFERENCES = (
    ("patterns", "line", "lines"), ("calls", "line", "lines"), ("calls", "station", "stations"), ("edges", "from_station", "stations"), ("edges", "to_station", "stations"), ("edges", "line", "lines"),
    ("transfers", "from_station", "stations"), ("transfers", "to_station", "stations"), ("interchanges", "line", "lines"), ("interchanges", "other", "lines"), ("stop_to_station", "station", "stations"),
)


def _issues(df: DataFrame, entity: str, key, issue: str) -> DataFrame:
    return df.select(F.lit(entity).alias("entity"), key.cast("string").alias("key"), F.lit(issue).alias("issue"))


def contiguous(df: DataFrame, entity: str, index: str) -> DataFrame:
    """Issues of a numbering that should be 0, 1, ... once each: numbers that come twice and numbers out of range.

    With neither, n distinct numbers below n are all of them, so no order is needed.
    """
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    twice = df.groupBy(index).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    # the count is one row
    outside = df.crossJoin(F.broadcast(n)).where(F.col(index).isNull() | (F.col(index) < 0) | (F.col(index) >= F.col("_n")))
    return _issues(twice, entity, F.col(index), "number comes twice").unionByName(_issues(outside, entity, F.col(index), "number is not contiguous"))


def dangling(rows: DataFrame, entity: str, column: str, known: DataFrame, name: str) -> DataFrame:
    """Distinct values of ``column`` that ``known`` lacks; nulls are dangling too."""
    values = rows.select(F.col(column).alias("_v")).distinct()
    return _issues(values.join(known.select(F.col(name).alias("_k")).distinct(), F.col("_v") == F.col("_k"), "left_anti"), entity, F.concat_ws(" ", F.lit(column), F.coalesce(F.col("_v").cast("string"), F.lit("null"))), "points to nothing")


def trip_issues(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """Issues of trips: fewer calls or more than their pattern has stops, patterns of one stop, times that run backwards.

    ``patterns`` (trip_id, pattern, stops as text). A trip's calls are put in order within the trip.
    """
    stops = F.size(F.split("stops", ","))
    counted = calls.groupBy("trip_id").agg(F.count(F.lit(1)).alias("_calls"), F.countDistinct("pos").alias("_places"), F.max("pos").alias("_last"))
    both = patterns.select("trip_id", "pattern", stops.alias("_stops")).join(counted, "trip_id", "full")
    out = _issues(both.where("_stops IS NULL"), "trip", F.col("trip_id"), "has no pattern")
    wrong = (F.col("_calls") != F.col("_stops")) | (F.col("_places") != F.col("_calls")) | (F.col("_last") != F.col("_calls") - 1)
    out = out.unionByName(_issues(both.where(F.col("_stops").isNotNull() & (F.col("_calls").isNull() | wrong)), "trip", F.col("trip_id"), "does not have a call for each stop"))
    out = out.unionByName(_issues(both.where("_stops < 2").select("pattern").distinct(), "pattern", F.col("pattern"), "has fewer than two stops"))
    before = F.lag("departure").over(Window.partitionBy("trip_id").orderBy("pos"))
    timed = calls.select("trip_id", "pos", "arrival", "departure", before.alias("_before"))
    at = F.concat_ws(" at ", F.col("trip_id").cast("string"), F.col("pos").cast("string"))
    out = out.unionByName(_issues(timed.where("arrival > departure"), "trip", at, "arrives after it departs"))
    return out.unionByName(_issues(timed.where("arrival < _before"), "trip", at, "arrives before it left the stop before"))


def network_issues(network: dict[str, DataFrame]) -> DataFrame:
    """``(entity, key, issue)`` of a compiled network (see ``commands.compile_network``); none means that it can be routed and saved.

    Stations and patterns should be numbered without gaps, lines be named once, references lead somewhere, bins of edges
    lie in the day and each trip fit its pattern. Tables that the network lacks are not looked at.
    """
    out = contiguous(network["stations"], "station", "station")
    out = out.unionByName(contiguous(network["patterns"].select("pattern").distinct(), "pattern", "pattern"))
    twice = network["lines"].groupBy("line").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1 OR line IS NULL")
    out = out.unionByName(_issues(twice, "line", F.col("line"), "comes twice"))
    names = {"lines": "line", "stations": "station"}
    for table, column, target in REFERENCES:
        if table in network:
            out = out.unionByName(dangling(network[table], table, column, network[target], names[target]))
    if "edge_bins" in network:
        odd = network["edge_bins"].where(F.col("bin").isNull() | (F.col("bin") < 0) | (F.col("bin") >= BINS))
        out = out.unionByName(_issues(odd, "edge_bins", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("from_station", "to_station", "line", "bin")]), "bin is not of the day"))
    return out.unionByName(trip_issues(network["calls"], network["patterns"]))
