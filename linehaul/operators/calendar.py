"""Which services and trips run on a day."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def active_services(calendar: DataFrame, exceptions: DataFrame, services: DataFrame, day: datetime.date) -> DataFrame:
    """Service ids that run on ``day``: by weekday and dates, then as the last exception of the day says.

    ``exceptions`` has row_no, its order. With both tables empty every one of ``services`` runs. Exception types other
    than 1 (added) and 2 (removed) are an error.
    """
    if calendar.isEmpty() and exceptions.isEmpty():
        return services.select("service_id").distinct()
    if exceptions.where("exception_type NOT IN ('1', '2') OR exception_type IS NULL").limit(1).count():
        raise ValueError("calendar_dates has an exception type other than 1 and 2")
    from linehaul.functions.scalars import gtfs_date

    today = F.lit(day)
    regular = calendar.where((F.col(DAYS[day.weekday()]) == "1") & (gtfs_date(F.col("start_date")) <= today) & (gtfs_date(F.col("end_date")) >= today)).select("service_id").distinct()
    last = exceptions.where(gtfs_date(F.col("date")) == today).groupBy("service_id").agg(F.max_by("exception_type", "row_no").alias("last"))
    removed, added = last.where("last = '2'").select("service_id"), last.where("last = '1'").select("service_id")
    return regular.join(removed, "service_id", "left_anti").union(added).distinct()


def active_trips(trips: DataFrame, services: DataFrame) -> DataFrame:
    return trips.join(services, "service_id", "left_semi")


def scope(stops: DataFrame, routes: DataFrame, trips: DataFrame, stop_times: DataFrame, inside: DataFrame, route_ok, least: int) -> dict[str, DataFrame]:
    """Tables cut to a scope: routes of the wanted modes, trips with at least ``least`` stops inside, stop times inside, their stops and parents."""
    from linehaul.operators.stations import parent_closure

    kept_routes = routes.where(route_ok)
    within = stop_times.join(inside.select("stop_id"), "stop_id", "left_semi")
    enough = within.groupBy("trip_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("trip_id")
    kept_trips = trips.join(kept_routes.select("route_id"), "route_id", "left_semi").join(enough, "trip_id", "left_semi")
    times = within.join(kept_trips.select("trip_id"), "trip_id", "left_semi")
    used = parent_closure(stops, times.select("stop_id").distinct())
    return {
        "stops": stops.join(used, "stop_id", "left_semi"),
        "routes": kept_routes.join(kept_trips.select("route_id"), "route_id", "left_semi"),
        "trips": kept_trips,
        "stop_times": times,
    }
