"""GTFS feeds: a folder or an archive of CSV tables, read as text, validated, then typed."""

from __future__ import annotations

import hashlib
import os
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linehaul.functions import scalars as S

#: Columns of each table; those read are strings, as in the files.
TABLES = {
    "stops": "stop_id stop_name stop_lat stop_lon location_type parent_station wheelchair_boarding",
    "routes": "route_id agency_id route_short_name route_long_name route_type route_color",
    "trips": "route_id service_id trip_id trip_headsign direction_id shape_id wheelchair_accessible",
    "stop_times": "trip_id arrival_time departure_time stop_id stop_sequence pickup_type drop_off_type",
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
    "calendar_dates": "service_id date exception_type",
    "transfers": "from_stop_id to_stop_id transfer_type min_transfer_time",
    "pathways": "pathway_id from_stop_id to_stop_id pathway_mode is_bidirectional traversal_time length",
}
REQUIRED = ("stops", "routes", "trips", "stop_times")
#: Stop times that a task joins and merges; fewer than that are left to Spark.
TIMES_AT_ONCE = 300_000


@dataclass
class Feed:
    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def unpack(archive: str, folder: str) -> str:
    """Tables of a ZIP archive as files of ``folder``; of entries with one base name, the exact name wins, then the first."""
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        names = z.namelist()
        for name in TABLES:
            file = f"{name}.txt"
            entry = file if file in names else next((n for n in names if os.path.basename(n) == file), None)
            if entry:
                with z.open(entry) as source, open(os.path.join(folder, file), "wb") as out:
                    while data := source.read(1 << 20):
                        out.write(data)
    return folder


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table by the names in its header; missing columns are null, blanks too, others are left out. ``row_no`` is the order."""
    columns = TABLES[name].split()
    if not _exists(spark, path):
        if name in REQUIRED:
            raise FileNotFoundError(f"{name}.txt is missing")
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns])).withColumn("row_no", F.lit(0).cast("long"))
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", encoding="UTF-8")
    by_name = {c.lstrip("﻿").strip(): c for c in raw.columns}
    cell = lambda c: F.when(F.trim(F.col(f"`{by_name[c]}`")) != "", F.trim(F.col(f"`{by_name[c]}`"))) if c in by_name else F.lit(None).cast("string")
    return raw.select(*[cell(c).alias(c) for c in columns], F.monotonically_increasing_id().alias("row_no"))


def read_feed(spark: SparkSession, path: str, staging: str | None = None) -> Feed:
    """A feed from a folder, or from a ZIP archive by way of ``staging``."""
    if path.endswith(".zip"):
        path = unpack(path, staging or path[:-4])
    return Feed({name: read_table(spark, f"{path}/{name}.txt", name) for name in TABLES})


def typed_stop_times(stop_times: DataFrame) -> DataFrame:
    """Clocks as seconds, sequence and codes as numbers; null where malformed."""
    return stop_times.select("trip_id", "stop_id", S.clock_seconds(F.col("arrival_time")).alias("arrival"), S.clock_seconds(F.col("departure_time")).alias("departure"), F.col("stop_sequence").try_cast("int").alias("seq"), S.small_code(F.col("pickup_type"), 3).alias("pickup"), S.small_code(F.col("drop_off_type"), 3).alias("drop_off"), "row_no")


def tasks_for(stop_times: DataFrame, at_once: int | None = None) -> int:
    """How many tasks the stop times fill, 1 if one will do; at least what runs at once."""
    tasks = -(-stop_times.count() // (at_once or TIMES_AT_ONCE))
    return max(tasks, stop_times.sparkSession.sparkContext.defaultParallelism) if tasks > 1 else 1


def dealt(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Rows dealt by ``key`` to as many tasks, whatever the number of shuffle partitions is; left as they are if one will do."""
    return df.repartition(tasks, key) if tasks > 1 else df


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str, what: str) -> DataFrame:
    """Child rows whose parent is missing, as (issue, key)."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.join(known, key, "left_anti").select(F.lit(what).alias("issue"), F.col(key).cast("string").alias("key"))


def duplicates(table: DataFrame, key: str, what: str) -> DataFrame:
    """A row for each occurrence of an id after the first, and for each empty id."""
    extra = table.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(F.lit(f"duplicate {what}").alias("issue"), F.explode(F.array_repeat(F.col(key).cast("string"), (F.col("count") - 1).cast("int"))).alias("key"))
    return extra.unionByName(table.where(F.col(key).isNull()).select(F.lit(f"empty {what}").alias("issue"), F.lit("").alias("key")))


def validate(feed: Feed) -> DataFrame:
    """All issues of a feed as (issue, key): missing references, repeated or empty ids, malformed stop times."""
    times, tasks = typed_stop_times(feed.stop_times), tasks_for(feed.stop_times)
    trips = dealt(feed.trips.select("trip_id"), "trip_id", tasks)
    bad = times.where("arrival IS NULL OR departure IS NULL OR seq IS NULL OR pickup IS NULL OR drop_off IS NULL OR departure < arrival")
    out = dangling(feed.trips, "route_id", feed.routes, "route_id", "trip without route")
    for part in (
        dangling(dealt(feed.stop_times.select("trip_id"), "trip_id", tasks), "trip_id", trips, "trip_id", "stop time without trip"),
        dangling(feed.stop_times, "stop_id", feed.stops, "stop_id", "stop time without stop"),
        duplicates(feed.stops, "stop_id", "stop_id"),
        duplicates(feed.routes, "route_id", "route_id"),
        duplicates(trips, "trip_id", "trip_id"),
        bad.select(F.lit("malformed stop time").alias("issue"), F.concat_ws("/", "trip_id", F.col("row_no").cast("string")).alias("key")),
    ):
        out = out.unionByName(part)
    return out


def lines_of(trips: DataFrame, routes: DataFrame, feed_id: str, overrides: DataFrame | None = None) -> DataFrame:
    """Per trip its line: key, display name, mode and agency; ``overrides`` (kind, raw_id, line, display) win, shape before trip before route."""
    label = F.coalesce("route_short_name", "route_long_name", "route_id")
    mode = F.coalesce(F.col("route_type").try_cast("int"), F.lit(3))
    both = trips.join(routes.select("route_id", "agency_id", "route_short_name", "route_long_name", "route_type"), "route_id")
    key = F.concat_ws(":", F.lit(feed_id), F.coalesce("agency_id", F.lit("")), label, mode.cast("string"))
    line, display = key, label
    if overrides is not None:
        for kind, column in (("route", "route_id"), ("trip", "trip_id"), ("shape", "shape_id")):
            o = F.broadcast(overrides.where(F.col("kind") == kind).select(F.col("raw_id").alias(column), F.col("line").alias(f"_{kind}"), F.col("display").alias(f"_{kind}_display")))
            both = both.join(o, column, "left")
            line, display = F.coalesce(f"_{kind}", line), F.coalesce(f"_{kind}_display", display)
    return both.select("trip_id", "route_id", "service_id", "direction_id", line.alias("line"), display.alias("display"), mode.alias("route_type"), "agency_id", both["row_no"])


def hash_folder(folder: str) -> str:
    """Digest of (relative path, length as eight bytes, content) of all files, by path."""
    digest, files = hashlib.sha256(), []
    for d, _, names in os.walk(folder):
        files += [os.path.relpath(os.path.join(d, n), folder) for n in names]
    for name in sorted(f.replace(os.sep, "/") for f in files):
        digest.update(name.encode())
        path = os.path.join(folder, name)
        digest.update(os.path.getsize(path).to_bytes(8, "little"))
        with open(path, "rb") as source:
            while data := source.read(1 << 20):
                digest.update(data)
    return digest.hexdigest()
