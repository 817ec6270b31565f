"""From stop times to calls, patterns, edges and the statistics of lines and stations.

Calls are (trip_id, line, station, pos, arrival, departure, pickup, drop_off), positions from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linehaul.functions.scalars import BINS, in_peak, service_day_bin
from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch

SIGNATURE = ["line", "stops", "pickups", "drop_offs"]


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Per key the element at half the count, from 0, of the sorted values.

    Counts of distinct values go through the shuffle, not the values, so a key costs as much as it has distinct ones.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return weighted_upper_median(counts, keys, value, "_n", name)


def weighted_upper_median(counts: DataFrame, keys: list[str], value: str, count: str, name: str) -> DataFrame:
    """The same of values that come with their counts."""
    w = Window.partitionBy(*keys)
    upto = F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*keys, value, upto.alias("_upto"), F.sum(count).over(w).alias("_all"))
    return ranked.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias(name))


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Per key the value at rank ceil(share * count), from 1."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*keys, value, upto.alias("_upto"), F.sum("_n").over(w).alias("_all"))
    return ranked.where(F.col("_upto") >= F.ceil(F.col("_all") * share)).groupBy(*keys).agg(F.min(value).alias(name))


def merge_calls(stop_times: DataFrame, least: int = 2) -> DataFrame:
    """Consecutive stops of a trip at one station as one call: earliest arrival, latest departure, laxest codes.

    Trips with fewer than ``least`` calls go.
    """
    trip = Window.partitionBy("trip_id").orderBy("seq")
    new = F.when(F.lag("station").over(trip) == F.col("station"), 0).otherwise(1)
    islands = stop_times.withColumn("_new", new).withColumn("_k", F.sum("_new").over(trip))
    merged = islands.groupBy("trip_id", "line", "station", "_k").agg(F.min("arrival").alias("arrival"), F.max("departure").alias("departure"), F.min("pickup").alias("pickup"), F.min("drop_off").alias("drop_off"))
    calls = merged.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("trip_id"))).where(F.col("_n") >= least)
    return calls.select("trip_id", "line", "station", (F.col("_k") - 1).cast("int").alias("pos"), "arrival", "departure", "pickup", "drop_off")


def violations(stop_times: DataFrame) -> DataFrame:
    """Stop times that leave before they arrive, or arrive before the trip left its stop before."""
    trip = Window.partitionBy("trip_id").orderBy("seq")
    before = F.lag("departure").over(trip)
    return stop_times.withColumn("before", before).where((F.col("departure") < F.col("arrival")) | (F.col("arrival") < F.col("before"))).select("trip_id", "seq", "arrival", "departure", "before")


def segments(calls: DataFrame) -> DataFrame:
    """Neighbouring calls of a trip: from_station, to_station, departure, arrival, pos and the trip's number of calls."""
    trip = Window.partitionBy("trip_id").orderBy("pos")
    rows = calls.select("trip_id", "line", "pos", F.col("station").alias("from_station"), "departure", F.lead("station").over(trip).alias("to_station"), F.lead("arrival").over(trip).alias("arrival"), F.count(F.lit(1)).over(Window.partitionBy("trip_id")).alias("calls"))
    return rows.where("to_station IS NOT NULL AND from_station <> to_station AND arrival >= departure").withColumn("runtime", F.col("arrival") - F.col("departure"))


def whole_trips(calls: DataFrame) -> DataFrame:
    """Per trip and line its calls in order: ``along``, an array of structs. Written once, it answers what is asked of trips without a shuffle."""
    call = F.struct("pos", "station", "arrival", "departure", "pickup", "drop_off")
    return calls.groupBy("trip_id", "line").agg(F.array_sort(F.collect_list(call)).alias("along"))


def trip_calls(trips: DataFrame) -> DataFrame:
    """The calls of whole trips."""
    return trips.select("trip_id", "line", F.inline("along")).select("trip_id", "line", "station", "pos", "arrival", "departure", "pickup", "drop_off")


def _ride(a: Column, b: Column) -> Column:
    return b["station"].isNotNull() & (a["station"] != b["station"]) & (b["arrival"] >= a["departure"])


def trip_segments(trips: DataFrame) -> DataFrame:
    """The ``segments`` of whole trips."""
    n = F.size("along")
    pair = lambda a, b: F.struct(a["pos"].alias("pos"), a["station"].alias("from_station"), a["departure"].alias("departure"), b["station"].alias("to_station"), b["arrival"].alias("arrival"), _ride(a, b).alias("ride"))
    rows = trips.select("trip_id", "line", n.alias("calls"), F.inline(F.zip_with(F.slice("along", 1, n - 1), F.slice("along", 2, n), pair)))
    return rows.where("ride").drop("ride").withColumn("runtime", F.col("arrival") - F.col("departure"))


def trip_signatures(trips: DataFrame) -> DataFrame:
    """The ``signatures`` of whole trips, and ``rides``: for each call but the last from>to where a segment begins, else nothing."""
    n = F.size("along")
    text = lambda c: F.array_join(F.transform("along", lambda x: x[c]), ",")
    ride = lambda a, b: F.when(_ride(a, b), F.concat_ws(">", a["station"], b["station"])).otherwise("")
    rides = F.array_join(F.zip_with(F.slice("along", 1, n - 1), F.slice("along", 2, n), ride), ",")
    return trips.select("trip_id", "line", text("station").alias("stops"), text("pickup").alias("pickups"), text("drop_off").alias("drop_offs"), F.get("along", F.lit(0))["departure"].alias("first_departure"), n.cast("long").alias("calls"), rides.alias("rides"))


EDGE = ["from_station", "to_station", "line"]


def transit_edges(segs: DataFrame) -> DataFrame:
    """Per (from, to, line): trips, minimum and upper-median runtime, from one count of runtimes."""
    counts = segs.groupBy(*EDGE, "runtime").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*EDGE)
    upto = F.sum("n").over(w.orderBy("runtime").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*EDGE, "runtime", upto.alias("upto"), F.sum("n").over(w).alias("trips"), F.min("runtime").over(w).alias("min_runtime"))
    return ranked.where(F.col("upto") > F.floor(F.col("trips") / 2)).groupBy(*EDGE).agg(F.min("trips").alias("trips"), F.min("min_runtime").alias("min_runtime"), F.min("runtime").alias("median_runtime"))


def edge_lookup(rows: DataFrame, edges: DataFrame, values: list[str]) -> DataFrame:
    """Values of each row's edge, 0 where there is none."""
    return rows.join(edges.select(*EDGE, *values), EDGE, "left").na.fill(0, values)


def edge_bins(segs: DataFrame) -> DataFrame:
    """Per edge and quarter-hour: departures and upper-median runtime."""
    binned = segs.withColumn("bin", service_day_bin(F.col("departure")))
    return binned.groupBy(*EDGE, "bin").agg(F.count(F.lit(1)).alias("departures")).join(upper_median(binned, [*EDGE, "bin"], "runtime", "median_runtime"), [*EDGE, "bin"])


def edge_positions(segs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per edge the relative position of the first (pattern, trip, place) that has it."""
    placed = segs.join(patterns.select("trip_id", "pattern", "trip_rank"), "trip_id")
    place = F.col("pos") / F.greatest(F.col("calls") - 1, F.lit(1))
    return placed.groupBy(*EDGE).agg(F.min_by(place, F.struct("pattern", "trip_rank", "pos")).alias("relative_position"))


def numbered_patterns(signatures: DataFrame, scratch: Scratch) -> DataFrame:
    """Per pattern its signature, number as in ``patterns``, calls, number of trips ``n`` and the distinct ``rides`` of its trips, in the order of the first trip that has them."""
    first = F.min(F.struct("first_departure", "trip_id")).alias("first")
    kinds = signatures.groupBy(*SIGNATURE, "calls", "rides").agg(F.count(F.lit(1)).alias("n"), first)
    rides = F.transform(F.array_sort(F.collect_list(F.struct("first", "rides"))), lambda x: x["rides"])
    each = scratch.table(kinds.groupBy(*SIGNATURE).agg(F.sum("n").alias("n"), F.max("calls").alias("calls"), rides.alias("rides")), "counted")
    return scratch.table(numbered(each, SIGNATURE, "pattern", scratch), "patterns")


def pattern_edge_positions(patterns: DataFrame) -> DataFrame:
    """What ``edge_positions`` gives, from ``numbered_patterns``: trips of a pattern have their stops at the same places.

    A pattern's rides stand one behind the other. Its number and the place among them are one long, so that the least is
    found by hash; the pattern that it names has the length.
    """
    all_rides = F.flatten(F.transform("rides", lambda r: F.split(r, ",")))
    at = patterns.select("line", "pattern", F.posexplode(all_rides).alias("i", "r")).where("r <> ''")
    ends = [F.get(F.split("r", ">"), F.lit(i)).cast("int").alias(c) for i, c in enumerate(EDGE[:2])]
    first = at.select(*ends, "line", (F.col("pattern") * F.lit(1 << 28) + F.col("i")).alias("at")).groupBy(*EDGE).agg(F.min("at").alias("at"))
    first = first.select(*EDGE, F.shiftright("at", 28).alias("pattern"), (F.col("at") % F.lit(1 << 28)).alias("i"))
    steps = F.greatest(F.col("calls") - 1, F.lit(1))
    return first.join(patterns.select("pattern", "calls"), "pattern").select(*EDGE, (F.col("i") % steps / steps).alias("relative_position"))


def dense(df: DataFrame, keys: list[str], bin_col: str, value: str, size: int = BINS, name: str = "values") -> DataFrame:
    """Per key an array of ``size`` values by bin, 0 where there is none."""
    pairs = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(bin_col, value))).alias("_m"))
    return pairs.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0))).alias(name))


def signatures(calls: DataFrame) -> DataFrame:
    """Per trip its signature (line, stops, pickups, drop_offs), first departure and number of calls."""
    by_pos = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    trips = calls.groupBy("trip_id", "line").agg(by_pos("station").alias("stops"), by_pos("pickup").alias("pickups"), by_pos("drop_off").alias("drop_offs"), F.min_by("departure", "pos").alias("first_departure"), F.count(F.lit(1)).alias("calls"))
    text = lambda c: F.array_join(c, ",")
    return trips.withColumns({"stops": text("stops"), "pickups": text("pickups"), "drop_offs": text("drop_offs")})


def patterns(calls: DataFrame, scratch: Scratch | None = None, signed: DataFrame | None = None) -> DataFrame:
    """Per trip its pattern (trips of one line with the same stops and codes) and its rank in it, by first departure and id.

    Patterns are numbered in the order of line, stops and codes. Where no number is asked for, ``signatures`` will do.
    ``signed``: the calls' signatures where they are there already.
    """
    scratch = scratch or Scratch(calls.sparkSession, "patterns")
    trips = scratch.table(signatures(calls) if signed is None else signed, "trips")
    each = numbered(trips.select(*SIGNATURE).distinct(), SIGNATURE, "pattern", scratch).withColumn("pattern", F.col("pattern").cast("int"))
    ranked = trips.join(each, SIGNATURE)
    rank = F.row_number().over(Window.partitionBy("pattern").orderBy("first_departure", "trip_id")) - 1
    return ranked.withColumn("trip_rank", rank.cast("int"))


def line_summary(calls: DataFrame, trips: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Per line: patterns, trips, stations, first departure, last arrival and the span between. ``trips`` have signatures.

    ``counted``: the patterns of the trips with their number ``n``, where they are there already.
    """
    counted = trips.groupBy(*SIGNATURE).agg(F.count(F.lit(1)).alias("n")) if counted is None else counted
    stats = calls.groupBy("line").agg(F.countDistinct("station").alias("stations"), F.min("departure").alias("first_departure"), F.max("arrival").alias("last_arrival"))
    counts = counted.groupBy("line").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("trips"))
    return stats.join(counts, "line").withColumn("span", F.greatest(F.col("last_arrival") - F.col("first_departure"), F.lit(0)))


def first_departures(calls: DataFrame) -> DataFrame:
    return calls.where("pos = 0").select("trip_id", "line", F.col("departure").alias("first_departure"))


def line_headways(trips: DataFrame) -> DataFrame:
    """Per line the upper-median gap between first departures: all day, in the peak and off it; 0 with fewer than two.

    Departures of one second are counted, not listed: their gaps are zeros, and only distinct seconds are put in order.
    """

    at = F.col("first_departure")
    peak = in_peak(at)
    kinds = F.array(F.lit("headway"), F.when(peak, "peak_headway").otherwise("offpeak_headway"))
    seconds = trips.groupBy("line", "first_departure").agg(F.count(F.lit(1)).alias("n")).select("*", F.explode(kinds).alias("kind"))
    before = F.lag("first_departure").over(Window.partitionBy("line", "kind").orderBy("first_departure"))
    seconds = seconds.withColumn("ahead", at - before)
    gaps = seconds.select("line", "kind", F.explode(F.array(F.struct(F.col("ahead").alias("gap"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("n")))).alias("g"))
    counts = gaps.where("g.gap IS NOT NULL AND g.n > 0").groupBy("line", "kind", F.col("g.gap").alias("gap")).agg(F.sum("g.n").alias("n"))
    w = Window.partitionBy("line", "kind")
    upto = F.sum("n").over(w.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    median = counts.select("line", "kind", "gap", upto.alias("upto"), F.sum("n").over(w).alias("all")).where(F.col("upto") > F.floor(F.col("all") / 2))
    names = ("headway", "peak_headway", "offpeak_headway")
    median = median.groupBy("line").agg(*[F.min(F.when(F.col("kind") == n, F.col("gap"))).alias(n) for n in names])
    return seconds.select("line").distinct().join(median, "line", "left").na.fill(0)


def line_branching(trips: DataFrame) -> DataFrame:
    """Per line the share of its patterns that end elsewhere than they start. ``trips`` have signatures."""
    return pattern_branching(trips.select(*SIGNATURE).distinct())


def pattern_branching(patterns: DataFrame) -> DataFrame:
    """The same of a row per pattern."""
    ends = F.split("stops", ",")
    return patterns.groupBy("line").agg(F.avg(F.when(F.element_at(ends, 1) != F.element_at(ends, -1), 1.0).otherwise(0.0)).alias("branching"))


def line_sharing(segs: DataFrame) -> DataFrame:
    """Per line: distinct segments and the share of them that another line has too."""
    own = segs.select("from_station", "to_station", "line").distinct()
    lines = own.groupBy("from_station", "to_station").agg(F.count(F.lit(1)).alias("lines"))
    return own.join(lines, ["from_station", "to_station"]).groupBy("line").agg(F.count(F.lit(1)).alias("segments"), F.avg(F.when(F.col("lines") > 1, 1.0).otherwise(0.0)).alias("shared_fraction"))


def line_lengths(segs: DataFrame, stations: DataFrame, distance: Column) -> DataFrame:
    """Per line the metres of its distinct segments. ``distance`` is over lat1, lon1, lat2, lon2."""
    own = segs.select("from_station", "to_station", "line").distinct()
    a = stations.select(F.col("station").alias("from_station"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = stations.select(F.col("station").alias("to_station"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return own.join(a, "from_station").join(b, "to_station").groupBy("line").agg(F.coalesce(F.sum(distance), F.lit(0.0)).alias("metres"))


def line_stations(calls: DataFrame) -> DataFrame:
    """Per line: its stations, the share of them that no other line has, and those shared with others."""
    own = calls.select("line", "station").distinct()
    lines = own.groupBy("station").agg(F.count(F.lit(1)).alias("lines"))
    one = F.when(F.col("lines") == 1, 1).otherwise(0)
    return own.join(lines, "station").groupBy("line").agg(F.count(F.lit(1)).alias("stations"), F.avg(one.cast("double")).alias("unique_fraction"), F.sum(1 - one).alias("transfer_stations"))


def station_summary(calls: DataFrame) -> DataFrame:
    """Per station: lines, calls (a call is a departure and an arrival), earliest departure and latest arrival."""
    return calls.groupBy("station").agg(F.countDistinct("line").alias("lines"), F.count(F.lit(1)).alias("daily_calls"), F.min("departure").alias("first_departure"), F.max("arrival").alias("last_departure"))


def station_bins(calls: DataFrame) -> DataFrame:
    """Per station and quarter-hour: departures and distinct lines."""
    return calls.withColumn("bin", service_day_bin(F.col("departure"))).groupBy("station", "bin").agg(F.count(F.lit(1)).alias("departures"), F.countDistinct("line").alias("lines"))


def transfer_degree(transfers: DataFrame) -> DataFrame:
    """Per station the distinct neighbours by walks in either direction."""
    both = transfers.select("from_station", "to_station").union(transfers.select("to_station", "from_station"))
    return both.groupBy(F.col("from_station").alias("station")).agg(F.countDistinct("to_station").alias("degree"))


def dedupe_transfers(explicit: DataFrame, pathways: DataFrame) -> DataFrame:
    """One walk for each ordered pair: the shortest explicit one, the first row of equals; pathways only where there is none.

    ``explicit``: from_station, to_station, transfer_type, seconds, row_no; type 3 forbids. ``pathways``: from_station,
    to_station, bidirectional, seconds, row_no; a two-way one counts for both directions. Loops go.
    """
    e = explicit.where("transfer_type <> 3 AND from_station <> to_station").select("from_station", "to_station", "seconds", "row_no", F.lit(0).alias("source"))
    p = pathways.where("from_station <> to_station")
    back = p.where("bidirectional = 1").select(F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"), "seconds", "row_no")
    p = p.select("from_station", "to_station", "seconds", "row_no").unionByName(back).withColumn("source", F.lit(1))
    best = F.row_number().over(Window.partitionBy("from_station", "to_station").orderBy("source", "seconds", "row_no"))
    return e.unionByName(p).withColumn("_r", best).where("_r = 1").select("from_station", "to_station", "seconds", "source")


def interchanges(calls: DataFrame) -> DataFrame:
    """Ordered pairs of lines with the number of stations they share."""
    own = calls.select("line", "station").distinct()
    other = own.select(F.col("line").alias("other"), "station")
    return own.join(other, "station").where("line <> other").groupBy("line", "other").agg(F.count(F.lit(1)).alias("shared_stations"))
