"""One-to-all routing by rounds of rides, for many queries at once, and its interventions.

A round is two joins and two minima: the earliest place each trip can be boarded, then the earliest arrival at each
later stop, then walks. Both are dealt by trip to as many tasks as the round's boardings and the calls fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.scratch import Scratch
from linehaul.sources.gtfs import dealt

#: Boardings and calls that a task joins by trip; fewer than that are left to Spark.
ROWS_AT_ONCE = 300_000
#: Stations reached, over all queries, that every executor may hold (a few numbers each); more are joined by shuffle.
REACH_HELD = 200_000

QUERY = "query_id long, origin int, departure int, disabled array<string>, closed int, scaled string, multiplier double"


def walk_closure(transfers: DataFrame, cap: int, scratch: Scratch | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Shortest walks ``(a, b, seconds)`` of any number of transfers between different stations, up to ``cap`` seconds.

    Each pass joins the walks so far with themselves, so their number of transfers doubles. Columns ``by`` part the
    transfers into networks of their own, all closed at once.
    """
    by = list(by)
    spark: SparkSession = transfers.sparkSession
    scratch = scratch or Scratch(spark, "walks")
    walks = transfers.where((F.col("from_station") != F.col("to_station")) & (F.col("seconds") <= cap)).groupBy(*by, F.col("from_station").alias("a"), F.col("to_station").alias("b")).agg(F.min("seconds").alias("seconds"))
    walks = scratch.table(walks, "walks")
    while True:
        x, y = walks.select(*by, "a", F.col("b").alias("m"), F.col("seconds").alias("s1")), walks.select(*by, F.col("a").alias("m"), "b", F.col("seconds").alias("s2"))
        longer = x.join(y, [*by, "m"]).where("a <> b").select(*by, "a", "b", (F.col("s1") + F.col("s2")).alias("seconds")).where(F.col("seconds") <= cap)
        new = scratch.table(walks.unionByName(longer).groupBy(*by, "a", "b").agg(F.min("seconds").alias("seconds")), "walks")
        if not new.exceptAll(walks).limit(1).count():
            return new
        scratch.drop(walks)
        walks = new


def retained(trip_rank: Column, trips: Column, multiplier: Column) -> Column:
    """Whether a trip stays when its pattern's frequency is scaled: an even share of round(trips * multiplier), at least one."""
    keep = F.least(F.greatest(F.round(trips * multiplier), F.lit(1)), trips)
    return F.when(F.isnan(multiplier) | (multiplier <= 0), False).when(multiplier >= 1, True).otherwise((trip_rank * keep) % trips < keep)


def one_to_all(calls: DataFrame, transfers: DataFrame, queries: DataFrame, rides: int = 5, cap: int = 7200, scratch: Scratch | None = None, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """``(query_id, station, arrival, transfers)`` of every station reached within ``cap`` seconds and ``rides`` rides.

    ``calls``: trip_id, line, station, pos, arrival, departure, pickup, drop_off and, where a line is scaled,
    trip_rank and pattern_trips. ``queries``: see ``QUERY``; nulls mean no intervention. A closed station is neither
    walked through nor boarded or left at. All trips still to come can be boarded, also those that overtake. A round
    goes on from the stations alone that it reaches earlier than any round before: what follows from others takes more
    rides and is not earlier. Calls that are no table of the scratch folder yet are written there once.
    """
    spark: SparkSession = calls.sparkSession
    scratch = scratch or Scratch(spark, "routes")
    own = not hasattr(calls, "_scratch_path")
    if own:
        calls = scratch.table(calls, "calls")
    queries = scratch.table(queries, "queries")
    # when any query is on its way
    since, until = queries.agg(F.min("departure"), F.max("departure") + cap).first()
    meanwhile = F.col("arrival").between(F.lit(since), F.lit(until))
    exits = calls.where("drop_off <> 1").where(meanwhile).select("trip_id", "station", "pos", "arrival")
    n_exits = exits.count()
    # the network as it is, and once more without each station that some query closes
    closed = queries.select(F.coalesce("closed", F.lit(-1)).alias("without")).distinct()
    edges = transfers.select("from_station", "to_station", "seconds")
    edges = edges.join(closed, (F.col("without") != F.col("from_station")) & (F.col("without") != F.col("to_station")))
    walks = walk_closure(edges, cap, scratch, ["without"])
    how = queries.select("query_id", F.col("departure").alias("start"), F.coalesce("disabled", F.array().cast("array<string>")).alias("disabled"), F.coalesce("closed", F.lit(-1)).alias("closed"), "scaled", "multiplier")

    def walked(reach: DataFrame) -> DataFrame:
        step = reach.join(how.select("query_id", "start", "closed"), "query_id").join(walks, (F.col("station") == F.col("a")) & (F.col("closed") == F.col("without")))
        step = step.select("query_id", F.col("b").alias("station"), (F.col("arrival") + F.col("seconds")).alias("arrival"), "start").where(F.col("arrival") <= F.col("start") + cap).drop("start")
        return reach.unionByName(step).groupBy("query_id", "station").agg(F.min("arrival").alias("arrival"))

    start = queries.where("closed IS NULL OR closed <> origin").select("query_id", F.col("origin").alias("station"), F.col("departure").alias("arrival"))
    reach = scratch.table(walked(start), "reach")
    best = scratch.table(reach.withColumn("rides", F.lit(0)), "best")
    scaled = "trip_rank" in calls.columns
    for k in range(1, rides + 1):
        waiting = reach.withColumnRenamed("arrival", "since").join(how, "query_id")
        waiting = F.broadcast(waiting) if reach.count() <= REACH_HELD else waiting
        boards = waiting.join(calls.where("pickup <> 1"), "station")
        boards = boards.where((F.col("departure") >= F.col("since")) & (F.col("departure") <= F.col("start") + cap) & ~F.array_contains("disabled", F.col("line")) & (F.col("closed") != F.col("station")))
        if scaled:
            keeps = retained(F.col("trip_rank"), F.col("pattern_trips"), F.col("multiplier"))
            boards = boards.where(F.col("scaled").isNull() | (F.col("scaled") != F.col("line")) | F.coalesce(keeps, F.lit(True)))
        boards = scratch.table(boards.select("query_id", "trip_id", "pos"), "boards")
        tasks = -(-(boards.count() + n_exits) // at_once)
        tasks = max(tasks, spark.sparkContext.defaultParallelism) if tasks > 1 else 1
        board = dealt(boards, "trip_id", tasks).groupBy("query_id", "trip_id").agg(F.min("pos").alias("board"))
        rest = dealt(exits, "trip_id", tasks)
        alights = board.join(rest, "trip_id").where("pos > board").join(how.select("query_id", "start", "closed"), "query_id")
        alights = alights.where((F.col("station") != F.col("closed")) & F.col("arrival").between(F.col("start"), F.col("start") + cap))
        arrived = walked(alights.groupBy("query_id", "station").agg(F.min("arrival").alias("arrival")))
        before = best.select("query_id", "station", F.col("arrival").alias("before"))
        reach = arrived.join(before, ["query_id", "station"], "left").where(F.col("before").isNull() | (F.col("arrival") < F.col("before"))).drop("before")
        reach = scratch.table(reach, "reach")
        scratch.drop(boards)
        if not reach.limit(1).count():
            break
        new = best.unionByName(reach.withColumn("rides", F.lit(k))).groupBy("query_id", "station").agg(F.min(F.struct("arrival", "rides")).alias("b"))
        new = scratch.table(new.select("query_id", "station", "b.arrival", "b.rides"), "best")
        scratch.drop(best)
        best = new
    if own:
        scratch.drop(calls)
    return best.select("query_id", "station", "arrival", F.greatest(F.col("rides") - 1, F.lit(0)).alias("transfers"))


def query_grid(origins: DataFrame, departures: Sequence[int]) -> DataFrame:
    """Queries without intervention from every origin at every departure; departures are few."""
    rows = origins.select("origin", F.explode(F.array(*[F.lit(int(d)) for d in departures])).alias("departure"))
    none = {c.split(" ")[0]: F.lit(None).cast(c.split(" ", 1)[1]) for c in QUERY.split(", ")[3:]}
    return rows.withColumn("query_id", F.xxhash64("origin", "departure")).withColumns(none)


def line_removals(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """Every query once more for each line without it. query_id stays in ``base``; the new ids follow it and the line."""
    both = queries.withColumnRenamed("query_id", "base").drop("disabled").crossJoin(lines.select(F.col("line").alias("removed")))
    return both.withColumn("query_id", F.xxhash64("base", "removed")).withColumn("disabled", F.array("removed"))
