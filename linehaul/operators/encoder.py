"""Line and station vectors of a network: projected features, a recurrence along patterns, rounds of messages.

Vectors are array columns of one length. A sum of vectors is an aggregate of its places, so that it is combined on the
map side and a station that most edges touch costs a row for each task. A round of messages cuts its lineage.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linehaul.functions.scalars import BINS, service_day_bin
from linehaul.operators.network import weighted_upper_median
from linehaul.scratch import Scratch

#: Fixed shares of the encoder: what a state keeps of itself and takes from each relation.
KEEP, FROM_LINES, FROM_WALKS, FROM_RIDES, FROM_STATIONS, FROM_INTERCHANGES, FROM_PATTERNS = 0.58, 0.14, 0.12, 0.16, 0.20, 0.14, 0.22
STATION_SEED, LINE_SEED = 17, 31
CHANNELS = 4


def mean_vectors(df: DataFrame, keys: list[str], vector: str, width: int, name: str, weight: Column | None = None) -> DataFrame:
    """Per key the mean of vectors, place by place, weighted if a weight is given."""
    at = lambda i: F.get(vector, F.lit(i))
    if weight is None:
        return df.groupBy(*keys).agg(F.array(*[F.avg(at(i)) for i in range(width)]).alias(name))
    return df.groupBy(*keys).agg(F.array(*[F.sum(at(i) * weight) / F.sum(weight) for i in range(width)]).alias(name))


def pooled_vectors(df: DataFrame, keys: list[str], vector: str, width: int, name: str) -> DataFrame:
    """Per key the means of all places and then their largest values, 0 at least."""
    at = lambda i: F.get(vector, F.lit(i))
    return df.groupBy(*keys).agg(F.array(*[F.avg(at(i)) for i in range(width)], *[F.greatest(F.max(at(i)), F.lit(0.0)) for i in range(width)]).alias(name))


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def matrix_product(weights: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, bounded: bool = False, unit: bool = False):
    """A function of a vector column: tanh(vector x matrix), the matrix given by a rule over (row, column), both from 0.

    ``bounded``: values x become x / (1 + |x|) first, and sums are divided by the root of the vector's length.
    ``unit``: results have length 1, unless they are next to nothing. The rule makes the matrix once in each batch; it
    is never sent. Empty vectors give zeros.
    """

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), object)
        sizes = v.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if not size:
                for k in at:
                    out[k] = np.zeros(width)
                continue
            x = np.stack(v.iloc[at].to_numpy()).astype(float)
            if bounded:
                x = x / (1 + np.abs(x)) / max(1.0, np.sqrt(size))
            y = np.tanh(x @ weights(np.arange(size)[:, None], np.arange(width)[None, :]))
            if unit:
                norm = np.sqrt((y * y).sum(1, keepdims=True))
                y = np.where(norm > 2.0**-23, y / np.where(norm > 0, norm, 1), y)
            for k, row in zip(at, y, strict=True):
                out[k] = row
        return pd.Series(list(out))

    return run


def feature_projection(width: int, seed: int):
    return matrix_product(lambda i, o: np.sin((i + seed + 1) * (o + 1) * 0.017) * 0.05, width)


def gap_medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per key the upper median of the gaps between its values in order; keys with fewer than two have none.

    Equal values are counted, not listed: their gaps are zeros.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(value))
    counts = counts.select(*keys, "_n", ahead.alias("_ahead"))
    both = F.array(F.struct(F.col("_ahead").alias("gap"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(0).alias("gap"), (F.col("_n") - 1).alias("n")))
    gaps = counts.select(*keys, F.explode(both).alias("g")).where("g.gap IS NOT NULL AND g.n > 0").groupBy(*keys, F.col("g.gap").alias("gap")).agg(F.sum("g.n").alias("n"))
    return weighted_upper_median(gaps, keys, "gap", "n", name)


def temporal_channels(calls: DataFrame, key: str) -> DataFrame:
    """(key, channels): four arrays over the quarter-hours of the day.

    Of a station departures, arrivals, lines that depart and the upper-median gap of departures; of a line the trips
    that begin, three times over as the format has it, and the gap between them.
    """
    rows = calls if key == "station" else calls.where("pos = 0")
    rows = rows.select(key, "line", "departure", service_day_bin(F.col("departure")).alias("bin"), service_day_bin(F.col("arrival")).alias("came"), *(["station"] if key == "line" else []))
    keys = [key, "bin"]
    if key == "station":
        left = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c0"), F.countDistinct("line").alias("c2"))
        bins = left.join(rows.groupBy(key, F.col("came").alias("bin")).agg(F.count(F.lit(1)).alias("c1")), keys, "full")
    else:
        bins = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c0")).withColumns({"c1": F.col("c0"), "c2": F.col("c0")})
    bins = bins.join(gap_medians(rows, keys, "departure", "c3"), keys, "left").select(*keys, *[F.coalesce(f"c{c}", F.lit(0)).cast("double").alias(f"c{c}") for c in range(CHANNELS)])
    held = bins.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.array(*[f"c{c}" for c in range(CHANNELS)])))).alias("m"))
    channel = lambda c: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.get(F.try_element_at("m", b), F.lit(c)), F.lit(0.0)))
    return held.select(key, F.array(*[channel(c) for c in range(CHANNELS)]).alias("channels"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def channel_summary(channels: Column) -> Column:
    """Mean and largest value, 0 at least, of each channel, one after another; zeros without channels."""
    each = F.flatten(F.transform(channels, lambda c: F.array(_sum(c) / F.size(c), F.greatest(F.array_max(c), F.lit(0.0)))))
    return F.coalesce(each, zeros(2 * CHANNELS))


def distinct_patterns(trips: DataFrame) -> DataFrame:
    """(line, stops, pickups, drop_offs, trips): one row per pattern of ``network.signatures``, arrays of numbers."""
    return pattern_stops(trips.groupBy("line", "stops", "pickups", "drop_offs").agg(F.count(F.lit(1)).alias("n")))


def pattern_stops(patterns: DataFrame) -> DataFrame:
    """The same from a row per pattern with its number of trips ``n``."""
    numbers = lambda c: F.transform(F.split(c, ","), lambda x: x.cast("int")).alias(c)
    return patterns.select("line", *[numbers(c) for c in ("stops", "pickups", "drop_offs")], F.col("n").alias("trips"))


def fold_patterns(patterns: DataFrame, stations: DataFrame, lines: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(line, context): states at the ends of patterns, folded along their stops, meaned by number of trips.

    ``stations`` (station, v), ``lines`` (line, v), ``edges`` (from_station, to_station, line, features). A stop's drive
    is made of vectors of its station and line, the features of the edge that leaves it, its codes and its place; the
    state is tanh(0.58 state + drive). A pattern is as long as its trips, so that a task folds bounded arrays.
    """
    rows = patterns.select("line", "trips", F.xxhash64("line", "stops", "pickups", "drop_offs").alias("a"), F.hash("line", "stops", "pickups", "drop_offs").alias("b"), F.size("stops").alias("n"), F.posexplode(F.arrays_zip("stops", "pickups", "drop_offs")).alias("pos", "at"), "stops")
    rows = rows.select("line", "trips", "a", "b", "n", "pos", F.col("at.stops").alias("station"), F.get("stops", F.col("pos") + 1).alias("then"), (F.col("at.pickups") / 3).alias("pickup"), (F.col("at.drop_offs") / 3).alias("drop_off"))
    edge = edges.select(F.col("from_station").alias("station"), F.col("to_station").alias("then"), "line", F.col("features").alias("edge"))
    rows = rows.join(stations.select("station", F.col("v").alias("sv")), "station", "left").join(edge, ["station", "then", "line"], "left").join(lines.select("line", F.col("v").alias("lv")), "line")
    place = F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1))

    def drive(i: Column) -> Column:
        h = i + 1
        stop = F.col("pickup") * F.sin(h * 0.37) + F.col("drop_off") * F.sin(h * 0.74) + place * F.sin(h * 1.11)
        edge = F.coalesce(F.get("edge", i % F.size("edge")), F.lit(0.0))
        return F.coalesce(F.get("sv", i), F.lit(0.0)) * 0.34 + edge * 0.08 + stop * 0.03 + F.get("lv", i) * 0.05 + place * 0.002

    driven = rows.select("line", "trips", "a", "b", "pos", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), drive).alias("x"))
    along = driven.groupBy("line", "trips", "a", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("along"))
    state = F.aggregate("along", zeros(width), lambda s, p: F.zip_with(s, p["x"], lambda old, new: F.tanh(old * KEEP + new)))
    return mean_vectors(along.select("line", state.alias("v"), F.greatest("trips", F.lit(1)).alias("weight")), ["line"], "v", width, "context", F.col("weight"))


def _combined(own: str, relations: dict[str, float], layer: float) -> Column:
    """The next state: what it keeps, what comes over each relation (nothing where there is no edge), a small wave by place."""
    came = lambda i: sum((F.coalesce(F.get(c, i), F.lit(0.0)) * w for c, w in relations.items()), F.lit(0.0))
    return F.transform(own, lambda x, i: F.tanh(x * KEEP + came(i) + F.sin(i * 0.0001 + layer * 0.01) * 0.001))


def message_round(graph: dict[str, DataFrame], stations: DataFrame, lines: DataFrame, layer: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Next (station, v) and (line, v): means over served lines and stations, walks, rides and interchanges."""
    serves, sv, lv = graph["serves"], stations.select("station", F.col("v").alias("sv")), lines.select("line", F.col("v").alias("lv"))
    to_line = mean_vectors(serves.join(sv, "station"), ["line"], "sv", width, "r0")
    to_station = mean_vectors(serves.join(lv, "line"), ["station"], "lv", width, "r0")
    walks = graph["transfers"].select(F.col("from_station").alias("station"), "to_station").join(sv, "station")
    walked = mean_vectors(walks.select(F.col("to_station").alias("station"), "sv"), ["station"], "sv", width, "r1")
    rides = graph["edge_features"].select(F.col("from_station").alias("station"), "to_station", "line", "features").join(sv, "station").join(lv, "line")
    message = F.transform("sv", lambda x, i: x * 0.5 + F.get("lv", i) * 0.25 + F.coalesce(F.get("features", i % F.size("features")), F.lit(0.0)) * 0.001)
    ridden = mean_vectors(rides.select(F.col("to_station").alias("station"), message.alias("m")), ["station"], "m", width, "r2")
    changes = graph["interchanges"].select("line", "other").join(lv, "line")
    changed = mean_vectors(changes.select(F.col("other").alias("line"), "lv"), ["line"], "lv", width, "r1")
    stations = stations.join(to_station, "station", "left").join(walked, "station", "left").join(ridden, "station", "left")
    lines = lines.join(to_line, "line", "left").join(changed, "line", "left")
    return (
        stations.select("station", _combined("v", {"r0": FROM_LINES, "r1": FROM_WALKS, "r2": FROM_RIDES}, layer).alias("v")),
        lines.select("line", _combined("v", {"r0": FROM_STATIONS, "r1": FROM_INTERCHANGES}, layer + 0.5).alias("v")),
    )


def city_vector(stations: DataFrame, lines: DataFrame, width: int) -> DataFrame:
    """One row (city): the mean of means and largest values, 0 at least, of station and line vectors."""
    pool = lambda df, name: pooled_vectors(df, [], "v", width, name)
    quarter = lambda i: sum((F.coalesce(F.get(c, i + k), F.lit(0.0)) for c in ("s", "l") for k in (0, width)), F.lit(0.0)) / 4
    both = pool(stations, "s").crossJoin(pool(lines, "l"))  # a row each
    return both.select(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), quarter).alias("city"))


def encode(graph: dict[str, DataFrame], width: int = 128, layers: int = 4, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """``stations`` (station, v), ``lines`` (line, v) and ``city`` (city, one row) of a graph.

    ``graph``: station_features, line_features, station_channels, line_channels, serves, transfers, edge_features,
    interchanges and line_patterns (see ``distinct_patterns``). A station or line without calls has zero channels.
    """
    scratch = scratch or Scratch(graph["line_features"].sparkSession, "encoder")

    def projected(kind: str, seed: int) -> DataFrame:
        rows = graph[f"{kind}_features"].join(graph[f"{kind}_channels"], kind, "left")
        rows = rows.select(kind, F.concat(F.transform("features", lambda x: x.cast("double")), channel_summary(F.col("channels"))).alias("x"))
        return scratch.table(rows.select(kind, feature_projection(width, seed)("x").alias("v")), kind)

    stations, lines = projected("station", STATION_SEED), projected("line", LINE_SEED)
    context = fold_patterns(graph["line_patterns"], stations, lines, graph["edge_features"], width)
    lines = lines.join(context, "line", "left").select("line", F.transform("v", lambda x, i: F.tanh(x + F.coalesce(F.get("context", i), F.lit(0.0)) * FROM_PATTERNS)).alias("v"))
    lines = scratch.table(lines, "line")
    for layer in range(layers):
        s, t = message_round(graph, stations, lines, layer, width)
        s, t = scratch.table(s, "station"), scratch.table(t, "line")
        scratch.drop(stations, lines)
        stations, lines = s, t
    return {"stations": stations, "lines": lines, "city": city_vector(stations, lines, width)}
