"""Station merging: candidate pairs by evidence, blocked by cell or name, and their components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.operators.components import connected_components
from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch

NEAR_M, FUZZY_M, ALIKE = 150.0, 90.0, 0.92


def _cells(stops: DataFrame, around: bool) -> DataFrame:
    cell = (S.coordinate_cell(F.col("lat")), S.coordinate_cell(F.col("lon")))
    if not around:
        return stops.withColumn("cell", F.struct(cell[0].alias("y"), cell[1].alias("x")))
    nine = F.explode(F.array(*[F.struct((cell[0] + dy).alias("y"), (cell[1] + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    return stops.withColumn("cell", nine)


PLACE = ["key", "lat", "lon"]


def _named(stops: DataFrame) -> DataFrame:
    return stops.where(S.placed(F.col("lat"), F.col("lon"))).withColumn("key", S.normalize_name(F.col("name")))


def _classes(stops: DataFrame) -> DataFrame:
    """Stops of one name at one place are one class, of which the comparison needs one row: its least and largest id."""
    return _named(stops).where("key <> ''").groupBy(*PLACE).agg(F.min("stop_id").alias("low"), F.max("stop_id").alias("high"))


def _pairs(classes: DataFrame, by_name: bool) -> DataFrame:
    """Pairs of classes whose cells touch, once each, with their distance: of one name (a class with itself too) or of two."""
    columns = [*PLACE, "low", "high"]
    a = _cells(classes, True).select("cell", *(F.col(c).alias(f"{c}_a") for c in columns))
    b = _cells(classes, False).select("cell", *(F.col(c).alias(f"{c}_b") for c in columns))
    place = lambda n: F.struct(f"lat_{n}", f"lon_{n}")
    once = (F.col("key_a") == F.col("key_b")) & (place("a") >= place("b")) if by_name else F.col("key_a") > F.col("key_b")
    metres = S.haversine_metres(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    # the size of a file says nothing of that of its classes, ninefold: no side is one to broadcast
    return a.hint("merge").join(b, "cell").where(once).withColumn("metres", metres)


def _exact(classes: DataFrame, metres: float) -> DataFrame:
    return _pairs(classes, True).where(F.col("metres") <= metres).withColumns({"kind": F.lit("exact_name"), "confidence": F.lit(0.98)})


def _fuzzy(classes: DataFrame, metres: float, alike: float) -> DataFrame:
    likeness = S.name_similarity(F.col("key_a"), F.col("key_b"))
    # names whose lengths are too far apart cannot be alike enough
    sizes = F.length("key_a"), F.length("key_b")
    found = _pairs(classes, False).where((F.least(*sizes) >= F.greatest(*sizes) * alike) & (F.col("metres") <= metres)).withColumn("likeness", likeness).where(F.col("likeness") >= alike)
    return found.withColumns({"kind": F.lit("fuzzy_name"), "confidence": F.col("likeness") * 0.9})


def _expanded(stops: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a > b of stops of pairs of classes: (a, b, kind, confidence)."""
    of = lambda n: _named(stops).select(*(F.col(c).alias(f"{c}_{n}") for c in PLACE), F.col("stop_id").alias(f"stop_{n}"))
    keys = lambda n: [f"{c}_{n}" for c in PLACE]
    both = pairs.select(*keys("a"), *keys("b"), "kind", "confidence").hint("merge").join(of("a"), keys("a")).hint("merge").join(of("b"), keys("b"))
    itself = (F.col("key_a") == F.col("key_b")) & (F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b"))
    both = both.where((F.col("stop_a") > F.col("stop_b")) | (~itself & (F.col("stop_a") < F.col("stop_b"))))
    return both.select(F.greatest("stop_a", "stop_b").alias("a"), F.least("stop_a", "stop_b").alias("b"), "kind", "confidence")


def exact_name_pairs(stops: DataFrame, metres: float = NEAR_M) -> DataFrame:
    """Stops of one normalised name within reach: (a, b, kind, confidence), all pairs, so as many as a name's stops squared."""
    return _expanded(stops, _exact(_classes(stops), metres))


def fuzzy_name_pairs(stops: DataFrame, metres: float = FUZZY_M, alike: float = ALIKE) -> DataFrame:
    """Stops of similar normalised names within reach, all pairs."""
    return _expanded(stops, _fuzzy(_classes(stops), metres, alike))


def name_links(stops: DataFrame, metres: float = NEAR_M, fuzzy_metres: float = FUZZY_M, alike: float = ALIKE) -> DataFrame:
    """Exact and fuzzy evidence in as few links as hold it together: (a, b, kind, confidence).

    Stops of a class are linked with its least one, classes by one pair of different stops. Components, and the least
    confidence in each, are those of all pairs, as all pairs of two classes have one confidence.
    """
    classes = Scratch(stops.sparkSession, "classes").table(_classes(stops), "classes")
    to_least = _named(stops).join(classes.select(*PLACE, F.col("low").alias("b")).hint("merge"), PLACE).where(F.col("stop_id") > F.col("b"))
    inside = to_least.select(F.col("stop_id").alias("a"), "b", F.lit("exact_name").alias("kind"), F.lit(0.98).alias("confidence"))
    between = _exact(classes, metres).where((F.col("lat_a") != F.col("lat_b")) | (F.col("lon_a") != F.col("lon_b"))).drop("metres").unionByName(_fuzzy(classes, fuzzy_metres, alike).drop("metres", "likeness"))
    ends = F.when(F.col("low_a") != F.col("high_b"), F.struct(F.col("low_a").alias("a"), F.col("high_b").alias("b"))).otherwise(F.struct(F.col("high_a").alias("a"), F.col("low_b").alias("b")))
    return inside.unionByName(between.select(ends.alias("e"), "kind", "confidence").select("e.a", "e.b", "kind", "confidence").where("a <> b"))


def link_pairs(stops: DataFrame, links: DataFrame, kind: str, confidence: float, metres: float | None = NEAR_M, same_name: bool = False) -> DataFrame:
    """Pairs that a table of links (a, b) names, if near enough and, where asked for, of one name."""
    side = lambda n: stops.select(F.col("stop_id").alias(n), F.col("lat").alias(f"lat_{n}"), F.col("lon").alias(f"lon_{n}"), S.normalize_name(F.col("name")).alias(f"key_{n}"))
    both = links.where("a <> b").join(side("a"), "a").join(side("b"), "b")
    if metres is not None:
        both = both.where(S.station_distance(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= metres)
    if same_name:
        both = both.where((F.col("key_a") == F.col("key_b")) & (F.col("key_a") != ""))
    return both.select("a", "b", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))


def merge_stations(stops: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations, stop_to_station) of stops (stop_id, name, lat, lon, location_type) joined by evidence (a, b, confidence).

    A station is a component; its place is the mean of its placed members, its name that of its preferred member
    (a station proper first, then by id), its confidence the least of all evidence that touches a member, 1 at most.
    Stations are numbered by their smallest member.
    """
    spark = stops.sparkSession
    component = connected_components(spark, evidence.select("a", "b"), "a", "b")
    of = stops.join(component.withColumnRenamed("node", "stop_id"), "stop_id", "left").withColumn("root", F.coalesce("component", "stop_id"))
    touching = evidence.select(F.col("a").alias("stop_id"), "confidence").union(evidence.select("b", "confidence")).groupBy("stop_id").agg(F.min("confidence").alias("confidence"))
    is_placed = S.placed(F.col("lat"), F.col("lon"))
    preferred = F.struct(F.when(F.col("location_type") == 1, 0).otherwise(1), F.col("stop_id"))
    groups = of.join(touching, "stop_id", "left").groupBy("root").agg(
        F.coalesce(F.avg(F.when(is_placed, F.col("lat"))), F.lit(0.0)).alias("lat"), F.coalesce(F.avg(F.when(is_placed, F.col("lon"))), F.lit(0.0)).alias("lon"),
        F.min_by("name", preferred).alias("name"), F.min_by("stop_id", preferred).alias("canonical_id"), F.count(F.lit(1)).alias("members"), F.least(F.lit(1.0), F.coalesce(F.min("confidence"), F.lit(1.0))).alias("merge_confidence"),
    )
    stations = numbered(groups, ["root"], "station", Scratch(spark, "stations")).withColumn("station", F.col("station").cast("int"))
    return stations, of.join(stations.select("root", "station"), "root").select("stop_id", "station")


def parent_closure(stops: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen stop ids with all their parents, in passes until none is new. Chains are as long as stations nest, one or two."""
    scratch = Scratch(stops.sparkSession, "parents")
    have = new = scratch.table(chosen.select("stop_id").distinct(), "have")
    while True:
        parents = stops.join(new, "stop_id", "left_semi").where("parent_station IS NOT NULL").select(F.col("parent_station").alias("stop_id")).distinct().join(stops.select("stop_id"), "stop_id", "left_semi")
        new = scratch.table(parents.join(have, "stop_id", "left_anti"), "new")
        if not new.limit(1).count():
            return have
        have = have.unionByName(new)
