"""Facets of lines: service, geometry, role and resilience as feature rows, and their projections to unit vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.functions.scalars import summary
from linehaul.operators.encoder import matrix_product, mean_vectors, pooled_vectors, zeros

#: Fixed widths and seed steps of the projections.
WIDTHS = {"base": 192, "city": 128, "general": 64, "role": 48, "service": 32, "geometry": 32, "resilience": 32}
SEEDS = {"city": 1, "base": 11, "role": 17, "service": 23, "geometry": 29, "resilience": 31, "general": 37}
SEED = 73
#: Places of line features that geometry takes up, and of station features that role does (fixed by the format).
GEOMETRY_PICKS, STATION_PICKS = (5, 7, 8, 9, 15, 16, 17), (0, 1, 3, 4, 14, 15)
SEQUENCE_BINS, EDGE_WIDTH, LINE_WIDTH, CHANNEL_VALUES = 16, 7, 18, 512


def raw_facets(graph: dict[str, DataFrame], encoded: dict[str, DataFrame], width: int) -> DataFrame:
    """(line, service, geometry, role, resilience, base, city): feature rows of every line, a column each.

    Edges fall into 16 bins by their relative position and are meaned there; vectors of served stations and of lines
    to change to are pooled. All sums are aggregates by line, so that a line with most of the edges is no single task.
    """
    lines, edges = graph["line_features"], graph["edge_features"]
    at = lambda i: F.get("features", F.lit(i))
    place = F.least(F.greatest(F.coalesce(at(4), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    where = F.least(F.floor(place * SEQUENCE_BINS), F.lit(SEQUENCE_BINS - 1)).cast("int")
    bins = mean_vectors(edges.select("line", where.alias("bin"), "features"), ["line", "bin"], "features", EDGE_WIDTH, "mean")
    bins = bins.groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("bin", "mean"))).alias("bins"))
    sequence = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SEQUENCE_BINS - 1)), lambda b: F.coalesce(F.try_element_at("bins", b), zeros(EDGE_WIDTH))))
    sv, lv = encoded["stations"].select("station", F.col("v").alias("sv")), encoded["lines"].select("line", F.col("v").alias("lv"))
    stations = pooled_vectors(graph["serves"].join(sv, "station"), ["line"], "sv", width, "of_stations")
    other = graph["interchanges"].select("line", F.col("other").alias("with")).join(lv.withColumnRenamed("line", "with"), "with")
    changes = pooled_vectors(other, ["line"], "lv", width, "of_lines")
    into, out = (graph["interchanges"].groupBy(F.col(c).alias("line")).agg(F.count(F.lit(1)).cast("double").alias(n)) for c, n in (("other", "into"), ("line", "out")))
    # a summary of all picked station features of a line, summed without listing them
    picks = F.explode(F.array(*[at(i).cast("double") for i in STATION_PICKS])).alias("x")
    context = graph["serves"].join(graph["station_features"], "station").select("line", picks).groupBy("line").agg(F.array(F.avg("x"), F.max("x"), F.min("x"), F.stddev_pop("x")).alias("context"))
    rows = lines.join(graph["line_channels"], "line", "left")
    for part in (bins, stations, changes, context, out, into, lv):
        rows = rows.join(part, "line", "left")
    features = F.transform("features", lambda x: x.cast("double"))
    channels = F.coalesce("channels", F.array_repeat(zeros(CHANNEL_VALUES // 4), 4))
    one = lambda c: F.array(F.coalesce(c, F.lit(0.0)))
    rows = rows.select("line", F.col("lv"), features.alias("own"), F.concat(features, F.flatten(channels), F.flatten(F.transform(channels, summary))).alias("service"), F.concat(F.coalesce(sequence, zeros(SEQUENCE_BINS * EDGE_WIDTH)), F.array(*[at(i).cast("double") for i in GEOMETRY_PICKS])).alias("shape"), F.concat(F.coalesce("of_stations", zeros(2 * width)), F.coalesce("of_lines", zeros(2 * width)), F.coalesce("context", zeros(4)), one("out"), one("into")).alias("role"))
    rows = rows.select("*", F.concat("shape", summary(F.col("shape"))).alias("geometry"), F.concat("own", summary(F.col("role")), summary(F.col("service"))).alias("resilience"))
    both = rows.crossJoin(F.broadcast(encoded["city"]))  # the city is one row
    return both.select("line", "service", "geometry", "role", "resilience", F.concat("lv", "city", "service", "geometry", "role", "resilience").alias("base"), "city")


def facet_projection(name: str, width: int | None = None, seed: int = SEED):
    """A function of a feature row: its projection to the facet's width, of length 1."""
    step = (seed + SEEDS[name]) * 0.001 + 0.017

    def weights(i: np.ndarray, o: np.ndarray) -> np.ndarray:
        angle = (i + 1) * (o + 1) * step
        return np.sin(angle) + 0.5 * np.cos(angle * 0.61)

    return matrix_product(weights, width or WIDTHS[name], bounded=True, unit=True)


def project_facets(raw: DataFrame, widths: dict[str, int] | None = None, seed: int = SEED) -> DataFrame:
    """(line, base, general, role, service, geometry, resilience, city) from ``raw_facets``.

    Role and resilience see the projected base beside their own features, general sees all others.
    """
    widths = WIDTHS | (widths or {})
    at = lambda name, c: facet_projection(name, widths[name], seed)(c if isinstance(c, Column) else F.col(c))
    out = raw.select("line", *[at(c, c).alias(c) for c in ("base", "service", "geometry", "city")], F.col("role").alias("_role"), F.col("resilience").alias("_resilience"))
    out = out.select("*", at("role", F.concat("base", "_role")).alias("role"), at("resilience", F.concat("_resilience", "base")).alias("resilience"))
    out = out.select("*", at("general", F.concat("base", "role", "service", "geometry", "resilience")).alias("general"))
    return out.select("line", "base", "general", "role", "service", "geometry", "resilience", "city")
