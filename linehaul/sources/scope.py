"""Scope files: a region, modes and a buffer, with boundaries read from GeoJSON of any nesting."""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.scratch import Scratch

#: Degrees of a cell of the join between stops and polygons.
CELL = 1.0
#: Geometry types that carry polygons, and those that carry others of these.
_KNOWN = ("FeatureCollection", "Feature", "Polygon", "MultiPolygon")


def read_document(spark: SparkSession, path: str) -> dict:
    """A JSON document, or a YAML one by its extension, from any file system that Spark reads."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if os.path.splitext(path)[1].lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as error:
            raise ValueError(f"{path}: YAML needs the yaml package; JSON is always read") from error
        return yaml.safe_load(text)
    return json.loads(text)


def polygon_rings(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """``(polygon, ring, points)`` of all polygons of a GeoJSON file: ring 0 is the outline, others are holes.

    Collections, features, polygons and multi-polygons are opened level by level, however deep they are; any other type,
    an object without one, a polygon without coordinates and a file without polygons are errors. Rings of fewer than
    three points are left out, and so are polygons without a ring. Null geometries have none.
    """
    scratch = scratch or Scratch(spark, "scope")
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"), F.lit("0").alias("at"))
    kind = F.try_variant_get("v", "$.type", "string")
    level, found = whole, None
    while True:
        level = scratch.table(level.select("at", F.to_json("v").alias("json"), kind.alias("kind")), "level")
        wrong = level.where(F.col("kind").isNull() | ~F.col("kind").isin(*_KNOWN)).select("kind").limit(1).collect()
        if wrong:
            raise ValueError(f"{path}: unsupported geometry type {wrong[0]['kind']}")
        v = level.select("at", "kind", F.parse_json("json").alias("v"))
        sheets = v.where("kind IN ('Polygon', 'MultiPolygon')").select("at", "kind", F.variant_get("v", "$.coordinates", "variant").alias("c"))
        if sheets.where("c IS NULL").limit(1).count():
            raise ValueError(f"{path}: a polygon without coordinates")
        rows = sheets.where("kind = 'Polygon'").select("at", F.array(F.col("c").cast("array<array<array<double>>>")).alias("p"))
        rows = rows.unionByName(sheets.where("kind = 'MultiPolygon'").select("at", F.col("c").cast("array<array<array<array<double>>>>").alias("p")))
        rows = rows.select("at", F.posexplode("p").alias("k", "rings")).select(F.concat_ws("/", "at", F.col("k").cast("string")).alias("polygon"), "rings")
        found = rows if found is None else found.unionByName(rows)
        held = v.where("kind = 'FeatureCollection'").select("at", F.variant_get("v", "$.features", "array<variant>").alias("f")).select("at", F.posexplode("f").alias("k", "v"))
        inner = v.where("kind = 'Feature'").select("at", F.lit(0).alias("k"), F.variant_get("v", "$.geometry", "variant").alias("v")).where("v IS NOT NULL AND NOT is_variant_null(v)")
        level = held.unionByName(inner).select("v", F.concat_ws("/", "at", F.col("k").cast("string")).alias("at"))
        if not level.limit(1).count():
            break
    points = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    rings = found.select("polygon", F.filter("rings", lambda r: F.size(r) >= 3).alias("rings")).select("polygon", F.posexplode("rings").alias("ring", "r")).select("polygon", "ring", points(F.col("r")).alias("points"))
    rings = scratch.table(rings, "rings")
    if rings.where(F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull())).limit(1).count():
        raise ValueError(f"{path}: a point without longitude or latitude")
    if not rings.limit(1).count():
        raise ValueError(f"{path} has no polygon")
    return rings


def _crossings(points, x, y):
    """Edges of a ring that a ray to the right of (x, y) crosses."""
    n = F.size(points)

    def crosses(p, i):
        q = F.get(points, (i + 1) % n)
        return F.when((p["y"] > y) != (q["y"] > y), F.when(x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"], 1).otherwise(0)).otherwise(0)

    return F.aggregate(F.transform(points, crosses), F.lit(0), lambda s, c: s + c)


def stops_inside(stops: DataFrame, rings: DataFrame, buffer_km: float = 0.0) -> DataFrame:
    """``stops`` (with lat and lon) that lie in a polygon and in none of its holes, or within the buffer of a vertex of it.

    Stops and polygons meet by cells of a degree, so that a stop is held against the polygons around it alone; AQE
    splits a crowded cell. A stop without coordinates is outside.
    """
    dy = buffer_km / 111.0
    box = rings.groupBy("polygon").agg(*[f(F.expr(f"array_{n}(transform(points, p -> p.{c}))")).alias(f"{c}{k}") for c in ("x", "y") for k, (n, f) in enumerate((("min", F.min), ("max", F.max)))])
    far = F.lit(dy) / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs("y0"), F.abs("y1")) + dy, F.lit(90.0)))), F.lit(0.1))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL)))
    around = box.select("polygon", cells(F.col("x0") - far, F.col("x1") + far).alias("cx"), F.col("y0"), F.col("y1")).select("polygon", "cx", cells(F.col("y0") - dy, F.col("y1") + dy).alias("cy"))
    parts = rings.groupBy("polygon").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("rings"))
    own = {c: f"_c{k}" for k, c in enumerate(stops.columns)}
    rows = stops.toDF(*own.values()).withColumns({"_lat": F.col(own["lat"]).cast("double"), "_lon": F.col(own["lon"]).cast("double"), "_id": F.expr("uuid()")})
    rows = Scratch(stops.sparkSession, "inside").table(rows, "stops")
    at = rows.where("_lat IS NOT NULL AND _lon IS NOT NULL").select("_id", "_lat", "_lon", F.floor(F.col("_lon") / CELL).alias("cx"), F.floor(F.col("_lat") / CELL).alias("cy"))
    both = at.join(around, ["cx", "cy"]).join(parts, "polygon")
    x, y = F.col("_lon"), F.col("_lat")
    within = F.transform("rings", lambda r: _crossings(r["points"], x, y) % 2 == 1)
    inside = F.get(within, F.lit(0)) & ~F.exists(F.slice(within, 2, F.greatest(F.size(within) - 1, F.lit(1))), lambda h: h)
    if buffer_km > 0:
        dx = F.lit(dy) / F.greatest(F.abs(F.cos(F.radians(y))), F.lit(0.1))
        inside = inside | F.exists("rings", lambda r: F.exists(r["points"], lambda p: (F.abs(p["x"] - x) <= dx) & (F.abs(p["y"] - y) <= dy)))
    hit = both.where(inside).select("_id").distinct()
    return rows.join(hit, "_id", "left_semi").select(*[F.col(o).alias(c) for c, o in own.items()])


@dataclass
class ScopeDefinition:
    """A scope file: name, modes, buffer in kilometres, least stops inside, and the rings of its boundary if it has one."""

    name: str
    modes: list[str] = field(default_factory=list)
    buffer_km: float = 0.0
    minimum_stops_inside: int = 1
    rings: DataFrame | None = None


def read_scope(spark: SparkSession, path: str) -> ScopeDefinition:
    """A scope from a JSON or YAML file; a relative ``boundary`` lies beside it.

    Without a name the file's stem stands for it. A negative or infinite buffer is an error; less than one stop inside
    means one. Modes are trimmed, lower-cased and joined by underscores; empty ones go.
    """
    d = read_document(spark, path)
    name, buffer = (d.get("name") or "").strip() or os.path.splitext(os.path.basename(path))[0], float(d.get("buffer_km") or 0.0)
    if math.copysign(1.0, buffer) < 0 or not math.isfinite(buffer):
        raise ValueError(f"{path}: buffer_km must be finite and not negative")
    modes = [m.strip().lower().replace("-", "_").replace(" ", "_") for m in d.get("modes") or []]
    boundary = d.get("boundary")
    if boundary and not (boundary.startswith("/") or "://" in boundary):
        boundary = f"{os.path.dirname(path)}/{boundary}"
    rings = polygon_rings(spark, boundary) if boundary else None
    return ScopeDefinition(name, [m for m in modes if m], buffer, max(int(d.get("minimum_stops_inside") or 1), 1), rings)


def apply_scope(feed, definition: ScopeDefinition) -> dict[str, DataFrame]:
    """The tables of a feed cut to a scope: see ``calendar.scope``. Without a boundary every stop with coordinates is inside."""
    from linehaul.functions.scalars import mode_matches
    from linehaul.operators.calendar import scope

    stops = feed.stops.withColumns({"lat": F.col("stop_lat").try_cast("double"), "lon": F.col("stop_lon").try_cast("double")})
    inside = stops.where("lat IS NOT NULL AND lon IS NOT NULL") if definition.rings is None else stops_inside(stops, definition.rings, definition.buffer_km)
    route_ok = F.lit(True)
    if definition.modes:
        route_ok = F.lit(False)
        for m in definition.modes:
            route_ok = route_ok | mode_matches(F.col("route_type"), m)
    return scope(feed.stops, feed.routes, feed.trips, feed.stop_times, inside, route_ok, definition.minimum_stops_inside)
