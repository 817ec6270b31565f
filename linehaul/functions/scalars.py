"""Scalar functions of the timetable model, as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
BIN_SECONDS, BINS = 900, 128


def clock_seconds(text: Column, short: bool = False) -> Column:
    """Seconds of ``H:MM:SS`` since the service day's midnight; hours are unbounded. Null if malformed.

    ``short`` also takes ``H:MM``.
    """
    parts = F.split(F.trim(text), ":")
    ok = F.forall(parts, lambda p: p.rlike(r"^\+?[0-9]+$"))
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    second = F.when(F.size(parts) == 3, number(2)).otherwise(F.lit(0))
    size = (F.size(parts) == 3) | (F.lit(short) & (F.size(parts) == 2))
    return F.when(size & ok & (number(1) < 60) & (second < 60), number(0) * 3600 + number(1) * 60 + second)


def clock_text(seconds: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(seconds / 3600)
    return F.concat_ws(":", F.when(hours < 10, F.concat(F.lit("0"), hours.cast("string"))).otherwise(hours.cast("string")), two(F.floor(seconds / 60) % 60), two(seconds % 60))


def gtfs_date(text: Column) -> Column:
    return F.try_to_date(F.trim(text), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.trim(text), "yyyyMMdd")


def service_day_bin(seconds: Column) -> Column:
    """The tumbling quarter-hour of a clock; the last bin takes all that is later."""
    return F.least(F.floor(seconds / BIN_SECONDS), F.lit(BINS - 1)).cast("int")


def mode_bucket(route_type: Column) -> Column:
    """0 tram, 1 underground and other guideways, 2 rail, 3 bus, 4 water, cable and the rest."""
    t = route_type
    return F.when(t.isin(0, 5), 0).when(t.isin(1, 6, 7, 12), 1).when((t == 2) | t.between(100, 199), 2).when(t.isin(3, 11), 3).otherwise(4)


#: Scope modes by route type; any other type is "other".
SCOPE_MODES = {"tram": (0, 5, 6, 7), "subway": (1,), "suburban_rail": (2, 12), "bus": (3,), "ferry": (4,), "trolleybus": (11,)}


def mode_matches(route_type: Column, wanted: str) -> Column:
    """Whether a route type (text; a missing or unreadable one is a bus) is of the wanted mode; rail takes suburban rail."""
    wanted, t = normalize_scope_mode(wanted), F.coalesce(route_type.try_cast("int"), F.lit(3))
    wanted = "suburban_rail" if wanted == "rail" else wanted
    if wanted == "other":
        return ~t.isin(*(v for types in SCOPE_MODES.values() for v in types))
    return t.isin(*SCOPE_MODES[wanted]) if wanted in SCOPE_MODES else F.lit(False)


def normalize_scope_mode(name: str) -> str:
    return name.strip().lower().replace("-", "_").replace(" ", "_")


def small_code(text: Column, most: int) -> Column:
    """An optional code: blank is 0, more than ``most`` or unreadable is null."""
    value = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0)).otherwise(F.trim(text).try_cast("int"))
    return F.when(value.between(0, most), value)


def normalize_name(name: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def haversine_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def bearing_radians(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.atan2(y, x)


def placed(lat: Column, lon: Column) -> Column:
    """Whether a station has coordinates: (0, 0) stands for none."""
    return ~((lat == 0) & (lon == 0))


def station_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.when(placed(lat1, lon1) & placed(lat2, lon2), haversine_metres(lat1, lon1, lat2, lon2))


def coordinate_or_zero(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def coordinate_cell(value: Column) -> Column:
    return F.floor(value * 1000).cast("long")


def name_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; equal names 1, else an empty one 0."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / most)


def point_in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray casting against a ring of (x, y)."""
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x2 - x1) * (y - y1) / F.lit(y2 - y1) + x1)
        inside = inside + F.when(crosses, 1).otherwise(0)
    return inside % 2 == 1


def near_ring_vertex(x: Column, y: Column, ring: list[tuple[float, float]], dx: Column | float, dy: float) -> Column:
    """Whether a vertex of the ring is within the box of half sides dx, dy."""
    out = F.lit(False)
    for vx, vy in ring:
        out = out | ((F.abs(x - vx) <= dx) & (F.abs(y - vy) <= dy))
    return out


def contains_stop(lat: Column, lon: Column, polygons: list[list[list[tuple[float, float]]]], buffer_km: float = 0.0) -> Column:
    """Whether a stop is in scope: has coordinates, and is in some polygon (outer ring less its holes) or near a vertex of it."""
    known = lat.isNotNull() & lon.isNotNull()
    if not polygons:
        return known
    out = F.lit(False)
    for outer, *holes in polygons:
        inside = point_in_ring(lon, lat, outer)
        for hole in holes:
            inside = inside & ~point_in_ring(lon, lat, hole)
        if buffer_km > 0:
            dy = buffer_km / 111.0
            dx = F.lit(dy) / F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.1))
            for ring in (outer, *holes):
                inside = inside | near_ring_vertex(lon, lat, ring, dx, dy)
        out = out | inside
    return known & F.coalesce(out, F.lit(False))


def in_peak(seconds: Column) -> Column:
    """07:00-10:59 and 16:00-19:59, of any day."""
    hour = F.floor(seconds / 3600) % 24
    return hour.between(7, 10) | hour.between(16, 19)


def normalized_time(seconds: Column) -> Column:
    return F.coalesce(seconds / (32 * 3600.0), F.lit(0.0))


def bounded(x: Column) -> Column:
    """x / (1 + |x|); 0 for what is not finite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x / (1 + F.abs(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of different lengths and zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def bounded_picks(v: Column, most: int = 256) -> Column:
    """The bounded values of a vector at a stride that leaves at least ``most`` of a longer one."""
    stride = F.greatest(F.floor(F.size(v) / most), F.lit(1)).cast("int")
    return F.transform(F.filter(v, lambda _, i: i % stride == 0), lambda x: bounded(x.cast("double")))


def vector_distance(a: Column, b: Column, most: int = 256) -> Column:
    """1 - cosine of the bounded values at a stride, in [0, 2]; 1 on a mismatch of lengths."""
    return F.when(F.size(a) != F.size(b), 1.0).otherwise(F.least(F.greatest(1 - cosine_similarity(bounded_picks(a, most), bounded_picks(b, most)), F.lit(0.0)), F.lit(2.0)))


def ratio(a: Column, b: Column) -> Column:
    """The larger of |a| / |b| and its inverse; 1 if either is next to nothing."""
    a, b, tiny = F.abs(a), F.abs(b), 2.0**-23
    return F.when((a <= tiny) | (b <= tiny), 1.0).otherwise(F.greatest(a / b, b / a))


TARGET_SCALES = (1.0, 1.0, 3600.0, 3600.0, 1.0, 1.0)


def normalize_targets(values: Column) -> Column:
    scales = F.array(*[F.lit(s) for s in TARGET_SCALES])
    return F.zip_with(values, scales, lambda v, s: v / s)


def denormalize_targets(values: Column) -> Column:
    scales = F.array(*[F.lit(s) for s in TARGET_SCALES])
    return F.zip_with(values, scales, lambda v, s: v * s)


def huber_loss(error: Column) -> Column:
    return F.when(F.abs(error) <= 1, 0.5 * error * error).otherwise(F.abs(error) - 0.5)


def huber_gradient(error: Column) -> Column:
    return F.greatest(F.least(error, F.lit(1.0)), F.lit(-1.0))


def summary(values: Column) -> Column:
    """[mean, max, min, population standard deviation] of an array; zeros for an empty one."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.when(n == 0, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(mean, F.array_max(values), F.array_min(values), F.sqrt(var)))


def network_system_id(source: Column, scope: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(source)), F.lower(F.trim(scope)))


#: Fixed values of the SplitMix64 generator.
_GAMMA, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1


def split_mix(seed: int, n: int) -> int:
    """Draw ``n`` (from 0) of the generator seeded with ``seed``; the state moves by a constant, so draws need no order."""
    z = (seed + (n + 1) * _GAMMA) & _MASK
    z = ((z ^ z >> 30) * _MIX1) & _MASK
    z = ((z ^ z >> 27) * _MIX2) & _MASK
    return z ^ z >> 31


def split_mix_unit(seed: Column, n: Column) -> Column:
    """Draws as doubles in [0, 1), vectorised over rows."""

    @F.pandas_udf("double")
    def draw(s: pd.Series, k: pd.Series) -> pd.Series:
        u = np.uint64
        z = s.to_numpy().astype(np.int64).view(u) + (k.to_numpy().astype(np.int64).view(u) + u(1)) * u(_GAMMA)
        z = (z ^ (z >> u(30))) * u(_MIX1)
        z = (z ^ (z >> u(27))) * u(_MIX2)
        return pd.Series(((z ^ (z >> u(31))) >> u(11)).astype(np.float64) / float(1 << 53))

    return draw(seed.cast("long"), n.cast("long"))


def profile_weights(profile: str = "default", overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of the similarity facets, summing to 1; ``weighted:a,b,c,d`` names them in order."""
    names = ("role", "service", "geometry", "resilience")
    weights = dict(zip(names, (0.4, 0.2, 0.15, 0.25), strict=True))
    if profile.startswith("weighted:"):
        values = [float(x) for x in profile.split(":", 1)[1].split(",")]
        if len(values) != 4 or any(not math.isfinite(v) or v < 0 for v in values):
            raise ValueError(f"not a similarity profile: {profile}")
        weights = dict(zip(names, values, strict=True))
    elif profile in names:
        weights = {n: float(n == profile) for n in names}
    elif profile not in ("default", "balanced"):
        raise ValueError(f"not a similarity profile: {profile}")
    weights |= overrides or {}
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("the weights of a profile must not all be zero")
    return {n: w / total for n, w in weights.items()}
