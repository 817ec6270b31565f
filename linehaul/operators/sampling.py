"""Choosing origins: even spacing, farthest points, hubs and a seeded draw."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch


def evenly_spaced(df: DataFrame, order: list, most: int, scratch: Scratch | None = None) -> DataFrame:
    """At most ``most`` rows, those at places i * rows / most of the order."""
    scratch = scratch or Scratch(df.sparkSession, "spaced")
    rows = numbered(df, order, "_place", scratch)
    n = df.count()
    if n <= most:
        return rows.drop("_place")
    # row p is chosen if some i has floor(i * n / most) = p: the first i with i * n >= p * most
    i = F.ceil(F.col("_place") * most / F.lit(n))
    return rows.where((i < most) & (F.floor(i * n / F.lit(most)) == F.col("_place"))).drop("_place")


def farthest_points(points: DataFrame, k: int, first: int | None = None) -> list[tuple[int, float, float]]:
    """Greedy farthest-point sample of (id, lat, lon) by squared equirectangular distance; starts at ``first``, else the smallest id.

    A pick is one aggregate over all points: the largest of each point's least distance to the picks so far, of equals
    the smallest ``place`` where points have one, and the smallest id. ``k`` rows reach the driver.
    """
    place = [F.col("place")] if "place" in points.columns else []
    points = points.select("id", F.radians("lat").alias("y"), F.radians("lon").alias("x"), "lat", "lon", *place)
    picked: list[tuple[int, float, float]] = []
    gap = F.lit(0.0)
    while len(picked) < k:
        rest = points.where(~F.col("id").isin([c[0] for c in picked])) if picked else points if first is None else points.where(F.col("id") == first)
        best = rest.agg(F.min_by(F.struct("id", "lat", "lon", "y", "x"), F.struct(F.coalesce(-gap, F.lit(float("inf"))), *place, "id")).alias("p")).collect()[0]["p"]
        if best is None:
            break
        far = F.pow(F.col("y") - best["y"], 2) + F.pow((F.col("x") - best["x"]) * F.cos((F.col("y") + best["y"]) / 2), 2)
        gap = F.least(gap, far) if picked else far
        picked.append((best["id"], best["lat"], best["lon"]))
    return picked


def seeded_key(seed: int):
    """A function of (latitude, longitude in millionths of a degree, degree): a mixed 64-bit key, shifted to be ordered as a signed long."""

    @F.pandas_udf("long")
    def run(lat: pd.Series, lon: pd.Series, degree: pd.Series) -> pd.Series:
        u, turned = np.uint64, lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
        a, b, d = (x.to_numpy().astype(np.int64).view(u) for x in (lat, lon, degree))
        z = u(seed) ^ (a * u(0x9E3779B97F4A7C15)) ^ turned(b, 17) ^ turned(d, 31)
        z = (z ^ (z >> u(30))) * u(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> u(27))) * u(0x94D049BB133111EB)
        return pd.Series(((z ^ (z >> u(31))) ^ u(1 << 63)).view(np.int64))

    return run


def sample_origins(candidates: DataFrame, most: int, geographic: float = 0.5, hubs: float = 0.25, seed: int = 7) -> DataFrame:
    """``(id, rank)``: at most ``most`` of ``candidates`` (id, lat, lon, degree), by quotas; ranks from 1.

    First farthest points, which start at a seeded draw, then those of the largest degree, then a seeded draw, then what
    is missing by place: latitude, longitude in millionths and degree, of equals the id. Each part is a top of all
    candidates; what a part before has is not taken twice, nor made up for but by the last part. Quotas round halves
    up. No more candidates than wanted come all, by place. Candidates without finite coordinates are left out, and of
    one id the first by place stays.
    """
    spark = candidates.sparkSession
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    place = F.struct(F.round(F.col("lat") * 1e6).cast("long").alias("a"), F.round(F.col("lon") * 1e6).cast("long").alias("b"), F.col("degree"), F.col("id"))
    rows = candidates.where(finite("lat") & finite("lon")).groupBy("id").agg(F.min_by(F.struct("lat", "lon", "degree"), place).alias("c")).select("id", "c.*").withColumn("place", place)
    key = lambda s: seeded_key(s)("place.a", "place.b", "degree")
    rows = Scratch(spark, "origins").table(rows.withColumns({"start": key(seed ^ 0x9E3779B97F4A7C15), "draw": key(seed)}), "candidates")
    share = lambda x: math.floor(most * min(max(x, 0.0), 1.0) + 0.5)
    n = min(share(geographic), most)
    m = min(share(hubs), most - n)
    quotas = [(["place"], most)]
    parts = []
    if rows.limit(most + 1).count() > most:
        quotas = [([F.desc("degree"), "place"], m), (["draw", "place"], most - n - m), *quotas]
        first = rows.orderBy("start", "place").limit(1).collect()
        far = farthest_points(rows, n, first[0]["id"]) if n else []
        parts.append(spark.createDataFrame([(i, k) for k, (i, _, _) in enumerate(far)], "id long, k int").select("id", F.lit(0).alias("part"), "k"))
    for part, (order, count) in enumerate(quotas, 1):
        top = rows.orderBy(*order).limit(count).select("id", F.lit(part).alias("part"), F.row_number().over(_window(order)).alias("k"))
        parts.append(top)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # what is missing comes last: of the whole order by place all that no part has, as many as are wanted
    if len(quotas) > 1:
        taken = out.where("part < 3").select("id").distinct()
        more = rows.join(taken, "id", "left_anti").orderBy("place").limit(most).select("id", F.lit(3).alias("part"), F.row_number().over(_window(["place"])).alias("k"))
        out = out.where("part < 3").unionByName(more)
    first = out.groupBy("id").agg(F.min(F.struct("part", "k")).alias("by"))
    top = first.orderBy("by").limit(most)
    return top.select("id", F.row_number().over(_window(["by"])).alias("rank"))


def _window(order: list):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # over at most as many rows as origins are wanted
