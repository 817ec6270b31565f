"""Vector, feature and model-step queries, with embeddings as facets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.operators import cache as CA
from linehaul.operators import network as N
from linehaul.operators import sampling as SA
from linehaul.operators import search as R
from linehaul.plans.network import calls, pats, rounded
from linehaul.scratch import Scratch
from linehaul.sources import timetable as T
from linehaul.sources.timetable import with_sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _vectors(spark, sf_dir):
    return T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("v"), "label")


_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


@query("embedding_topk_cosine", f"""
WITH {_V}, q AS (SELECT id AS q_id, v AS qv FROM v WHERE id % 20 = 0), s AS (SELECT q_id, id, {_COS.format(a='qv', b='v')} AS sim FROM q JOIN v ON q_id <> id)
SELECT q_id, id, round(sim, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, CAST(id AS VARCHAR), id) AS r FROM s) WHERE r <= 5""")
def embedding_topk_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    out = R.top_cosine(v.where("id % 20 = 0").select(F.col("id").alias("q_id"), "v"), v, 5, {"v": 1.0})
    return rounded(out.select("q_id", "id", "similarity", "rank"), "similarity")


_FACETS = ("role", "service", "geometry", "resilience")


def _facets():
    return [F.slice("v", 16 * i + 1, 16).alias(n) for i, n in enumerate(_FACETS)]


@query("weighted_profile_topk", f"""
WITH {_V}, s AS (SELECT a.id AS q_id, b.id, {' + '.join(f"{w}::DOUBLE * " + _COS.format(a=f'a.v[{16 * i + 1}:{16 * i + 16}]', b=f'b.v[{16 * i + 1}:{16 * i + 16}]') for i, w in enumerate((0.4, 0.2, 0.15, 0.25)))} AS sim
FROM v a JOIN v b ON a.id % 20 = 0 AND a.id <> b.id AND a.label = b.label)
SELECT q_id, id, round(sim, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, CAST(id AS VARCHAR), id) AS r FROM s) WHERE r <= 5""")
def weighted_profile_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.where("id % 20 = 0").select(F.col("id").alias("q_id"), "label", *_facets())
    out = R.top_cosine(q, v.select("id", "name", "label", *_facets()), 5, S.profile_weights("default"), "label")
    return rounded(out.select("q_id", "id", "similarity", "rank"), "similarity")


@query("bounded_distance_triplets", f"""
WITH v AS (SELECT vec_id AS id, vec_id % 3 AS system, label AS identity, vec_id % 7 AS snapshot, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / (1 + abs(x))) AS v FROM embeddings),
d AS (SELECT a.id AS anchor, b.id, least(greatest(1 - {_COS.format(a='a.v', b='b.v')}, 0), 2) AS dist, CASE WHEN a.system = b.system AND a.identity = b.identity AND a.snapshot <> b.snapshot THEN 0 ELSE 1 END AS o FROM v a JOIN v b ON a.id <> b.id),
m AS (SELECT anchor, arg_min(id, (o, dist, id)) AS positive, arg_min(dist, (o, dist, id)) AS pd, arg_max(id, (dist, -id)) AS negative, arg_max(dist, (dist, -id)) AS nd FROM d GROUP BY anchor)
SELECT anchor, positive, negative, round(nd - pd, 6) AS gap FROM m WHERE nd >= pd + 0.001""")
def bounded_distance_triplets(spark, sf_dir):
    v = T.table(spark, sf_dir, "embeddings")
    items = v.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("system"), F.col("label").alias("identity"), (F.col("vec_id") % 7).alias("snapshot"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(R.triplets(items), "gap")


@query("centroid_cosine", f"""
WITH {_V}, c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM v) GROUP BY 1, 2) GROUP BY label)
SELECT id, round({_COS.format(a='v', b='c')}, 6) AS similarity FROM v JOIN c ON v.label = c.label""")
def centroid_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    c = R.collect_vector(R.centroid(v, ["label"], "v"), ["label"], "c")
    return v.join(c, "label").select("id", F.round(S.cosine_similarity(F.col("v"), F.col("c")), 6).alias("similarity"))


@query("vector_summary", f"""WITH {_V} SELECT id, round(list_avg(v), 6) AS mean, round(list_max(v), 6) AS most, round(list_min(v), 6) AS least, round(list_stddev_pop(v), 6) AS deviation FROM v""")
def vector_summary(spark, sf_dir):
    s = _vectors(spark, sf_dir).select("id", F.explode(F.array(S.summary(F.col("v")))).alias("s"))
    return s.select("id", *[F.round(F.get("s", F.lit(i)), 6).alias(n) for i, n in enumerate(("mean", "most", "least", "deviation"))])


@query("message_passing_mean", with_sql(f"""
SELECT b AS node, CAST(pos AS INT) AS pos, round(avg(x), 6) AS value FROM (SELECT DISTINCT a, b, line FROM seg) e
JOIN (SELECT CAST(vec_id % 25 AS INT) AS node, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) n ON n.node = e.a GROUP BY 1, 2"""))
def message_passing_mean(spark, sf_dir):
    nodes = T.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).cast("int").alias("node"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))  # vectors dealt to the stations
    edges = N.segments(calls(spark, sf_dir)).select(F.col("from_station").alias("src"), F.col("to_station").alias("dst"), "line").distinct()
    return rounded(R.message_mean(nodes, edges), "value")


@query("pattern_weighted_mean", with_sql("SELECT line, round(sum(n * t) / CAST(sum(t) AS DOUBLE), 6) AS mean FROM (SELECT line, pattern, max(n) AS n, count(*) AS t FROM pat GROUP BY 1, 2) GROUP BY line"))
def pattern_weighted_mean(spark, sf_dir):
    p = pats(spark, sf_dir).groupBy("line", "pattern").agg(F.max("calls").alias("n"), F.count(F.lit(1)).alias("t"))
    return rounded(R.weighted_mean(p, ["line"], "n", "t"), "mean")


@query("line_feature_vector", with_sql("""
SELECT line, feature, round(value, 6) AS value FROM (
SELECT line, unnest(['trips', 'patterns', 'stations', 'span', 'first']) AS feature, unnest([ln(trips + 1), ln(patterns + 1), ln(stations + 1), span / 115200.0::DOUBLE, first / 115200.0::DOUBLE]) AS value FROM (
SELECT c.line, trips, patterns, stations, greatest(last - first, 0) AS span, first FROM (SELECT line, count(DISTINCT station) AS stations, min(departure) AS first, max(arrival) AS last FROM calls GROUP BY line) c
JOIN (SELECT line, count(DISTINCT pattern) AS patterns, count(*) AS trips FROM pat GROUP BY line) p ON c.line = p.line))"""))
def line_feature_vector(spark, sf_dir):
    c = calls(spark, sf_dir)
    s = N.line_summary(c, N.signatures(c))
    values = F.create_map(*[x for n, v in (("trips", F.log1p("trips")), ("patterns", F.log1p("patterns")), ("stations", F.log1p("stations")), ("span", S.normalized_time(F.col("span"))), ("first", S.normalized_time(F.col("first_departure")))) for x in (F.lit(n), v)])
    return s.select("line", F.explode(values).alias("feature", "value")).select("line", "feature", F.round("value", 6).alias("value"))


@query("station_feature_vector", with_sql("""
SELECT s.station, round(coalesce((lat - mn) / greatest(mx - mn, 1e-12), 0), 6) AS lat, round((lon - nn) / greatest(nx - nn, 1e-12), 6) AS lon, round(ln(coalesce(n, 0) + 1), 6) AS calls, round(ln(coalesce(degree, 0) + 1), 6) AS degree
FROM st s CROSS JOIN (SELECT min(lat) AS mn, max(lat) AS mx, min(lon) AS nn, max(lon) AS nx FROM st) b LEFT JOIN (SELECT station, count(*) AS n FROM calls GROUP BY 1) c ON c.station = s.station
LEFT JOIN (SELECT from_station AS station, count(DISTINCT to_station) AS degree FROM (SELECT from_station, to_station FROM tf UNION ALL SELECT to_station, from_station FROM tf) GROUP BY 1) d ON d.station = s.station"""))
def station_feature_vector(spark, sf_dir):
    st = T.stations(spark, sf_dir)
    box = st.agg(*[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    unit = lambda c: F.round((F.col(c) - F.col(f"{c}_min")) / F.greatest(F.col(f"{c}_max") - F.col(f"{c}_min"), F.lit(1e-12)), 6).alias(c)
    both = st.crossJoin(box).join(N.station_summary(calls(spark, sf_dir)), "station", "left").join(N.transfer_degree(T.transfers(spark, sf_dir)), "station", "left")  # the box is one row
    scaled = lambda c: F.round(F.log1p(F.coalesce(c, F.lit(0))), 6)
    return both.select("station", unit("lat"), unit("lon"), scaled("daily_calls").alias("calls"), scaled("degree").alias("degree"))


@query("linear_baseline_step", """
WITH x AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS f, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS y FROM part)
SELECT round(avg(2 * (0.1::DOUBLE * f - y) * f), 6) AS gradient, round(avg(0.5 * (0.1::DOUBLE * f - y) * (0.1::DOUBLE * f - y)), 6) AS loss FROM x""")
def linear_baseline_step(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    m = p.agg(*[g(c).alias(f"{c}_{n}") for c in ("p_size", "p_retailprice") for n, g in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")
    error = 0.1 * z("p_size") - z("p_retailprice")
    return p.crossJoin(m).agg(F.round(F.avg(2 * error * z("p_size")), 6).alias("gradient"), F.round(F.avg(0.5 * error * error), 6).alias("loss"))  # the moments are one row


_G = 0x9E3779B97F4A7C15
_M = 1 << 64


@query("seeded_mask", f"""
WITH a AS (SELECT event_id, ((7 + (event_id::HUGEINT + 1) * {_G}::HUGEINT) % {_M}::HUGEINT)::UBIGINT AS z FROM events),
b AS (SELECT event_id, ((xor(z, z >> 30))::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT % {_M}::UHUGEINT)::UBIGINT AS z FROM a),
c AS (SELECT event_id, ((xor(z, z >> 27))::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT % {_M}::UHUGEINT)::UBIGINT AS z FROM b)
SELECT event_id, round((xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0, 9) AS draw, (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0 < 0.15 AS masked FROM c""")
def seeded_mask(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_id").withColumn("u", S.split_mix_unit(F.lit(7), F.col("event_id")))
    return e.select("event_id", F.round("u", 9).alias("draw"), (F.col("u") < 0.15).alias("masked"))


def farthest_sql(k: int) -> str:
    """Picks one after the other: g holds each station's least squared distance to the picks so far."""
    far = "power(radians(s.lat) - radians(c.lat), 2) + power((radians(s.lon) - radians(c.lon)) * cos((radians(s.lat) + radians(c.lat)) / 2), 2)"
    out = ", c0 AS (SELECT 0 AS rank, station, lat, lon FROM st ORDER BY station LIMIT 1), g0 AS (SELECT s.*, " + far + " AS gap FROM st s, c0 c)"
    for i in range(1, k):
        out += f", c{i} AS (SELECT {i} AS rank, station, lat, lon FROM g{i - 1} WHERE station NOT IN (SELECT station FROM " + ", ".join([]) + " UNION ALL SELECT station FROM ".join(f"c{x}" for x in range(i)) + f") ORDER BY gap DESC, station LIMIT 1)"
        out += f", g{i} AS (SELECT s.station, s.lat, s.lon, s.name, s.zone, least(s.gap, {far}) AS gap FROM g{i - 1} s, c{i} c)"
    marker = with_sql("SELECT 1 AS marker")
    return marker[: marker.rindex("SELECT 1 AS marker")].rstrip() + out + " " + " UNION ALL ".join(f"SELECT rank, station FROM c{i}" for i in range(k))


@query("farthest_point_origins", farthest_sql(6))
def farthest_point_origins(spark, sf_dir):
    chosen = SA.farthest_points(T.stations(spark, sf_dir).select(F.col("station").alias("id"), "lat", "lon"), 6)
    return spark.createDataFrame([(k, i) for k, (i, _, _) in enumerate(chosen)], "rank int, station int")


@query("top_hubs", with_sql("SELECT station, CAST(r AS INT) AS rank FROM (SELECT station, row_number() OVER (ORDER BY count(DISTINCT line) DESC, count(*) DESC, station) AS r FROM calls GROUP BY station) WHERE r <= 10"))
def top_hubs(spark, sf_dir):
    s = N.station_summary(calls(spark, sf_dir))
    rank = F.row_number().over(Window.orderBy(F.desc("lines"), F.desc("daily_calls"), "station"))
    return s.orderBy(F.desc("lines"), F.desc("daily_calls"), "station").limit(10).select("station", rank.alias("rank"))


@query("cached_vectors", "SELECT p_brand AS snapshot, p_partkey AS line, round(p_retailprice / 1000 + p_size, 6) AS value FROM part")
def cached_vectors(spark, sf_dir):
    """Brands as snapshots: their vectors are computed once, and again for those whose parts have changed."""
    cache = CA.VectorCache(spark, Scratch(spark, "cache").path("vectors"), "price-and-size")
    now = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("snapshot"), F.col("p_partkey").alias("line"), "p_size", "p_retailprice")
    before = now.withColumn("p_size", F.when(F.col("snapshot") == "Brand#11", F.col("p_size") + 1).otherwise(F.col("p_size")))
    for parts in (before, now):
        digests = CA.snapshot_digests({"part": parts})
        cache.refresh(digests, lambda some, df=parts: df.where(F.col("snapshot").isin(some)).select("snapshot", "line", F.round(F.col("p_retailprice") / 1000 + F.col("p_size"), 6).alias("value")))
    return cache.load(digests).select("snapshot", "line", "value")
