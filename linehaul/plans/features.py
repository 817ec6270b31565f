"""Graph feature and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linehaul.operators import baselines as B
from linehaul.operators import graph as G
from linehaul.operators import network as N
from linehaul.plans.encoder import features_sql
from linehaul.plans.network import _HAVERSINE, calls
from linehaul.plans.routing import _RANKED, ranked
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


def _named(df, keys, names):
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), "features")
    return df.select(*keys, F.explode(pairs).alias("feature", "value")).select(*keys, "feature", F.round("value", 6).alias("value"))


def _modes(spark, sf_dir):
    return T.stop_times(spark, sf_dir).select("line").distinct().withColumn("bucket", F.substring("line", 1, 1).cast("int") - 1)


@query("graph_line_features", features_sql("lnf", "line", G.LINE_FEATURES))
def graph_line_features(spark, sf_dir):
    stats = G.line_statistics(calls(spark, sf_dir), T.stations(spark, sf_dir), _modes(spark, sf_dir))
    return _named(G.line_features(stats), ["line"], G.LINE_FEATURES)


@query("graph_station_features", features_sql("stf", "station", G.STATION_FEATURES))
def graph_station_features(spark, sf_dir):
    c, st = calls(spark, sf_dir), T.stations(spark, sf_dir)
    platforms = T.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("station")).agg(F.count(F.lit(1)).alias("platform_count"))
    return _named(G.station_features(st, c, N.patterns(c), _modes(spark, sf_dir), T.transfers(spark, sf_dir), platforms), ["station"], G.STATION_FEATURES)


@query("graph_edge_features", with_sql(f"""
SELECT e.a AS from_station, e.b AS to_station, e.line, round({_HAVERSINE.format('x.lat', 'y.lat', 'x.lon', 'y.lon')} / 10000, 6) AS distance, round(median / 3600.0::DOUBLE, 6) AS median, round(least / 3600.0::DOUBLE, 6) AS least, round(ln(trips + 1), 6) AS trips
FROM edge e JOIN st x ON x.station = e.a JOIN st y ON y.station = e.b"""))
def graph_edge_features(spark, sf_dir):
    scratch = Scratch(spark, "edges")
    trips = scratch.table(N.whole_trips(calls(spark, sf_dir)), "trips")
    pats = N.numbered_patterns(N.trip_signatures(trips), scratch)
    f = G.edge_features(N.transit_edges(N.trip_segments(trips)), N.pattern_edge_positions(pats), T.stations(spark, sf_dir))
    return f.select(*N.EDGE, *[F.round(F.get("features", F.lit(i)), 6).alias(n) for i, n in enumerate(("distance", "median", "least", "trips"))])


@query("line_temporal", with_sql("""
SELECT d.line, d.bin, departures, coalesce(arrivals, 0) AS arrivals, partners, trips FROM (SELECT line, CAST(least(departure // 900, 127) AS INT) AS bin, count(*) AS departures, count(DISTINCT station) AS partners, count(DISTINCT trip_id) AS trips FROM calls GROUP BY 1, 2) d
LEFT JOIN (SELECT line, CAST(least(arrival // 900, 127) AS INT) AS bin, count(*) AS arrivals FROM calls GROUP BY 1, 2) a ON a.line = d.line AND a.bin = d.bin
UNION ALL SELECT a.line, a.bin, 0, arrivals, 0, 0 FROM (SELECT line, CAST(least(arrival // 900, 127) AS INT) AS bin, count(*) AS arrivals FROM calls GROUP BY 1, 2) a
ANTI JOIN (SELECT DISTINCT line, CAST(least(departure // 900, 127) AS INT) AS bin FROM calls) d ON a.line = d.line AND a.bin = d.bin"""))
def line_temporal(spark, sf_dir):
    return G.temporal(calls(spark, sf_dir), "line").select("line", "bin", "departures", "arrivals", "partners", "trips")


@query("evaluation_metrics", f"""
WITH {_RANKED}, p AS (SELECT count(*) AS n, avg(CASE WHEN (a.target >= b.target) = (a.prediction >= b.prediction) THEN 1.0 ELSE 0.0 END::DOUBLE) AS v FROM x a JOIN x b ON a.snapshot = b.snapshot AND a.line < b.line),
r AS (SELECT snapshot, rank() OVER (PARTITION BY snapshot ORDER BY prediction) + (count(*) OVER (PARTITION BY snapshot, prediction) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY snapshot ORDER BY target) + (count(*) OVER (PARTITION BY snapshot, target) - 1) / 2.0::DOUBLE AS b,
row_number() OVER (PARTITION BY snapshot ORDER BY prediction DESC, line) AS i, row_number() OVER (PARTITION BY snapshot ORDER BY target DESC, line) AS j FROM x),
s AS (SELECT snapshot, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS c, count(*) FILTER (i <= 10 AND j <= 10) / CAST(least(10, count(*)) AS DOUBLE) AS o FROM r GROUP BY snapshot)
SELECT 'prediction' AS baseline, CAST((SELECT count(*) FROM x) AS BIGINT) AS examples, count(*) AS snapshots, round(avg(c), 6) AS spearman, round((SELECT v FROM p), 6) AS pairwise_accuracy, round(avg(o), 6) AS top_k_overlap FROM s""")
def evaluation_metrics(spark, sf_dir):
    out = B.evaluate(ranked(spark, sf_dir), ["prediction"], "target", 10)
    return out.select("baseline", "examples", "snapshots", *[F.round(c, 6).alias(c) for c in ("spearman", "pairwise_accuracy", "top_k_overlap")])


_FIT = """
d AS (SELECT p_brand AS snapshot, p_partkey AS line, CASE WHEN p_brand < 'Brand#3' THEN 'train' ELSE 'test' END AS split, CAST(CAST(floor(p_retailprice / 10) AS BIGINT) % 12 AS DOUBLE) AS t, CAST(p_size * 37 % 101 AS DOUBLE) AS gnn, CAST(p_size AS DOUBLE) AS a, p_retailprice / 100 AS b FROM part),
m AS (SELECT avg(a) AS ma, greatest(stddev_pop(a), 1e-6) AS sa, avg(b) AS mb, greatest(stddev_pop(b), 1e-6) AS sb, avg(t) AS mt FROM d WHERE split = 'train'),
q AS (SELECT avg((a - ma) / sa * (a - ma) / sa) AS aa, avg((a - ma) / sa * (b - mb) / sb) AS ab, avg((b - mb) / sb * (b - mb) / sb) AS bb, avg((a - ma) / sa * t) AS ya, avg((b - mb) / sb * t) AS yb FROM d CROSS JOIN m WHERE split = 'train'),
w AS (SELECT list_reduce(list_transform(range(250), lambda i: [0, 0]::DOUBLE[]), lambda s, x: [s[1] - 0.01::DOUBLE * (aa * s[1] + ab * s[2] - ya), s[2] - 0.01::DOUBLE * (ab * s[1] + bb * s[2] - yb)], [0, 0]::DOUBLE[]) AS w FROM q),
h AS (SELECT *, list_reduce(list_transform(range(1, length(snapshot) + 1), lambda i: CAST(unicode(snapshot[i]) AS UHUGEINT)), lambda v, c: (xor(v, c) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT * 8192::UHUGEINT) % 18446744073709551616::UHUGEINT + (xor(v, c) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT) // 2251799813685248::UHUGEINT,
      xor(7::UHUGEINT, CAST(line AS UHUGEINT) * 11400714819323198485::UHUGEINT % 18446744073709551616::UHUGEINT)) AS z FROM d),
s AS (SELECT snapshot, line, t, unnest(['gnn', 'engineered-linear', 'frequency', 'handcrafted-cosine', 'random']) AS baseline, unnest([gnn, mt + w[1] * (a - ma) / sa + w[2] * (b - mb) / sb, a, (a * ma + b * mb) / (sqrt(a * a + b * b) * sqrt(ma * ma + mb * mb)),
      CAST(xor(z, z // 536870912::UHUGEINT) AS DOUBLE) / 18446744073709551615.0::DOUBLE]) AS p FROM h CROSS JOIN m CROSS JOIN w WHERE split = 'test'),
x AS (SELECT baseline, avg(CASE WHEN (u.t >= v.t) = (u.p >= v.p) THEN 1.0 ELSE 0.0 END::DOUBLE) AS acc FROM s u JOIN s v USING (baseline, snapshot) WHERE u.line < v.line GROUP BY baseline),
r AS (SELECT baseline, snapshot, rank() OVER (PARTITION BY baseline, snapshot ORDER BY p) + (count(*) OVER (PARTITION BY baseline, snapshot, p) - 1) / 2.0::DOUBLE AS i, rank() OVER (PARTITION BY baseline, snapshot ORDER BY t) + (count(*) OVER (PARTITION BY baseline, snapshot, t) - 1) / 2.0::DOUBLE AS j,
      row_number() OVER (PARTITION BY baseline, snapshot ORDER BY p DESC, line) AS k, row_number() OVER (PARTITION BY baseline, snapshot ORDER BY t DESC, line) AS l FROM s),
c AS (SELECT baseline, snapshot, count(*) AS n, CASE WHEN var_pop(i) > 0 AND var_pop(j) > 0 THEN corr(i, j) END AS c, count(*) FILTER (k <= 10 AND l <= 10) / CAST(least(10, count(*)) AS DOUBLE) AS o FROM r GROUP BY 1, 2)
SELECT c.baseline, CAST(sum(n) AS BIGINT) AS examples, count(*) AS snapshots, round(avg(c), 6) AS spearman, round(any_value(acc), 6) AS pairwise_accuracy, round(avg(o), 6) AS top_k_overlap, 'ok' AS status FROM c JOIN x ON x.baseline = c.baseline GROUP BY c.baseline"""


@query("evaluation_report", f"WITH {_FIT.strip()}")
def evaluation_report(spark, sf_dir):
    """Parts as lines of brands: the model's score against baselines that are fitted to other brands."""
    p = ranked(spark, sf_dir).join(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.col("p_size").alias("a"), (F.col("p_retailprice") / 100).alias("b")), "line")
    p = p.withColumn("split", F.when(F.col("snapshot") < "Brand#3", "train").otherwise("test"))
    out = B.evaluation_report(p, ["a", "b"], "prediction", "a", "target", "test")
    return out.withColumns({c: F.round(c, 6) for c in ("spearman", "pairwise_accuracy", "top_k_overlap")})
