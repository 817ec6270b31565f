"""Catalogue and event-log queries, with orders as runs and events as their log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linehaul.operators import catalog as C
from linehaul.operators import inventory as V
from linehaul.plans.network import rounded
from linehaul.sources import timetable as T

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("catalog_latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def catalog_latest_per_key(spark, sf_dir):
    return C.latest(T.table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("lineage_recursive", """
WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey >= 3),
r AS (SELECT c_custkey AS root, c_custkey AS node, 0 AS depth FROM customer UNION SELECT r.root, e.parent, r.depth + 1 FROM r JOIN e ON r.node = e.child)
SELECT root, node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1, 2""")
def lineage_recursive(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    edges = c.where("c_custkey >= 3").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    return C.lineage(edges, c.select(F.col("c_custkey").alias("node")))


@query("stale_leases", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'purchase' AND ts < TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 30 SECOND")
def stale_leases(spark, sf_dir):
    e = C.latest(T.table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    leases = e.select("user_id", "event_id", F.when(F.col("event_type") != "purchase", "running").otherwise("done").alias("status"), F.col("ts").alias("heartbeat"))
    return C.stale(leases, F.lit("2024-01-29 00:00:00").cast(T.table(spark, sf_dir, "events").schema["ts"].dataType)).select("user_id", "event_id")


@query("evaluations_union", """
SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS score, NULL AS brand FROM customer WHERE c_acctbal > 9000 UNION ALL
SELECT 'part', p_partkey, p_retailprice, p_brand FROM part WHERE p_size = 1""")
def evaluations_union(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    p = T.table(spark, sf_dir, "part").where("p_size = 1").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), F.col("p_brand").alias("brand"))
    return C.union_all(p, c)


@query("evaluation_join", """
SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'""")
def evaluation_join(spark, sf_dir):
    o, c, n = (T.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    known = c.where("c_acctbal > 0").select("c_custkey", "c_mktsegment", "c_nationkey")
    return o.where("o_orderstatus = 'F'").join(known, o["o_custkey"] == known["c_custkey"], "left").join(n, known["c_nationkey"] == n["n_nationkey"], "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("run_estimate", """
SELECT o_orderpriority AS workload, count(*) AS pending, round(max(b.price), 6) AS throughput, round(count(*) / max(b.price) * 1000, 6) AS eta_seconds FROM orders JOIN (
SELECT o_orderpriority AS w, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1) b ON b.w = o_orderpriority
WHERE o_orderstatus = 'O' GROUP BY 1""")
def run_estimate(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    bench = C.latest(o.where("o_orderstatus = 'F'"), ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderpriority", F.col("o_totalprice").alias("throughput"))
    pending = o.where("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority")).agg(F.count(F.lit(1)).alias("pending"))
    out = pending.join(bench, "o_orderpriority").select(F.col("o_orderpriority").alias("workload"), "pending", "throughput", (F.col("pending") / F.col("throughput") * 1000).alias("eta_seconds"))
    return rounded(out, "throughput", "eta_seconds")


@query("event_log_fold", """
SELECT user_id AS run, count(*) AS events, max(event_id) AS last_event, arg_max(event_type, (ts, event_id)) AS status, round(arg_max(value, (ts, event_id)) FILTER (event_type = 'view'), 6) AS progress,
max(ts) AS heartbeat, count(*) FILTER (event_type = 'purchase') AS checkpoints FROM events GROUP BY 1""")
def event_log_fold(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "ts", F.col("event_type").alias("type"), "value")
    return rounded(C.fold_events(e), "progress")


@query("metric_unpivot", """
SELECT p_partkey, metric, round(value, 6) AS value FROM (SELECT p_partkey, unnest(['size', 'price', 'per_unit']) AS metric, unnest([p_size::DOUBLE, p_retailprice, CASE WHEN p_size > 25 THEN p_retailprice / p_size END]) AS value FROM part) WHERE value IS NOT NULL""")
def metric_unpivot(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    m = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"), F.lit("per_unit"), F.when(F.col("p_size") > 25, F.col("p_retailprice") / F.col("p_size")))
    return rounded(C.flatten_metrics(p.withColumn("m", m), ["p_partkey"], "m"), "value")


@query("split_integrity", "SELECT c_nationkey AS system, count(DISTINCT CASE WHEN c_nationkey < 10 THEN 'train' WHEN c_custkey % 3 = 0 THEN 'validation' ELSE 'test' END) AS splits FROM customer GROUP BY 1 HAVING splits > 1")
def split_integrity(spark, sf_dir):
    split = F.when(F.col("c_nationkey") < 10, "train").when(F.col("c_custkey") % 3 == 0, "validation").otherwise("test")
    return C.split_integrity(T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("system"), split.alias("split")))


@query("dataset_examples", """
SELECT p_brand AS snapshot, p_partkey AS line, CASE WHEN p_brand < 'Brand#3' THEN 'train' WHEN p_brand < 'Brand#4' THEN 'validation' ELSE 'test' END AS split, round(p_retailprice / 3600.0::DOUBLE, 6) AS target,
round(1 / CAST(count(*) OVER (PARTITION BY p_brand) AS DOUBLE), 9) AS weight FROM part WHERE isfinite(p_retailprice)""")
def dataset_examples(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").where(~F.isnan("p_retailprice"))
    split = F.when(F.col("p_brand") < "Brand#3", "train").when(F.col("p_brand") < "Brand#4", "validation").otherwise("test")
    weight = F.round(1 / F.count(F.lit(1)).over(Window.partitionBy("p_brand")), 9)
    return p.select(F.col("p_brand").alias("snapshot"), F.col("p_partkey").alias("line"), split.alias("split"), F.round(F.col("p_retailprice") / 3600.0, 6).alias("target"), weight.alias("weight"))


@query("inventory_counts", "SELECT 'orders' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def inventory_counts(spark, sf_dir):
    return C.union_all(*[T.table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in (("orders", "orders"), ("parts", "part"), ("events", "events"))])


@query("json_alternate_keys", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k')) AS BIGINT) AS k FROM events")
def json_alternate_keys(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k")).cast("bigint").alias("k"))


@query("tumbling_15m", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_15m(spark, sf_dir):
    return T.table(spark, sf_dir, "events").groupBy(F.window("ts", "15 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("session_gap", """
SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_gap(spark, sf_dir):
    s = T.table(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", "start", "n")


_PARENTS = "SELECT p_partkey AS id, p_partkey // k AS parent, CASE WHEN p_size = 7 AND k = 3 THEN 'stale' ELSE md5(CAST(p_partkey // k AS VARCHAR)) END AS want FROM part, (VALUES (2), (3)) v(k) WHERE p_partkey // k > 0"


@query("admitted_artifacts", f"""
WITH RECURSIVE a AS (SELECT p_partkey AS id FROM part WHERE p_size <> 50), n AS ({_PARENTS}),
bad AS (SELECT id FROM n WHERE want = 'stale' OR parent NOT IN (SELECT id FROM a) UNION SELECT n.id FROM n JOIN bad ON n.parent = bad.id)
SELECT id FROM a WHERE id NOT IN (SELECT id FROM bad)""")
def admitted_artifacts(spark, sf_dir):
    """Parts as artifacts that need those of half and a third of their number; some are gone and some are named by a stale fingerprint."""
    p = T.table(spark, sf_dir, "part")
    mark = lambda c: F.md5(c.cast("string"))
    artifacts = p.where("p_size <> 50").select(F.col("p_partkey").alias("id"), mark(F.col("p_partkey")).alias("fingerprint"))
    parent = F.floor(F.col("p_partkey") / F.col("k"))
    needs = p.select("p_partkey", "p_size", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).where(parent > 0)
    needs = needs.select(F.col("p_partkey").alias("id"), parent.alias("parent"), F.when((F.col("p_size") == 7) & (F.col("k") == 3), F.lit("stale")).otherwise(mark(parent)).alias("fingerprint"))
    return V.admit(artifacts, needs).select("id")


@query("registered_models", """
WITH o AS (SELECT 'nation-' || c_nationkey AS requested, md5(c_mktsegment || c_nationkey % 7) AS fp, c_custkey AS created FROM customer),
e AS (SELECT 'nation-' || n_nationkey AS id, md5('old' || n_nationkey) AS fp, CAST(-n_nationkey AS BIGINT) AS created FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'kept', md5('BUILDING1'), -100),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY created, requested) AS k FROM o) WHERE k = 1 AND fp NOT IN (SELECT fp FROM e)),
g AS (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY created, fp) AS j FROM f)
SELECT CASE WHEN requested NOT IN (SELECT id FROM e) AND j = 1 THEN requested ELSE 'model-' || fp[1:16] END AS id, fp AS fingerprint, true AS is_new FROM g UNION ALL SELECT id, fp, false FROM e""")
def registered_models(spark, sf_dir):
    """Customers as offers of models: a nation asks for its name, a segment and nation make the content."""
    n = T.table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0")
    existing = n.select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.md5(F.concat(F.lit("old"), F.col("n_nationkey").cast("string"))).alias("fingerprint"), (-F.col("n_nationkey")).cast("bigint").alias("created"))
    existing = existing.unionByName(spark.range(1).select(F.lit("kept").alias("id"), F.md5(F.lit("BUILDING1")).alias("fingerprint"), F.lit(-100).cast("bigint").alias("created")))
    c = T.table(spark, sf_dir, "customer")
    offers = c.select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("requested"), F.md5(F.concat("c_mktsegment", (F.col("c_nationkey") % 7).cast("string"))).alias("fingerprint"), F.col("c_custkey").cast("bigint").alias("created"))
    return V.register_models(existing, offers).select("id", "fingerprint", "is_new")
