"""Routing, labels and ranking queries on the derived timetable."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linehaul.operators import batches as BA
from linehaul.operators import inference as I
from linehaul.operators import labels as L
from linehaul.operators import metrics as M
from linehaul.operators import network as N
from linehaul.operators import router as R
from linehaul.plans.network import calls, pats, rounded
from linehaul.scratch import Scratch
from linehaul.sources import timetable as T
from linehaul.sources.timetable import with_sql

QUERIES, ORACLES = {}, {}
CAP = 7200
#: (query_id, origin, departure)
STARTS = ((0, 0, 27000), (1, 5, 30000), (2, 12, 61200))


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def starts(spark, disabled=None, closed=None, scaled=None, multiplier=None):
    return spark.createDataFrame([(q, o, d, disabled, closed, scaled, multiplier) for q, o, d in STARTS], R.QUERY)


_VALUES = ", ".join(f"({q}, {o}, {d})" for q, o, d in STARTS)


def rounds_sql(rides: int, queries: str = f"SELECT * FROM (VALUES {_VALUES}) v(query_id, origin, start)", board: str = "true", walk: str = "true", alight: str = "true", origin: str = "true") -> str:
    """The rounds written out; ``calls`` is c, a query q."""
    out = f""", q AS ({queries}),
wc AS (SELECT from_station AS a, to_station AS b, seconds FROM tf WHERE {walk} UNION
       SELECT wc.a, tf.to_station, wc.seconds + tf.seconds FROM wc JOIN tf ON wc.b = tf.from_station WHERE {walk} AND tf.to_station <> wc.a AND wc.seconds + tf.seconds <= 2400),
w AS (SELECT a, b, min(seconds) AS seconds FROM wc WHERE a <> b GROUP BY a, b),
s0 AS (SELECT query_id, origin AS station, start AS arrival, start FROM q WHERE {origin})"""
    for k in range(rides + 1):
        if k:
            out += f""",
b{k} AS (SELECT r.query_id, q.start, c.trip_id, min(c.pos) AS board FROM r{k - 1} r JOIN q ON r.query_id = q.query_id JOIN calls c ON c.station = r.station AND c.departure >= r.arrival
        WHERE c.pickup <> 1 AND {board} GROUP BY 1, 2, 3),
s{k} AS (SELECT b.query_id, c.station, min(c.arrival) AS arrival, b.start FROM b{k} b JOIN calls c ON c.trip_id = b.trip_id AND c.pos > b.board
        WHERE c.drop_off <> 1 AND c.arrival BETWEEN b.start AND b.start + {CAP} AND {alight} GROUP BY 1, 2, 4)"""
        out += f""",
r{k} AS (SELECT query_id, station, min(arrival) AS arrival FROM (SELECT query_id, station, arrival FROM s{k} UNION ALL
        SELECT s.query_id, w.b, s.arrival + w.seconds FROM s{k} s JOIN w ON s.station = w.a WHERE s.arrival + w.seconds <= s.start + {CAP}) GROUP BY 1, 2)"""
    union = " UNION ALL ".join(f"SELECT *, {k} AS rides FROM r{k}" for k in range(rides + 1))
    return out + f""",
best AS (SELECT query_id, station, min((arrival, rides)) AS m FROM ({union}) GROUP BY 1, 2),
reached AS (SELECT query_id, station, m[1] AS arrival, greatest(m[2] - 1, 0) AS transfers FROM best)"""


def routed_sql(rides: int, **how) -> str:
    sql = with_sql("SELECT CAST(query_id AS BIGINT) AS query_id, station, CAST(arrival AS INT) AS arrival, CAST(transfers AS INT) AS transfers FROM reached")
    at = sql.rindex("SELECT CAST(query_id")
    return sql[:at] + rounds_sql(rides, **how).strip() + "\n" + sql[at:]


for _k in (1, 2, 3):

    @query(f"one_to_all_k{_k}", routed_sql(_k))
    def one_to_all(spark, sf_dir, rides=_k):
        return R.one_to_all(calls(spark, sf_dir), T.transfers(spark, sf_dir), starts(spark), rides, CAP)


@query("one_to_all_line_removed", routed_sql(2, board="c.line <> '1-URGENT'"))
def one_to_all_line_removed(spark, sf_dir):
    return R.one_to_all(calls(spark, sf_dir), T.transfers(spark, sf_dir), starts(spark, disabled=["1-URGENT"]), 2, CAP)


@query("one_to_all_station_closed", routed_sql(2, board="c.station <> 7", alight="c.station <> 7", walk="tf.from_station <> 7 AND tf.to_station <> 7", origin="origin <> 7"))
def one_to_all_station_closed(spark, sf_dir):
    return R.one_to_all(calls(spark, sf_dir), T.transfers(spark, sf_dir), starts(spark, closed=7), 2, CAP)


@query("one_to_all_half_frequency", routed_sql(2, board="""(c.line <> '2-HIGH' OR c.trip_id IN (SELECT trip_id FROM (SELECT trip_id, row_number() OVER (PARTITION BY pattern ORDER BY first_departure, trip_id) - 1 AS i,
 count(*) OVER (PARTITION BY pattern) AS t FROM pat) WHERE (i * greatest(CAST(floor(t * 0.5 + 0.5) AS BIGINT), 1)) % t < greatest(CAST(floor(t * 0.5 + 0.5) AS BIGINT), 1)))"""))
def one_to_all_half_frequency(spark, sf_dir):
    c = calls(spark, sf_dir)
    p = N.patterns(c).select("trip_id", "trip_rank", F.count(F.lit(1)).over(Window.partitionBy("pattern")).alias("pattern_trips"))
    return R.one_to_all(c.join(p, "trip_id"), T.transfers(spark, sf_dir), starts(spark, scaled="2-HIGH", multiplier=0.5), 2, CAP)


@query("walk_closure", with_sql("SELECT * FROM walks").replace("SELECT * FROM walks", """, wc AS (SELECT from_station AS a, to_station AS b, seconds FROM tf UNION
SELECT wc.a, tf.to_station, wc.seconds + tf.seconds FROM wc JOIN tf ON wc.b = tf.from_station WHERE tf.to_station <> wc.a AND wc.seconds + tf.seconds <= 2400)
SELECT a, b, CAST(min(seconds) AS INT) AS seconds FROM wc WHERE a <> b GROUP BY a, b"""))
def walk_closure(spark, sf_dir):
    return R.walk_closure(T.transfers(spark, sf_dir), 2400)


_REMOVED = f"SELECT CAST(hash((v.query_id, l.line)) % 1000000007 AS BIGINT) AS query_id, v.query_id AS base, l.line AS removed, origin, start FROM (VALUES {_VALUES}) v(query_id, origin, start) CROSS JOIN (SELECT DISTINCT line FROM calls) l"


def labels_sql() -> str:
    base = rounds_sql(2)
    hurt = rounds_sql(2, queries=_REMOVED, board="c.line <> q.removed")
    for name in ("wc", "best", "reached", "q", "w", *(f"{x}{k}" for x in "sbr" for k in range(3))):
        import re

        hurt = re.sub(rf"\b{name} AS \(", f"h_{name} AS (", hurt)
        hurt = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 h_{name} {name}", hurt)
    hurt = re.sub(r"(FROM|JOIN) h_([a-z0-9]+) ([a-z0-9]+) ([a-z]{1})\b(?! ON| JOIN| WHERE)", r"\1 h_\2 \4", hurt)
    for k in range(3):
        hurt = hurt.replace(f"h_r{k} r{k} r ", f"h_r{k} r ").replace(f"h_b{k} b{k} b ", f"h_b{k} b ").replace(f"h_s{k} s{k} s ", f"h_s{k} s ")
    thresholds = ", ".join(f"({t})" for t in L.THRESHOLDS)
    query = f"""
t AS (SELECT * FROM (VALUES {thresholds}) v(t)),
acc AS (SELECT h.removed, h.query_id, t.t, (SELECT count(*) FROM reached b WHERE b.query_id = h.base AND b.arrival - h.start <= t.t) AS n0,
               (SELECT count(*) FROM h_reached d WHERE d.query_id = h.query_id AND d.arrival - h.start <= t.t) AS n1 FROM h_q h CROSS JOIN t),
auc AS (SELECT removed, avg(l) AS accessibility_auc_loss, count(*) AS query_count FROM (SELECT removed, query_id, avg(greatest(n0 - n1, 0) / 25.0::DOUBLE) AS l FROM acc GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT h.removed, d.arrival, greatest(d.arrival - b.arrival, 0) AS delay, greatest(d.transfers - b.transfers, 0) AS extra
      FROM h_q h JOIN reached b ON b.query_id = h.base LEFT JOIN h_reached d ON d.query_id = h.query_id AND d.station = b.station)
SELECT auc.removed, round(accessibility_auc_loss, 6) AS accessibility_auc_loss, query_count,
       round(count(*) FILTER (z.arrival IS NULL) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS unreachable_share,
       round(coalesce(avg(delay) FILTER (z.arrival IS NOT NULL), 0), 6) AS mean_delay,
       round(coalesce(avg(extra) FILTER (z.arrival IS NOT NULL), 0), 6) AS mean_extra_transfers,
       CAST(list_sort(list(delay) FILTER (z.arrival IS NOT NULL))[CAST(ceil(0.95 * count(*) FILTER (z.arrival IS NOT NULL)) AS BIGINT)] AS INT) AS p95_delay
FROM auc JOIN z ON auc.removed = z.removed GROUP BY auc.removed, accessibility_auc_loss, query_count"""
    sql = with_sql("SELECT 1 AS marker")
    return sql[: sql.rindex("SELECT 1 AS marker")] + base.strip() + hurt + "," + query


@query("line_removal_labels", labels_sql())
def line_removal_labels(spark, sf_dir):
    scratch = Scratch(spark, "labels")
    c = scratch.table(calls(spark, sf_dir), "calls")
    q = starts(spark)
    walks = T.transfers(spark, sf_dir)
    removed = scratch.table(R.line_removals(q, c.select("line").distinct()), "removed")
    baseline = R.one_to_all(c, walks, q, 2, CAP, scratch)
    damaged = R.one_to_all(c, walks, removed.select("query_id", "origin", "departure", "disabled", "closed", "scaled", "multiplier"), 2, CAP, scratch)
    out = L.impact(scratch.table(baseline, "baseline"), scratch.table(damaged, "damaged"), removed.select("query_id", "base", "removed", "departure"), 25)
    return rounded(out, "accessibility_auc_loss", "unreachable_share", "mean_delay", "mean_extra_transfers")


@query("label_batch_resumed", labels_sql())
def label_batch_resumed(spark, sf_dir):
    """A batch that stops after a step of two lines and is taken up again."""
    scratch = Scratch(spark, "labels")
    c = scratch.table(calls(spark, sf_dir), "calls")
    lines, folder = c.select("line").distinct(), scratch.path("batch")
    batch = lambda: BA.LabelBatch(spark, folder, "orders", c, T.transfers(spark, sf_dir), starts(spark), 25, 2, CAP)
    batch().run(lines, step=2, most_steps=1)
    again = batch()
    again.run(lines)
    out = again.labels().drop("router_algorithm_version", "policy_fingerprint")
    return rounded(out, "accessibility_auc_loss", "unreachable_share", "mean_delay", "mean_extra_transfers")


@query("verify_top_lines", f"""
SELECT r.line, CAST(r.place AS BIGINT) AS place, round(predicted, 6) AS predicted, accessibility_auc_loss, unreachable_share FROM ({labels_sql()}) l JOIN (
{with_sql("SELECT line, predicted, row_number() OVER (ORDER BY predicted DESC, line) - 1 AS place FROM (SELECT line, count(DISTINCT trip_id) / 1000.0::DOUBLE AS predicted FROM calls GROUP BY line)")}) r ON r.line = l.removed WHERE place < 2""")
def verify_top_lines(spark, sf_dir):
    scratch = Scratch(spark, "verify")
    c = scratch.table(calls(spark, sf_dir), "calls")
    guess = c.where("pos = 0").groupBy("line").agg((F.count(F.lit(1)) / 1000.0).alias("predicted"))
    ranked = I.rank_by(guess.select("*", F.array("predicted").alias("metrics")), 0, scratch)
    out = BA.verify_top(ranked, 2, c, T.transfers(spark, sf_dir), starts(spark), 25, 2, CAP, scratch)
    return rounded(out.select("line", "place", "predicted", "accessibility_auc_loss", "unreachable_share"), "predicted", "accessibility_auc_loss", "unreachable_share")


@query("service_loss_share", with_sql("""
SELECT line, round(count(*) FILTER (lines = 1) / 25.0::DOUBLE, 6) AS service_loss_share
FROM (SELECT line, station, count(*) OVER (PARTITION BY station) AS lines FROM (SELECT DISTINCT line, station FROM calls)) GROUP BY line"""))
def service_loss_share(spark, sf_dir):
    return rounded(L.service_loss(calls(spark, sf_dir), 25), "service_loss_share")


def ranked(spark, sf_dir):
    """Rows to rank: parts by brand, price the target, size times price the prediction."""
    p = T.table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("snapshot"), F.col("p_partkey").alias("line"), (F.col("p_size") * 37 % 101).cast("double").alias("prediction"), (F.floor(F.col("p_retailprice") / 10) % 12).cast("double").alias("target"))


_RANKED = "x AS (SELECT p_brand AS snapshot, p_partkey AS line, CAST(p_size * 37 % 101 AS DOUBLE) AS prediction, CAST(CAST(floor(p_retailprice / 10) AS BIGINT) % 12 AS DOUBLE) AS target FROM part)"


@query("spearman_by_group", f"""
WITH {_RANKED}, r AS (SELECT snapshot, rank() OVER (PARTITION BY snapshot ORDER BY prediction) + (count(*) OVER (PARTITION BY snapshot, prediction) - 1) / 2.0::DOUBLE AS a,
rank() OVER (PARTITION BY snapshot ORDER BY target) + (count(*) OVER (PARTITION BY snapshot, target) - 1) / 2.0::DOUBLE AS b FROM x)
SELECT snapshot, CASE WHEN count(*) >= 2 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN round(corr(a, b), 6) END AS spearman FROM r GROUP BY snapshot""")
def spearman_by_group(spark, sf_dir):
    return rounded(M.spearman(ranked(spark, sf_dir), ["snapshot"], "prediction", "target"), "spearman")


@query("ndcg_at_k", f"""
WITH {_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY prediction DESC, line) - 1 AS p, row_number() OVER (PARTITION BY snapshot ORDER BY target DESC, line) - 1 AS t FROM x)
SELECT snapshot, CASE WHEN i > 0 THEN round(d / i, 6) ELSE 0 END AS ndcg FROM (SELECT snapshot, sum(CASE WHEN p < 10 THEN (power(2, greatest(target, 0)) - 1) / log2(p + 2.0::DOUBLE) ELSE 0 END) AS d,
sum(CASE WHEN t < 10 THEN (power(2, greatest(target, 0)) - 1) / log2(t + 2.0::DOUBLE) ELSE 0 END) AS i FROM r GROUP BY snapshot)""")
def ndcg_at_k(spark, sf_dir):
    return rounded(M.ndcg_at_k(ranked(spark, sf_dir), ["snapshot"], "prediction", "target", "line", 10), "ndcg")


@query("topk_recall", f"""
WITH {_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY prediction DESC, line) AS p, row_number() OVER (PARTITION BY snapshot ORDER BY target DESC, line) AS t FROM x)
SELECT snapshot, round(count(*) FILTER (p <= 10 AND t <= 10) / CAST(least(10, count(*)) AS DOUBLE), 6) AS recall FROM r GROUP BY snapshot""")
def topk_recall(spark, sf_dir):
    return rounded(M.top_k_recall(ranked(spark, sf_dir), ["snapshot"], "prediction", "target", "line", 10), "recall")


@query("pairwise_accuracy", f"""
WITH {_RANKED} SELECT a.snapshot, count(*) AS pairs, round(avg(CASE WHEN (a.target >= b.target) = (a.prediction >= b.prediction) THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS pairwise_accuracy
FROM x a JOIN x b ON a.snapshot = b.snapshot AND a.line < b.line GROUP BY a.snapshot""")
def pairwise_accuracy(spark, sf_dir):
    return rounded(M.pairwise_accuracy(ranked(spark, sf_dir), ["snapshot"], "prediction", "target", "line"), "pairwise_accuracy")


@query("cume_dist_percentiles", f"WITH {_RANKED} SELECT snapshot, line, round(cume_dist() OVER (PARTITION BY snapshot ORDER BY target), 6) AS percentile FROM x")
def cume_dist_percentiles(spark, sf_dir):
    return ranked(spark, sf_dir).select("snapshot", "line", F.round(M.cume_dist(["snapshot"], "target"), 6).alias("percentile"))


@query("midrank_percentiles", f"""WITH {_RANKED} SELECT snapshot, line, round(CASE WHEN count(*) OVER (PARTITION BY snapshot) <= 1 THEN 0.5::DOUBLE ELSE
(rank() OVER (PARTITION BY snapshot ORDER BY target) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY snapshot, target)) / count(*) OVER (PARTITION BY snapshot) END, 6) AS percentile FROM x""")
def midrank_percentiles(spark, sf_dir):
    return ranked(spark, sf_dir).select("snapshot", "line", F.round(M.midrank_percentile(["snapshot"], "target"), 6).alias("percentile"))


@query("standardized_features", f"""WITH {_RANKED} SELECT snapshot, line, round((prediction - avg(prediction) OVER w) / greatest(stddev_pop(prediction) OVER w, 1e-6), 6) AS prediction_std,
round((target - avg(target) OVER w) / greatest(stddev_pop(target) OVER w, 1e-6), 6) AS target_std FROM x WINDOW w AS (PARTITION BY snapshot)""")
def standardized_features(spark, sf_dir):
    out = M.standardized(ranked(spark, sf_dir), ["snapshot"], ["prediction", "target"])
    return rounded(out.select("snapshot", "line", "prediction_std", "target_std"), "prediction_std", "target_std")
