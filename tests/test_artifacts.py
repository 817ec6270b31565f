import json

import pytest
from pyspark.sql import functions as F

from linehaul.operators import baselines as B
from linehaul.operators import catalog as C
from linehaul.operators import labels as L
from linehaul.operators import search as R
from linehaul.sources import artifacts as A


def test_snapshot_round_trip(spark, tmp_path):
    t = {"stations": spark.range(3), "lines": spark.range(2)}
    i = A.save_snapshot(t, str(tmp_path), {"b": 1, "a": "x"})
    assert i == A.save_snapshot(t, str(tmp_path), {"a": "x", "b": 1})
    assert {k: v.count() for k, v in A.load_snapshot(spark, str(tmp_path), i).items()} == {"stations": 3, "lines": 2}


def test_splits_are_kept_apart(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", 1.0), ("b", "validation", 2.0), ("c", "test", 3.0)], "system string, split string, target double")
    A.save_dataset(rows, str(tmp_path / "d"))
    for f in (tmp_path / "d" / "split=test").iterdir():  # the loader must not open it
        f.write_bytes(b"junk") if f.suffix == ".parquet" else f.unlink()
    assert A.load_split(spark, str(tmp_path / "d"), "train").collect()[0]["target"] == 1.0
    with pytest.raises(ValueError):
        A.save_dataset(rows.unionByName(rows.withColumn("split", F.lit("test"))), str(tmp_path / "e"))


def test_manifests_and_results(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.bin").write_bytes(b"abc")
    found = A.file_digests(spark, str(tmp_path / "x"))
    assert A.verify(found, found).count() == 0
    assert A.verify(found.withColumn("sha256", F.lit("0")), found).count() == 1
    A.write_json_once(str(tmp_path / "r.json"), {"a": 1})
    A.write_json_once(str(tmp_path / "r.json"), {"a": 1})
    with pytest.raises(FileExistsError):
        A.write_json_once(str(tmp_path / "r.json"), {"a": 2})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}
    assert A.safe_relative("a/b.json") and not A.safe_relative("../b") and not A.safe_relative("/b")
    assert A.fingerprint("n", {"b": 1, "a": 2}) == A.fingerprint("n", {"a": 2, "b": 1})


def test_lineage_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 1)], "child int, parent int")
    got = {(r["node"], r["depth"]) for r in C.lineage(e, spark.createDataFrame([(5,)], "node int")).collect()}
    assert got == {(5, 0), (1, 1), (2, 2), (3, 3)}


def test_linear_baseline_learns(spark):
    rows = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2 + 1).cast("double").alias("y"))
    scale, w, b = B.fit_linear(rows, ["x"], "y", iterations=400)
    error = rows.select(F.max(F.abs(B.linear_score(scale, w, b) - F.col("y"))).alias("e")).collect()[0]["e"]
    assert error < 0.5


def test_impact_counts_lost_destinations(spark):
    schema = "query_id long, station int, arrival int, transfers int"
    base = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 600, 0), (1, 2, 1200, 0)], schema)
    hurt = spark.createDataFrame([(10, 0, 0, 0), (10, 1, 1000, 1)], schema)
    pairs = spark.createDataFrame([(10, 1, "L", 0)], "query_id long, base long, removed string, departure int")
    r = L.impact(base, hurt, pairs, 3).collect()[0]
    assert r["unreachable_share"] == pytest.approx(1 / 3) and r["mean_delay"] == 200 and r["p95_delay"] == 400 and r["mean_extra_transfers"] == 0.5


def origins_by_rule(rows, most, far, hub, seed):
    """The quotas one after another: halves round up, a draw starts the farthest points, the rest comes by place."""
    import math

    mask = (1 << 64) - 1
    place = lambda c: (math.floor(c[1] * 1e6 + 0.5), math.floor(c[2] * 1e6 + 0.5), c[3], c[0])

    def key(s, c):
        a, b, d, _ = place(c)
        turn = lambda x, n: (x << n | x >> 64 - n) & mask
        z = s ^ a * 0x9E3779B97F4A7C15 & mask ^ turn(b, 17) ^ turn(d, 31)
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31

    one = {}
    for c in sorted((c for c in rows if c[1] is not None and c[2] is not None), key=place):
        one.setdefault(c[0], c)
    all_ = list(one.values())
    if len(all_) <= most:
        return [c[0] for c in all_]
    n = min(math.floor(most * far + 0.5), most)
    m = min(math.floor(most * hub + 0.5), most - n)
    gap = lambda x, y: math.radians(x[1] - y[1]) ** 2 + (math.radians(x[2] - y[2]) * math.cos(math.radians(x[1] + y[1]) / 2)) ** 2
    picks = [min(all_, key=lambda c: key(seed ^ 0x9E3779B97F4A7C15, c))][:n]
    while len(picks) < n:
        picks.append(max((c for c in all_ if c not in picks), key=lambda c: (min(gap(c, p) for p in picks), [-x for x in place(c)])))
    order = [*picks, *sorted(all_, key=lambda c: (-c[3], place(c)))[:m], *sorted(all_, key=lambda c: key(seed, c))[: most - n - m], *all_]
    return list(dict.fromkeys(c[0] for c in order))[:most]


def test_farthest_points(spark):
    from linehaul.operators.sampling import evenly_spaced, farthest_points, sample_origins

    df = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double, degree int")
    rows = [(1, 0.0, 0.0, 0), (2, 0.0, 0.1, 4), (3, 0.0, 5.0, 2), (4, 0.1, 0.1, 0), (11, 1.0, 1.0, 9), (11, 2.0, 2.0, 9), (12, None, 1.0, 50)]
    assert [i for i, _, _ in farthest_points(df(rows), 2)] == [1, 3] and farthest_points(df([]), 3) == []
    assert [i for i, _, _ in farthest_points(df(rows), 2, 3)] == [3, 1]
    for most, far, hub, seed in ((3, 0.34, 0.34, 7), (2, 0.5, 0.25, 1), (4, 0.5, 0.25, 9), (1, 1.0, 0.0, 3), (3, 0.0, 0.0, 4), (4, 0.0, 1.0, 5)):
        got = [r["id"] for r in sample_origins(df(rows), most, far, hub, seed).orderBy("rank").collect()]
        assert got == origins_by_rule(rows, most, far, hub, seed)
    assert sorted(r["id"] for r in sample_origins(df(rows), 20).collect()) == [1, 2, 3, 4, 11]
    many = spark.range(10).withColumnRenamed("id", "k")
    assert sorted(r["k"] for r in evenly_spaced(many, ["k"], 4).collect()) == [0, 2, 5, 7] and evenly_spaced(many, ["k"], 30).count() == 10


def test_triplets_equal_all_pairs(spark):
    import random

    import numpy as np

    from linehaul.operators.search import triplets

    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(4), rng.randrange(2), [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(60, *rows[3][1:]), (61, 0, 0, 0, [0.0] * 6), (62, 0, 1, 1, [1.0, 2.0])]
    got = {r["anchor"]: (r["positive"], r["negative"]) for r in triplets(spark.createDataFrame(rows, "id long, system int, identity int, snapshot int, vector array<double>"), block=20).collect()}

    def far(x, y):
        if len(x) != len(y):
            return 1.0
        x, y = (np.array(v) / (1 + np.abs(v)) for v in (x, y))
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return min(max(1 - (x @ y / n if n else 0.0), 0.0), 2.0)

    want = {}
    for a in rows:
        d = [((0 if b[1:3] == a[1:3] and b[3] != a[3] else 1), round(far(a[4], b[4]), 12), b[0]) for b in rows if b[0] != a[0]]
        p, n = min(d), max(d, key=lambda x: (x[1], -x[2]))
        if n[1] >= p[1] + 0.001:
            want[a[0]] = (p[2], n[2])
    assert got == want


def test_evaluation_report_without_training_rows(spark):
    rows = [("s1", k, "test", float(k % 3), float(k), 1.0 + k, 0.5 * k) for k in range(6)]
    make = lambda more=(): spark.createDataFrame([*rows, *more], "snapshot string, line int, split string, target double, model double, trips double, x double")
    got = {r["baseline"]: r for r in B.evaluation_report(make(), ["x", "trips"], "model", "trips", "target", "test", 2).collect()}
    assert set(got) == {"gnn", "engineered-linear", "frequency", "handcrafted-cosine", "random"}
    assert {k for k, r in got.items() if r["status"] == "unavailable"} == set(B.LEARNED) and all(got[k]["spearman"] is None for k in B.LEARNED) and got["gnn"]["examples"] == 6
    more = [("s0", k, "train", float(k), 0.0, 1.0, float(k)) for k in range(5)]
    assert all(r["status"] == "ok" and r["snapshots"] == 1 for r in B.evaluation_report(make(more), ["x", "trips"], "model", "trips", "target", "test", 2).collect())
    with pytest.raises(ValueError, match="split validation"):
        B.evaluation_report(make(), ["x"], "model", "trips", "target", "validation")


def test_random_score_equals_plain_integers(spark):
    mask = (1 << 64) - 1

    def plain(seed, snapshot, line):
        z = seed ^ line * 0x9E3779B97F4A7C15 & mask
        for b in snapshot.encode():
            z = (z ^ b) * 0xBF58476D1CE4E5B9 & mask
            z = (z << 13 | z >> 51) & mask
        return (z ^ z >> 29) / mask

    rows = [("", 0), ("a", 1), ("snapshot-é", 7), ("b" * 40, 3)]
    got = spark.createDataFrame(rows, "s string, n int").select("s", "n", B.random_score(9)("s", "n").alias("v")).collect()
    assert all(abs(r["v"] - plain(9, r["s"], r["n"])) < 1e-15 for r in got) and len({r["v"] for r in got}) == 4
