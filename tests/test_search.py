"""Products of tiles against the column expressions they stand for."""

import functools
import math
import random
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.operators import search as R
from linehaul.scratch import shared_dir


def _items(spark):
    draw = random.Random(11)
    vector = lambda n=6: [draw.uniform(-1, 1) for _ in range(n)]
    some = [vector() for _ in range(20)]
    rows = [(i, str(i), i % 3, draw.choice(some) if i % 2 else vector()) for i in range(120)]  # copies tie
    rows += [(200, "x", 0, [0.0] * 6), (201, "y", 1, vector(4)), (202, "z", 2, []), (203, "w", None, vector())]
    df = spark.createDataFrame(rows, "id long, name string, label int, v array<double>")
    return df.select("id", "name", "label", F.slice("v", 1, 3).alias("a"), F.slice("v", 4, 3).alias("b"))


def test_top_cosine_in_tiles_equals_top_similar(spark):
    items, weights = _items(spark), {"a": 0.7, "b": 0.3}
    q = items.where("id % 4 = 0").select(F.col("id").alias("q_id"), F.col("label").alias("q_label"), F.col("a").alias("a_q"), F.col("b").alias("b_q"))
    c = items.select("id", "name", "label", F.col("a").alias("a_c"), F.col("b").alias("b_c"))
    same = F.col("q_id") == F.col("id")
    rows = lambda df: sorted((r["q_id"], r["rank"], r["id"], r["similarity"]) for r in df.collect())
    queries = items.where("id % 4 = 0").withColumnRenamed("id", "q_id")
    for group, out in ((None, same), ("label", same | ~F.coalesce(F.col("q_label") == F.col("label"), F.lit(False)))):
        want = rows(R.top_similar(q, c, 5, R.facet_similarity(weights), out))
        for tile in (17, 1000):
            assert rows(R.top_cosine(queries, items, 5, weights, group, tile)) == want


def test_a_null_vector_comes_last(spark):
    items = spark.createDataFrame([(0, "0", [1.0, 0.0]), (1, "1", None), (2, "2", [-1.0, 0.0]), (3, "3", [1.0, None])], "id long, name string, v array<double>")
    got = R.top_cosine(items.where("id = 0").withColumnRenamed("id", "q_id"), items, 3, {"v": 1.0}).orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in got] == [(2, -1.0), (1, None), (3, None)]


def test_triplets_do_not_hang_on_blocks(spark):
    items = _items(spark).select("id", (F.col("id") % 2).alias("system"), F.col("label").alias("identity"), (F.col("id") % 5).alias("snapshot"), F.concat("a", "b").alias("vector"))
    rows = lambda n: sorted(map(tuple, R.triplets(items, block=n).collect()))
    assert rows(10) == rows(1000) != []


def _all_pairs(items, margin=0.001):
    """Triplets by every pair, dot products summed in the order of the places."""
    dot = lambda a, b: functools.reduce(lambda s, k: s + a[k] * b[k], range(len(a)), 0.0)
    unit = {}
    for i, *_, v in items:
        v = [0.0 if x is None or not math.isfinite(x) else x / (1 + abs(x)) for x in v or []]
        n = math.sqrt(dot(v, v))
        unit[i] = [x / n if n else 0.0 for x in v]
    far = lambda a, b: 1.0 if len(a) != len(b) else min(max(1 - dot(a, b), 0.0), 2.0)
    out = []
    for i, system, identity, snapshot, _ in items:
        pairs = [(int(not (system == s and identity == k and snapshot != t)), far(unit[i], unit[j]), j) for j, s, k, t, _ in items if j != i]
        (_, near, positive), (_, most, other) = min(pairs), min(pairs, key=lambda p: (-p[1], p[2]))
        if most >= near + margin:
            out.append((i, positive, other, most - near))
    return sorted(out)


def test_triplets_equal_all_pairs(spark):
    draw = random.Random(5)
    vector = lambda n=6: [draw.uniform(-1, 1) for _ in range(n)]
    some = [vector() for _ in range(4)]
    # copies, near copies that single precision cannot tell apart, kin by the dozen and lone ones
    items = [(i, i % 2, i % 7 if i % 5 else i, draw.randrange(3), draw.choice(some) if i % 3 == 0 else [x + draw.uniform(0, 1e-8) for x in draw.choice(some)] if i % 3 == 1 else vector()) for i in range(90)]
    items += [(200, 0, 1, 0, [0.0] * 6), (201, 1, 2, 1, vector(4)), (202, 0, 2, 2, []), (203, 1, 3, 0, None), (204, 0, 1, 1, [None, 1.0, float("nan"), 2.0, float("inf"), 0.5]), (205, 1, 2, 2, [-x for x in some[0]]), (206, 0, 3, 1, vector(4))]
    # a row without an id meets none
    df = spark.createDataFrame([*items, (None, 0, 1, 2, vector())], "id long, system int, identity int, snapshot int, vector array<double>")
    want = _all_pairs(items)
    for block in (7, 30, 1000):
        assert sorted(map(tuple, R.triplets(df, block=block).collect())) == want != []


def test_triplets_write_no_vector_for_the_blocks_it_meets(spark):
    draw, n = random.Random(3), 2000
    vectors = spark.createDataFrame([(i, [draw.gauss(0, 1) for _ in range(64)]) for i in range(n)], "id long, vector array<double>")
    items = vectors.select("id", (F.col("id") % 3).alias("system"), (F.col("id") % 10).alias("identity"), (F.col("id") % 7).alias("snapshot"), "vector")
    local, shared = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), Path(urlparse(shared_dir(spark)).path)

    def files():
        at, out = local.getAllFiles().iterator(), {str(f): f.stat().st_size for f in shared.rglob("*.parquet")}
        while at.hasNext():
            file = at.next()
            out[file.getPath()] = file.length()
        return out

    before = files()
    assert R.triplets(items, block=50).count() == n  # 40 blocks
    assert sum(size for name, size in files().items() if name not in before) < 5 * 64 * 8 * n
