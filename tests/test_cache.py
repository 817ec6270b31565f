"""Vector cache: one changed snapshot is one computed again."""

import pytest
from pyspark.sql import functions as F

from linehaul.operators import cache as C
from linehaul.scratch import Scratch

SCHEMA = "snapshot string, line int, v double"
ROWS = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("b", 1, 3.0), ("c", 1, 4.0)]


def test_digest_sees_rows_and_not_their_order(spark):
    at = lambda rows, more=(): {r["snapshot"]: r["digest"] for r in C.snapshot_digests({"x": spark.createDataFrame(rows, SCHEMA), "y": spark.createDataFrame(list(more), SCHEMA)}).collect()}
    one = at(ROWS)
    assert at(ROWS[::-1]) == one and len(set(one.values())) == 3
    changed = at([*ROWS[:3], ("c", 1, 4.0)])  # b lost a repeated row
    assert changed["a"] == one["a"] and changed["c"] == one["c"] and changed["b"] != one["b"]
    assert at(ROWS[:2], ROWS[2:])["b"] != one["b"]  # the same rows in another table


def test_changed_snapshot_alone_is_computed(spark):
    cache, calls = C.VectorCache(spark, Scratch(spark, "t").path("cache"), "m1"), []

    def run(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        digests = C.snapshot_digests({"x": df})
        got = cache.refresh(digests, lambda s: (calls.append(s), df.where(F.col("snapshot").isin(s)).select("snapshot", "line", (F.col("v") * 2).alias("w")))[1])
        return got, digests

    got, first = run(ROWS)
    assert got == ["a", "b", "c"] and run(ROWS)[0] == []
    rows = [("b", 1, 30.0) if r[0] == "b" else r for r in ROWS]
    got, now = run(rows)
    assert got == ["b"] and calls == [["a", "b", "c"], ["b"]]
    assert sorted((r["snapshot"], r["w"]) for r in cache.load(now).collect()) == [("a", 2.0), ("a", 4.0), ("b", 60.0), ("b", 60.0), ("c", 8.0)]
    assert sorted(r["w"] for r in cache.load(first).where("snapshot = 'b'").collect()) == [6.0, 6.0]
    with pytest.raises(ValueError, match="no vectors of a, b, c"):
        C.VectorCache(spark, cache.folder, "m2").load(now.orderBy("snapshot"))
    with pytest.raises(ValueError, match="no vectors of d"):
        cache.load(now.unionByName(spark.createDataFrame([("d", "x")], "snapshot string, digest string")))


def test_top_similar_in_blocks_equals_broadcast(spark):
    from linehaul.operators import search as R

    q = spark.range(30).select(F.col("id").alias("q_id"), (F.col("id") * 1.7 % 5).alias("q"))
    c = spark.range(200).select("id", (F.col("id") % 50).cast("string").alias("name"), (F.col("id") * 2.3 % 7).alias("v"))
    top = lambda n: sorted(map(tuple, R.top_similar(q, c, 3, -F.abs(F.col("q") - F.col("v")), F.col("q_id") == F.col("id"), n).select("q_id", "id", "rank").collect()))
    assert top(7) == top(100) and len(top(100)) == 90
