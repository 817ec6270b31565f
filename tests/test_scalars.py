import math

from pyspark.sql import functions as F

from linehaul.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).collect()[0]["x"]


def test_clock(spark):
    c = S.clock_seconds(F.col("t"))
    rows = {"25:15:00": 90900, " 7:05:00 ": 25500, "7: 5:00": None, "07:60:00": None, "07:05": None, "a:b:c": None, "": None}
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", c.alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == rows
    assert one(spark, S.clock_seconds(F.col("t"), short=True), t="07:30") == 27000
    assert one(spark, S.clock_text(F.col("s")), s=90900) == "25:15:00"


def test_names_and_codes(spark):
    assert one(spark, S.normalize_name(F.col("n")), n="Wörth (See) 2") == "wörthsee2"
    assert one(spark, S.name_similarity(F.col("a"), F.col("b")), a="abcd", b="abcx") == 0.75
    assert one(spark, S.name_similarity(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, S.small_code(F.col("c"), 3), c=" ") == 0
    assert one(spark, S.small_code(F.col("c"), 3), c="4") is None
    assert one(spark, S.mode_matches(F.col("t"), "Rail"), t="12") is True
    assert one(spark, S.mode_matches(F.col("t"), "bus"), t="x") is True


def test_cosine_and_bounds(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, S.cosine_similarity(arr(1, 0), arr(1, 0))) == 1.0
    assert one(spark, S.cosine_similarity(arr(0, 0), arr(1, 0))) == 0.0
    assert one(spark, S.cosine_similarity(arr(1), arr(1, 0))) == 0.0
    assert one(spark, S.bounded(F.lit(float("nan")))) == 0.0
    assert one(spark, S.ratio(F.lit(0.0), F.lit(5.0))) == 1.0
    assert math.isclose(one(spark, S.haversine_metres(F.lit(48.0), F.lit(16.0), F.lit(48.001), F.lit(16.0))), 111.19, abs_tol=0.1)


def test_generator_is_counter_based(spark):
    got = spark.range(5).select(S.split_mix_unit(F.lit(42), F.col("id")).alias("u")).collect()
    assert [r["u"] for r in got] == [(S.split_mix(42, n) >> 11) / 2**53 for n in range(5)]
    assert S.split_mix(0, 0) == 0xE220A8397B1DCDAF


def test_profiles():
    assert sum(S.profile_weights().values()) == 1.0
    assert S.profile_weights("weighted:1,1,1,1") == dict.fromkeys(("role", "service", "geometry", "resilience"), 0.25)
