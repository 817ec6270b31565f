"""Ranking metrics against their definitions."""

import random

import pytest

from linehaul.operators import metrics as M


def _by_pairs(rows):
    out = {}
    for g, i, p, t in rows:
        for h, j, q, u in rows:
            if g == h and i < j:
                n = out.setdefault(g, [0, 0, 0])
                n[0] += 1
                if None not in (p, t, q, u):
                    n[1] += 1
                    n[2] += (t >= u) == (p >= q)
    return {g: (n, a / m if m else None) for g, (n, m, a) in out.items()}


@pytest.mark.parametrize("again", [False, True])
def test_pairwise_accuracy_in_blocks_equals_all_pairs(spark, again):
    draw = random.Random(5)
    value = lambda: draw.choice([None, *map(float, range(6))]) if again else float(draw.randrange(6))
    rows = [(g, draw.randrange(25) if again else i, value(), value()) for g, n in (("a", 150), ("b", 30), ("c", 1), ("d", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, p double, t double")
    for block in (16, 1 << 16):
        got = {r["g"]: (r["pairs"], r["pairwise_accuracy"]) for r in M.pairwise_accuracy(df, ["g"], "p", "t", "i", block=block).collect()}
        want = _by_pairs(rows)
        assert got.keys() == want.keys()
        for g, (n, share) in want.items():
            assert got[g][0] == n and got[g][1] == pytest.approx(share)


def test_pairwise_accuracy_of_many_rows(spark):
    """All pairs are 2 * 10^10: they can't be listed here."""
    rows = spark.range(200_000).selectExpr("'a' g", "id i", "double(id * 37 % 101) p", "double(id % 12) t")
    got = M.pairwise_accuracy(rows, ["g"], "p", "t", "i")
    (one,) = got.collect()
    assert one["pairs"] == 200_000 * 199_999 // 2 and 0.4 < one["pairwise_accuracy"] < 0.6
