"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from linehaul.llm import spelling as S
from linehaul.scratch import Scratch


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 10 * n else None
        out[w] = [form, n, len(others), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def vocabulary(rng, n, letters="abcé", start=""):
    return {start + "".join(rng.choice(letters) for _ in range(rng.randrange(7, 10))) for _ in range(n)}


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], "doc_id long, text string, word string, n int, key string, m int")


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_wavelet_reports_rectangles():
    rng = np.random.default_rng(4)
    for size in (1, 2, 7, 64, 100):
        values = rng.permutation(size)
        lo, hi, low, high = rng.integers(0, size + 1, (4, 60))
        rect, got = S.Wavelet(values).report(lo, hi, low, high)
        want = sorted((k, v) for k in range(60) for v in values[lo[k] : max(lo[k], hi[k])] if low[k] <= v < high[k])
        assert sorted(zip(rect.tolist(), got.tolist(), strict=True)) == want


@pytest.mark.parametrize("most", [20_000, 30, 3])
def test_near_words_equal_all_pairs(spark, most):
    rng = random.Random(most)
    words = vocabulary(rng, 250) | vocabulary(rng, 150, start="hot") | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaaaab", "ÿÿÿÿÿÿÿ", "ÿÿÿÿÿÿÿÿ", "éaaaaaaa", "solitaire"}
    counts = {w: rng.choice([2, 3, 30, 30, 400]) for w in words}
    got = S.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), Scratch(spark, "t"), most)
    want = {w: (n, b) for w, (f, _, _, n, _) in brute(counts).items() if n for b in [min((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v))]}
    assert {r["word"]: (r["n_near"], r["best"]) for r in got.collect()} == want


def test_cutting_again_bounds_buckets(spark):
    words = spark.createDataFrame([("hot" + w, 2) for w in sorted(vocabulary(random.Random(1), 600))], "word string, n long")
    rows, total = S.buckets(words, 40, Scratch(spark, "t"))
    sizes = rows.groupBy("m", "a", "b", "key").count().collect()
    assert sum(r["count"] for r in sizes) == rows.count() <= total
    assert max(r["count"] for r in sizes if r["b"] - r["a"] > 1) <= 40 and any(r["b"] - r["a"] < r["m"] // 2 for r in sizes)


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(8)
    common = sorted(vocabulary(rng, 40, "abcdefgÀß÷"))
    rows = [(k, " ".join(rng.choice(common).upper() if rng.random() < 0.3 else rng.choice(common[:12]) for _ in range(60)) + "; kürzlich-KÜRZLICH x1abcdefg") for k in range(80)]
    rows += [(3, rows[3][1]), (90, None), (91, ""), (None, common[0] + " " + common[0]), (92, " ".join(common * 300))]
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(S.UPPER, S.UPPER.lower()))
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if i is not None and h % 31 == 0 else run] += 1
    want = brute({w: n for w, n in counts.items() if n >= 2 and len(w) >= 7})
    got = result(S.spelling_variants(docs(spark, rows)))
    assert got == want and any(r[0] for r in want.values())
    assert S.spelling_variants(docs(spark, [])).count() == 0 and S.spelling_variants(docs(spark, [(1, None), (2, "no")])).count() == 0


def test_roots_follow_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(7)] + [("a", "w3"), ("b", "w7")]
    got = {r["word"]: r["root"] for r in S.roots(spark.createDataFrame(chain, "word string, form string"), Scratch(spark, "t")).collect()}
    assert got == {w: "w7" for w, _ in chain}
