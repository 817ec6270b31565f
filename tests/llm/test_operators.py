"""Corpus operators against brute force, and their behaviour on nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linehaul.llm import kernels as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, taken int, a string, key long"


def docs(spark, rows):
    """(doc_id, text[, source]) with columns that clash with names used inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", 1, "x", 2) for r in rows], DOC)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_words_and_hashes():
    texts = ["a  b\tc\n", None, "", " \x0b ", "é ß\x0cx", "a"]
    got = [(int(n)) for _, _, w in K.each(pa.array(texts)) for n in np.diff(w.doc)]
    assert got == [len(WORD.findall(t or "")) for t in texts]
    (_, _, w), = K.each(pa.array(["x y x y x"]))
    h = K.window_hash(w.hash, 2)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


# --- license scan


def license_paragraphs_of(text):
    """Lines, joined where one ends in the middle of a sentence and the next is not blank."""
    out = []
    for line in re.split(r"\r?\n", text):
        if out and out[-1] and out[-1][-1] not in ".!?:; \t" and line.strip(" \t"):
            out[-1] += " " + line.strip(" \t") if line.strip(" \t") else ""
        else:
            out.append(line)
    return [x for k, x in enumerate(out) if x or k == 0 or k == len(out) - 1]


def test_license_scan(spark):
    from linehaul.llm import license_scan as L

    model = L.train()
    grant = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this\nsoftware and associated documentation\nfiles, to deal in it."
    rows = [(1, "Hello.\nLicensed under the Apache License, Version 2.0.\nBye"), (2, "no licence here"), (3, None), (4, ""), (5, "Released under the MIT License."), (5, "Released under the MIT License."), (6, "x.\r\nLicensed under CC BY-NC 4.0."), (7, "of the and this that " * 500), (8, "Some text.\n" + grant + "\nMore text."), (9, "word " * 30_000 + ".\nReleased under the ISC License."), (10, "Licensed under the EUPL v1.2 or later.")]
    all_ = L.license_paragraphs(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in all_ if r["confirmed"]} == {(1, 1, "apache-2.0"), (5, 0, "mit"), (6, 1, "cc-by-nc"), (8, 1, "mit"), (9, 1, "isc")}
    assert all(r["family"] == (r["predicted"] if r["confirmed"] else "unknown") for r in all_)
    want = {}
    for i, text in {r[0]: r[1] for r in rows}.items():
        for k, line in enumerate(license_paragraphs_of(text or "")):
            words = L.tokens(line)
            s = np.array(model.bias)
            for g in L.grams(words):
                s = s + np.array(model.weights.get(g, np.zeros(len(s))))
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            if p.argmax() < len(s) - 1 and p.max() >= 0.2:
                family, have = model.classes[p.argmax()], L.grams(words)
                alike = [(set(n), L.grams(n) - set(n)) for n in map(L.tokens, L.NOTICES[family])]
                alike = max((len(a & have) / len(a) + len(b & have) / len(b)) / 2 for a, b in alike)
                if alike >= 0.6 or p.max() >= 0.5:
                    want[i, k] = (family, round(p.max(), 6), round(alike, 6))
    assert {(r["doc_id"], r["paragraph"]): (r["predicted"], pytest.approx(r["probability"], abs=2e-6), pytest.approx(r["template_similarity"], abs=2e-6)) for r in all_} == want
    assert L.license_paragraphs(docs(spark, [])).count() == 0


def test_license_probabilities_are_of_held_out_notices():
    from linehaul.llm import license_scan as L

    hit, n, sure = 0, 0, []
    for fold in range(4):
        index, w, b = L._fit(L._examples(7, 12, lambda i, fold=fold: i % 4 != fold), 3e-4, 250, 2.0)
        for k, f in enumerate(L.NOTICES):
            for i, notice in enumerate(L.NOTICES[f]):
                if i % 4 == fold:
                    x, _ = L._matrix([(L.tokens(notice), k)], index)
                    p = L._softmax((x @ w + b) / L.train().temperature)[0]
                    hit, n = hit + (p.argmax() == k), n + 1
                    sure.append(p.max())
    # on notices that the fit did not see, the mean of the largest probability is no more than the share of right ones by much
    assert hit / n > 0.5 and np.mean(sure) < hit / n + 0.15, (hit / n, np.mean(sure))


def test_license_anchors_are_necessary():
    from linehaul.llm import license_scan as L

    m = L.train()
    for k in range(len(m.classes) - 1):
        gain = sum(max(0, w[k] - w[-1]) for g, w in m.weights.items() if not set(g.split(" ")) & set(m.anchors))
        assert m.bias[k] + gain < m.bias[-1]


# --- decontamination


def test_decontaminate_equals_brute_force(spark):
    from linehaul.llm.decontaminate import decontaminate, overlaps

    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate((40, 25, 20, 12, 7, 5))] + [(9, None), (10, "two words")]
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(0, 80))
        if i % 3 == 0:
            item = items[rng.randrange(6)][1].split()
            part = [w if rng.random() > 0.1 else "other" for w in item]
            text = text[:10] + part + text[10:]
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (102, items[0][1].upper() + "!!"), (102, items[0][1].upper() + "!!"), (103, "it has two words more"), (104, "\nTwo  words."), (105, "x " * 30_000 + items[1][1]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in overlaps(docs(spark, rows), bench).collect()}
    want = {}
    for i, text in rows:
        w = re.split(r"[^a-z0-9]+", (text or "").lower())
        for j, item in [*items[:6], items[7]]:
            v = item.split()
            if len(v) < 5:
                if [x for x in w if x] == v:
                    want[i, j] = len(v)
                continue
            m = min(20, len(v))
            best = 0
            for off in range(-len(v), len(w)):
                eq = [int(w[off + t] == v[t]) for t in range(len(v)) if 0 <= off + t < len(w)]
                best = max([best, *(sum(eq[s : s + m]) for s in range(len(eq) - m + 1))])
            if best >= -(-m * 8 // 10):
                want[i, j] = best
    assert got == want and (104, 10) in got
    shuffled = {(r["doc_id"], r["item_id"]): r["matched"] for r in overlaps(docs(spark, rows), bench, broadcast_rows=0).collect()}
    assert shuffled == got
    kept = decontaminate(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got if i is not None}
    other = decontaminate(docs(spark, [(1, items[0][1]), (1, "clean text")]), bench).collect()
    assert [r["text"] for r in other] == ["clean text"]
    assert overlaps(docs(spark, []), bench).count() == 0 and overlaps(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontaminate_misses_no_substitution(spark):
    from itertools import combinations

    from linehaul.llm.decontaminate import MASKS, complete_masks, overlaps

    only = complete_masks(MASKS, range(5, 21), 0.8)
    for n in range(5, 21):
        seeds = [{o + i for i, c in enumerate(m) if c == "1"} for m in [*MASKS, *(m for m, of in only.items() if n in of)] for o in range(n - len(m) + 1)]
        assert all(any(s.isdisjoint(gone) for s in seeds) for gone in combinations(range(n), n - -(-n * 8 // 10)))
    rng = random.Random(13)
    items, rows = [], []
    for j, n in enumerate((5, 6, 7, 10, 15, 20, 21)):
        v = [f"i{j}x{k}" for k in range(n)]
        items.append((j, " ".join(v)))
        m = min(n, 20)
        every = list(combinations(range(n - m, n), m - -(-m * 8 // 10)))
        for gone in every if len(every) < 50 else rng.sample(every, 300):
            rows.append((len(rows), " ".join(["p"] * (len(rows) % 3) + ["q" if k in gone or k < n - m else w for k, w in enumerate(v)])))
    got = {r["doc_id"] for r in overlaps(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k for k, _ in rows}


# --- mixing


def test_mixing(spark):
    from linehaul.llm.mixing import mix

    rng = random.Random(5)
    rows = [(i, " ".join(prose(rng, rng.randrange(0, 300))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(900, None, "b"), (901, "", "d"), (902, " one\ttwo ", "é")]
    rows += [rows[0], rows[0]]
    out = mix(docs(spark, rows))
    got = out.select("doc_id", "source", "size", "source_size", "target", "taken", "repeats", "picks").collect()
    assert len(got) == len(rows) and "a" in out.columns
    size, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == max(len(WORD.findall(t or "")) for i, t, s in rows if i == r["doc_id"])
        assert r["taken"] == r["repeats"] * r["size"] + sum(p["to"] - p["from"] for p in r["picks"]) <= 3 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = (r["source_size"], r["target"])
    assert all(target[s][0] == size[s] for s in size)
    # targets by rounds of capping, as stated
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        new = {s: 3 * size[s] for s in free if share[s] > 3 * size[s]}
        if not new:
            break
        capped |= new
    for s, t in (capped | share).items():
        assert target[s][1] == pytest.approx(t) and abs(taken[s] - t) <= 40
    again = mix(docs(spark, rows)).select("doc_id", "taken").collect()
    assert sorted((r[0], r[1]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mix(docs(spark, [])).count() == 0


def test_mixing_with_any_column_names_and_ids(spark):
    from linehaul.llm.mixing import mix

    names = ["n", "block", "shards", "full", "part", "mul", "add", "shard", "shard_size", "order", "name", "end", "size", "_size", "c0", "c1", "_range", "_w", "total", "taken", "a.b"]
    rng = random.Random(17)
    # one null id for most rows, ids with several texts of one length, one very long text
    rows = [(None if i % 2 else i % 50, " ".join(prose(rng, 20 if i % 3 else rng.randrange(200))), "s" if i % 5 else "t") for i in range(300)] + [(7, "w " * 40_000, "s")]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    out = mix(df, shard_tokens=2000)
    assert out.columns == [*(c for c in df.columns if c not in ("size", "taken")), "size", "source_size", "target", "taken", "repeats", "picks"]
    got = out.collect()
    key = lambda r: (r["doc_id"] or -1, r["text"], r["taken"], str(r["picks"]))
    again = mix(df.repartition(7), shard_tokens=2000).collect()
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert all(r["n"] == 0 and r["a.b"] == len(names) - 1 for r in got)
    for s in ("s", "t"):
        some = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 0.01 * some[0]["target"] + 64 and all(r["taken"] <= 3 * r["size"] for r in some)
    # sizes that are known already give the same mix
    sized = df.select("doc_id", "source", F.xxhash64("text").alias("text"), F.size(F.split(F.trim("text"), " +")).alias("words"))
    assert sum(r["taken"] for r in mix(sized, size_col="words", shard_tokens=2000).collect()) == pytest.approx(sum(r["taken"] for r in got), rel=0.01)


def test_numbering_is_that_of_one_sort(spark):
    from linehaul.operators.numbering import numbered
    from linehaul.scratch import Scratch

    rng = random.Random(18)
    rows = [(k, rng.randrange(20), rng.choice([None, 1.0, 2.5])) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, x int, y double")
    got = numbered(df, [F.desc("x"), F.col("y").asc_nulls_last(), "k"], "place", Scratch(spark, "t"), {"before": "x"}).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[0]))
    assert [r["k"] for r in sorted(got, key=lambda r: r["place"])] == [r[0] for r in want] and {r["place"] for r in got} == set(range(500))
    upto = 0
    for r in sorted(got, key=lambda r: r["place"]):
        assert r["before"] == upto
        upto += r["x"]


def test_apportionment_is_by_highest_quotients(spark):
    from linehaul.llm.mixing import sainte_lague

    rng = random.Random(1)
    for seats in (0, 1, 7, 100, 1001):
        w = {f"m{i}": rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 2000)]) for i in range(9)}
        held = dict.fromkeys(w, 0)
        for _ in range(seats):
            held[max(sorted(w), key=lambda k: w[k] / (2 * held[k] + 1))] += 1
        df = spark.createDataFrame([(k, float(v), seats) for k, v in w.items()], "k string, w double, seats long")
        assert {r["k"]: r["quota"] for r in sainte_lague(df, [], ["k"], "w", "seats").collect()} == held


# --- classifiers


def labelled(spark, make, n=240):
    rng = random.Random(2)
    rows = [(i, make(rng, i % 2 == 1), "s") for i in range(n)]
    labels = spark.createDataFrame([(i, (i + 1) % 2, i % 2) for i in range(n)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs(spark, rows + [(900, None), (901, ""), (902, "w " * 60_000), (None, "w1 w2"), (0, rows[0][1])]), labels


def test_quality(spark):
    from linehaul.llm import quality as Q

    make = lambda rng, bad: " ".join(w + ("$$$" if bad else "") for w in prose(rng, rng.randrange(5, 80)))
    d, labels = labelled(spark, make)
    held = lambda i: F.crc32(i.cast("string")) % 3 == 1
    got = Q.quality(d, labels, held).collect()
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    test = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert np.mean([r["predicted"] == (r["doc_id"] + 1) % 2 for r in test]) > 0.95
    kept = Q.reject(d, d, labels, held)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] for r in got)
    none = Q.quality(d, labels.limit(0), held).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_equals_a_naive_convolution():
    from linehaul.llm import quality as Q

    rng = np.random.default_rng(19)
    m = Q.ByteCnn(rng.normal(0, 0.3, (6, 256, 3)).astype(np.float32), rng.normal(0, 0.1, 3).astype(np.float32), rng.normal(0, 0.5, 6).astype(np.float32), 0.1, 32, 8)
    texts = ["", "a", "abcdef", "some words and \xe9\xdf", "x" * 31, "y" * 32, "z" * 33] + ["".join(map(chr, rng.integers(32, 120, n))) for n in (56, 57, 200, 999)]

    def naive(text):
        data = text.encode() + bytes(5)
        n, best = len(data) - 5, []
        for start in range(0, max(1, n), 24):
            if n and (start == 0 or start + 8 < n):
                best.append([max(sum(m.table[k, data[p + k], f] for k in range(6)) for p in range(start, min(start + 32, n))) + m.bias[f] for f in range(3)])
        best = np.maximum(np.array(best or [[0] * 3]), 0)
        return 1 / (1 + np.exp(-(np.concatenate([best.mean(0), best.max(0)]) @ m.out + m.out_bias)))

    assert Q.score_texts(pa.array(texts), m) == pytest.approx([naive(t) for t in texts], abs=1e-5)


def test_quality_of_one_label_and_any_partitioning(spark):
    from linehaul.llm import quality as Q

    rng = random.Random(20)
    d = docs(spark, [(i, " ".join(prose(rng, rng.randrange(1, 60)))) for i in range(80)] + [(3, "another text of one id")])
    never = lambda i: F.lit(False)
    for y in (0, 1):
        labels = spark.createDataFrame([(i, y) for i in range(40)], "doc_id long, quality int")
        assert {r["predicted"] for r in Q.quality(d, labels, never).collect()} == {y}
        assert Q.reject(d, d, labels, never).count() == (81 if y else 0)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    one, seven = ({(r["doc_id"], r["score"]) for r in Q.quality(d.repartition(n), labels, never, epochs=2).collect()} for n in (1, 7))
    assert one == seven


def test_training_rows_are_of_the_documents_at_hand(spark):
    from linehaul.llm.labelled import drawn, training_rows

    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    some = docs(spark, [(i, f"t{i}") for i in range(900, 1000)] + [(901, "s901"), (902, None)])
    got = training_rows(some, labels, "quality", 60, lambda i: i % 5 == 0).collect()
    assert len(got) == 60 and sum(r["y"] for r in got) == 30 and all(r["id"] >= 900 and r["id"] % 5 for r in got)
    assert {r["text"] for r in got if r["id"] == 901} <= {"s901"}
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    r = spark.createDataFrame([(text,), ("short",)], "t string").select(drawn(F.col("t"), 2000).alias("d")).collect()
    assert r[1]["d"] == "short" and r[0]["d"].split("\n") == [text[k : k + 500] for k in (0, 3166, 6333, 9500)]


def test_quality_chunks_cover_the_text():
    from linehaul.llm import quality as Q

    m = Q.ByteCnn(np.zeros((6, 256, 1), np.float32), np.zeros(1, np.float32), np.array([0, 1], np.float32), 0.0)
    m.table[0, ord("#"), 0] = 5
    texts = ["x" * n + "#" for n in (0, 200, 255, 256, 1000, 5000)] + ["x" * 3000]
    p = Q.score_texts(pa.array(texts), m)
    assert (p[:-1] > 0.99).all() and p[-1] == 0.5


def test_quality_scores_do_not_depend_on_neighbours():
    from linehaul.llm import quality as Q

    rng = np.random.default_rng(16)
    m = Q.ByteCnn(rng.normal(0, 1, (6, 256, 4)).astype(np.float32), np.zeros(4, np.float32), rng.normal(0, 1, 8).astype(np.float32), 0.0)
    for text in ("a", "abcde", "some words here", "x y z " * 100):
        alone = Q.score_texts(pa.array([text]), m)[0]
        assert all(Q.score_texts(pa.array(["before", text, *after]), m)[1] == alone for after in (["#####"], ["zzz", "q"], ["", "\xe9\xe9\xe9"], [None, "0"], []))


def test_toxicity(spark):
    from linehaul.llm.toxicity import toxicity

    make = lambda rng, bad: " ".join(w if rng.random() > 0.1 or not bad else rng.choice(["Nasty!", "rude"]) for w in prose(rng, rng.randrange(40, 90)))
    d, labels = labelled(spark, make)
    held = lambda i: F.crc32(i.cast("string")) % 5 == 0
    got = toxicity(d, labels, held).collect()
    test = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in test]) > 0.9
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1


def test_toxicity_equals_naive_ftrl():
    import math

    from linehaul.llm import toxicity as T

    rng, words_of = random.Random(21), re.compile(r"[a-z0-9]+")
    texts = [" ".join(prose(rng, rng.randrange(1, 20), 12)) + (" Bad!" if i % 3 == 0 else "") for i in range(30)]
    w = [words_of.findall(t.lower()) for t in texts]
    # one number per distinct feature, as the operator hashes them
    def feats(t):
        return {x for x in t} | {(a, b) for a, b in zip(t, t[1:], strict=False)} | {(a, None, b) for a, b in zip(t, t[2:], strict=False)}

    bits, l1, l2, alpha, beta = 20, 0.4, 0.1, 1.0, 1.0
    ex = []
    for t, (_, _, ws) in ((t, next(iter(K.each(pa.array([t]), lower=True, gap=K.NOT_ALNUM)))) for t in texts):
        ex.append((np.append(np.unique(T.features(ws, bits)[1]), 1 << bits).astype(np.int32), int("Bad" in t)))
    assert [len(x) - 1 for x, _ in ex] == [len(feats(t)) for t in w]
    model = T.train(ex, bits, alpha, beta, l1, l2, epochs=2, seed=3)
    z, n = {}, {}

    def weight(f):
        a = z.get(f, 0.0)
        lim = 0.0 if f == 1 << bits else l1
        return 0.0 if abs(a) <= lim else -(a - math.copysign(lim, a)) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    ones = [k for k, x in enumerate(ex) if x[1]]
    shows = min(6, max(1, round((len(ex) - len(ones)) / len(ones) / 3)))
    deck, order = np.array([*range(len(ex)), *ones * (shows - 1)]), np.random.default_rng(3)
    for _ in range(2):
        for k in order.permutation(deck):
            ws = {f: weight(f) for f in ex[k][0].tolist()}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - ex[k][1]
            for f, v in ws.items():
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha * v
                n[f] = n.get(f, 0.0) + g * g
    have = {f: weight(f) for f in z if weight(f) and f != 1 << bits}
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(have, rel=1e-4) and model.bias == pytest.approx(weight(1 << bits))
    for t, p in zip(ex, T.score_texts(pa.array(texts), model), strict=True):
        assert p == pytest.approx(1 / (1 + math.exp(-sum(have.get(f, 0) for f in t[0].tolist()) - model.bias)), rel=1e-4)


# --- WARC


def test_warc_round_trip(spark):
    import pyarrow.fs as pafs
    import zstandard

    from linehaul.llm.warc import DICT_MAGIC, archive, read_archives

    rng = random.Random(4)
    pages = [(i, f"http://x/{i}", "<p>" + " ".join(prose(rng, 60)) + "</p>") for i in range(80)]
    pages += [(100, "http://x/é\r\n%0A", pages[3][2]), (101, None, None), (102, "u", ""), (103, "u", "short"), (104, "u", "short"), (2, "http://x/2", pages[2][2]), (None, "u", pages[5][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    manifest = archive(df)
    back = read_archives(manifest, payloads=True).collect()
    assert len(back) == len(pages)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for r, (i, url, html) in zip(sorted(back, key=key), sorted(pages, key=key), strict=True):
        payload = (html or "").encode()
        assert (r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"]) == (i, url, len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if i == 100 else ("response", None))
        assert bytes(r["payload"]) == (b"" if i == 100 else payload)
    fs, path = pafs.FileSystem.from_uri(manifest.collect()[0]["path"])
    raw = fs.open_input_stream(path).read()
    assert int.from_bytes(raw[:4], "little") == DICT_MAGIC
    n = int.from_bytes(raw[4:8], "little")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n]))
    assert d.decompressobj().decompress(raw[8 + n :]).startswith(b"WARC/1.1\r\n")
    assert read_archives(archive(df.limit(0))).count() == 0


# --- substring dedup


def removed_by_brute_force(rows, length):
    first, out = {}, {}
    texts = {i: WORD.findall(t or "") for i, t in rows if i is not None}
    for i in sorted(texts):
        for p in range(len(texts[i]) - length + 1):
            first.setdefault(tuple(texts[i][p : p + length]), i)
    for i, w in texts.items():
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone |= set(range(p, p + length))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("length", [50, 8])
def test_substring_dedup_equals_brute_force(spark, length):
    from linehaul.llm.substring_dedup import substring_dedup, substring_digest

    rng = random.Random(length)
    shared = [prose(rng, n) for n in (length, length - 1, length + 30, 3 * length)]
    rows = []
    for i in range(70):
        text = prose(rng, rng.randrange(0, 120), 5 if i % 10 == 0 else 400)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(shared) + text[at:]
        rows.append((i * 7 % 71, " ".join(text)))
    rows += [(200, rows[4][1]), (201, " \n".join((rows[4][1] or "").split())), (202, None), (203, ""), (204, "a " * 300), (205, "a " * 200), (206, " ".join(shared[2]) + " é\tß")]
    want = removed_by_brute_force(rows, length)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_digest(docs(spark, [*rows, (None, rows[4][1])]), length).collect() if r["doc_id"] is not None}
    assert got == want
    out = substring_dedup(docs(spark, rows), length)
    assert out.columns == docs(spark, rows).columns
    for r in out.collect():
        assert hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() == want[r["doc_id"]][2]
    assert substring_digest(docs(spark, []), length).count() == 0
    twice = substring_digest(docs(spark, [rows[0], rows[0]]), length).collect()
    assert len(twice) == 2 and all(r["n_removed"] == 0 for r in twice)


def test_substring_dedup_of_ids_with_several_texts(spark):
    from linehaul.llm.substring_dedup import substring_dedup, substring_digest

    rng = random.Random(22)
    a, b = prose(rng, 60), prose(rng, 60)
    d = docs(spark, [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (6, " ".join(b[:55] + ["x"]))])
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring_digest(d).collect())
    assert got == [(1, 0), (5, 0), (5, 60), (6, 55)]
    assert sorted(len((r["text"] or "").split()) for r in substring_dedup(d).collect()) == [0, 1, 60, 60]
    with pytest.raises(TypeError):
        substring_digest(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_substring_ladder_keeps_what_repeats_at_every_level(spark):
    from linehaul.llm import substring_dedup as S
    from linehaul.scratch import Scratch

    assert S.ladder(50) == [7, 13, 25] and S.ladder(12) == [6] and S.ladder(8) == [8]
    rng = random.Random(23)
    base, scratch = prose(rng, 400, 10**6), Scratch(spark, "t")
    rows = [(0, base)]
    for k, n in enumerate((6, 9, 18, 36, 60)):  # shared runs that end between two levels each
        rows.append((k + 1, prose(rng, 60, 10**6) + base[k * 70 : k * 70 + n] + prose(rng, 60, 10**6)))
    left, words, documents = S.keyed(docs(spark, [(i, " ".join(w)) for i, w in rows])), [], []
    for size in S.ladder(50):
        left = S.narrowed(left, size, 50, scratch)
        got = left.select("doc_id", F.size("words").alias("n")).collect()
        words.append(sum(r["n"] for r in got))
        documents.append({r["doc_id"] for r in got})
    assert words[0] > words[1] > words[2] >= 120 and documents[0] >= documents[1] >= documents[2] >= {0, 5} and len(documents[0]) > 2
    assert 1 not in documents[0] and 2 not in documents[1] and 3 not in documents[2]
    got = {r["doc_id"]: r["n_removed"] for r in S.substring_digest(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 60}


# --- language model


def test_language_model_equals_brute_force(spark):
    import math
    import zlib
    from collections import Counter, defaultdict

    from linehaul.llm import ngram_lm as L

    rng = random.Random(6)
    rows = [(i, " ".join(prose(rng, rng.randrange(0, 60), 60)).upper() if i % 9 == 0 else " ".join(prose(rng, rng.randrange(0, 60), 60))) for i in range(120)] + [(500, None), (501, ""), (502, "x y " * 400)]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    got = {r["doc_id"]: r for r in L.perplexity(docs(spark, rows), lambda i: F.crc32(i.cast("string")) % 5 == 1, block_tokens=300).collect()}
    texts = {i: [*WORD.findall((t or "").lower()), "\n"] for i, t in rows}
    pairs, unigrams = Counter(), Counter()
    for i, t in texts.items():
        if not out(i):
            pairs.update(zip(["\t", *t], t, strict=False))
            unigrams.update(t)
    n, v = sum(unigrams.values()), len(unigrams)
    context, kinds, cont = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (u, w), c in pairs.items():
        context[u] += c
        kinds[u][min(c, 3) - 1] += 1
        cont[w] += 1
    cc, mm = Counter(pairs.values()), Counter(cont.values())
    high, low = L.discounts(*(cc[k] for k in (1, 2, 3, 4))), L.discounts(*(mm[k] for k in (1, 2, 3, 4)))
    left = (low[0] * mm[1] + low[1] * mm[2] + low[2] * sum(x for k, x in mm.items() if k > 2)) / len(pairs)
    one = lambda w: max(cont[w] - [0, *low][min(cont[w], 3)], 0) / len(pairs) + left / (v + 1)

    def two(u, w):
        if not context[u]:
            return one(w)
        c = pairs[u, w]
        return max(c - [0, *high][min(c, 3)], 0) / context[u] + sum(a * b for a, b in zip(high, kinds[u], strict=True)) / context[u] * one(w)

    assert sum(map(one, unigrams)) + left / (v + 1) == pytest.approx(1)
    assert sum(two("w1", w) for w in unigrams) + sum(a * b for a, b in zip(high, kinds["w1"], strict=True)) / context["w1"] * left / (v + 1) == pytest.approx(1)
    for i, t in texts.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (out(i), len(t), n, sum(w in unigrams for w in t))
        assert r["base_score"] == pytest.approx(sum(math.log10((unigrams[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(two(u, w)) for u, w in zip(["\t", *t], t, strict=False)))
    empty = L.perplexity(docs(spark, []), lambda i: i == 0)
    assert empty.count() == 0
    nothing = L.perplexity(docs(spark, rows[:3]), lambda i: i >= 0).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == 0 for r in nothing)


# --- near-dedup


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1) if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment():
    from linehaul.llm.near_dedup import aligned, lcs_banded, similar

    rng = random.Random(8)
    for _ in range(40):
        a = [rng.randrange(12) for _ in range(rng.randrange(0, 40))]
        b = [rng.randrange(12) for _ in range(rng.randrange(0, 40))]
        assert lcs_banded(a, b, 100) == lcs(a, b)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert aligned(x, y, 100) == lcs(a, b)
        edited = [w if rng.random() > 0.15 else rng.randrange(12) for w in a]
        z = np.array(edited, np.uint64)
        if a:
            assert similar(x, z, 0.8) == (2 * lcs(a, edited) >= 0.8 * 2 * len(a) - 1e-9)
    long = np.array([rng.randrange(10**9) for _ in range(9000)], np.uint64)
    other = np.delete(long, [5, 700, 701, 4000, 8999])
    assert aligned(long, other, 200) == len(other)


def test_alignment_of_long_repetitive_texts():
    from linehaul.llm.near_dedup import aligned, lcs_banded, lcs_window, similar

    rng = random.Random(14)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 90))]
        b = [w for w in a if rng.random() > 0.2] if rng.random() < 0.5 else [rng.randrange(6) for _ in range(rng.randrange(0, 90))]
        for band in (0, 1, 7, 30, 200):
            assert lcs_window(a, b, band, 16) == lcs_banded(a, b, band)
    passage = [rng.randrange(10**6) for _ in range(1200)]
    text = np.array(passage * 5, np.uint64)
    other = np.insert(text, [3, 5990], [10**7, 10**7 + 1])
    assert aligned(text, other, 1200) == len(text) and similar(text, other, 0.8)
    # below the threshold by one word: no more is aligned than there is
    a = np.array(passage * 4, np.uint64)
    for k, want in ((960, True), (961, False)):
        b = a.copy()
        b[::5] = np.arange(10**8, 10**8 + len(b[::5]))
        b[1 : 1 + k - 960] = 1
        assert similar(a, b, 0.8) == want


def test_near_dedup(spark):
    from linehaul.llm.near_dedup import near_classes, near_dedup

    rng = random.Random(9)
    rows, group = [], {}
    for g in range(40):
        base = prose(rng, rng.randrange(120, 250), 5000)
        for k in range(rng.choice([1, 1, 2, 5, 12])):
            i = len(rows) * 3 % 997
            text = list(base)
            for _ in range(2 if k else 0):  # five-word shingles in common: at least 0.8 with the base
                text[rng.randrange(len(text))] = f"e{rng.randrange(999)}"
            rows.append((i, " ".join(text)))
            group[i] = g
    rows += [(2000, None), (2001, ""), (2002, ""), (2003, "one two three"), (2004, "one  two\nthree"), (2005, "one two four"), (2006, "a " * 5000), (2007, "a " * 5000)]
    d = docs(spark, [*rows, rows[0], (None, rows[1][1])])
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_classes(d).collect()}
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, i), i)
    assert {i: got[i][0] for i in group} == {i: least[g] for i, g in group.items()}
    assert [got[i][0] for i in range(2000, 2008)] == [2000, 2001, 2002, 2003, 2003, 2005, 2006, 2006]
    assert got[None] == (None, True) and all(kept == (c == i) for i, (c, kept) in got.items() if i is not None)
    kept = near_dedup(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i, (c, k) in got.items() if i is not None and k)
    assert near_classes(docs(spark, [])).count() == 0 and near_dedup(docs(spark, [])).count() == 0


def test_near_dedup_recall_against_all_pairs(spark):
    """Of the pairs with similarity from 0.8 up, whatever it is, nine of ten are linked; below none is."""
    from linehaul.llm.near_dedup import near_classes, similar

    rng = random.Random(24)
    rows, wanted = [], {}
    for g in range(700):
        base = prose(rng, 300, 20_000)
        rate, text = 0.005 + 0.22 * g / 700, []
        for w in base:
            x = rng.random()
            text += [w] if x > rate else [f"e{rng.randrange(10**6)}"] if x > rate / 3 else [w, f"i{rng.randrange(10**6)}"] if x > rate / 6 else []
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(text))]
        x, y = (np.array([hash(v) & (2**62 - 1) for v in t], np.uint64) for t in (base, text))
        s = 2 * lcs(base, text) / (len(base) + len(text))
        assert similar(x, y, 0.8) == (s >= 0.8)
        wanted[g] = s
    got = {r["doc_id"]: r["class_id"] for r in near_classes(docs(spark, rows)).collect()}
    linked = {g: got[2 * g + 1] == 2 * g for g in wanted}
    assert not any(linked[g] for g, s in wanted.items() if s < 0.8)
    for lo, hi in ((0.8, 0.83), (0.83, 0.86), (0.86, 0.9), (0.9, 0.95), (0.95, 1)):
        part = [linked[g] for g, s in wanted.items() if lo <= s < hi]
        print(f"similarity {lo}-{hi}: {np.mean(part):.3f} of {len(part)}")
        assert np.mean(part) >= 0.9


def edited(rng, base, kind, similarity):
    """``base`` with as many words substituted, left out or inserted, evenly chosen, as keep the similarity."""
    n, text = len(base), list(base)
    # 2 * aligned / (words of both) stays at the similarity or above
    most = {"substituted": n * (1 - similarity), "left out": 2 * n * (1 - similarity) / (2 - similarity), "inserted": 2 * n * (1 - similarity) / similarity}[kind]
    for k, i in enumerate(sorted(rng.choices(range(n), k=int(most + 1e-9)) if kind == "inserted" else rng.sample(range(n), int(most + 1e-9)), reverse=True)):
        if kind == "left out":
            del text[i]
        elif kind == "inserted":
            text.insert(i, f"i{k}_{rng.randrange(10**9)}")
        else:
            text[i] = f"e{k}_{rng.randrange(10**9)}"
    return text


def sketch_recall(rng, n, kind, similarity, pairs):
    from linehaul.llm.near_dedup import all_sketches

    bases = [prose(rng, n, 20_000) for _ in range(pairs)]
    texts = [" ".join(t) for b in bases for t in (b, edited(rng, b, kind, similarity))]
    keys = [set() for _ in texts]
    for i, _, w in K.each(pa.array(texts)):
        for own, key in all_sketches(w, 5, 96, 2):
            for t, x in zip(own.tolist(), key.tolist(), strict=True):
                keys[i + t].add(x)
    return np.mean([bool(keys[2 * p] & keys[2 * p + 1]) for p in range(pairs)])


def test_near_dedup_candidates_of_every_length():
    """Recall of the sketches: substitutions at every length, words left out or inserted where both texts are short."""
    rng = random.Random(41)
    for n in (3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 20, 24, 30, 36, 40, 50, 64, 70, 80, 100, 120, 200, 500, 2000, 5000):
        for kind in ("substituted", "left out", "inserted"):
            if n > {"substituted": 5000, "left out": 64, "inserted": 42}[kind]:
                continue
            for similarity in (0.8, 0.85, 0.9, 0.95):
                got = sketch_recall(rng, n, kind, similarity, 120 if n <= 120 else 40 if n <= 500 else 10)
                print(f"{n} words, {kind}, {similarity}: {got:.3f}")
                assert got >= 0.9, (n, kind, similarity, got)


def test_near_dedup_of_short_texts(spark):
    """Whole operator on pairs within 64 words at or just above the similarity, and on pairs just below it."""
    from linehaul.llm.near_dedup import near_classes

    rng = random.Random(42)
    rows, want = [], {}
    for g in range(300):
        base = prose(rng, rng.choice([5, 6, 8, 10, 12, 15, 20, 40]), 20_000)
        text = edited(rng, base, rng.choice(["substituted", "left out", "inserted"]), 0.8)
        if g % 3 == 0:
            text[0], text[-1], text[len(text) // 2] = "other", "words", "here"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(text))]
        want[g] = 2 * lcs(base, text) >= 0.8 * (len(base) + len(text)) - 1e-9
    got = {r["doc_id"]: r["class_id"] for r in near_classes(docs(spark, rows)).collect()}
    linked = {g: got[2 * g + 1] == 2 * g for g in want}
    assert not any(linked[g] for g in want if not want[g])
    assert np.mean([linked[g] for g in want if want[g]]) >= 0.95


def test_near_classes_equal_all_pairs(spark):
    """Groups whose members drift apart: every class is that of all pairs compared."""
    from linehaul.llm.near_dedup import near_classes

    rng = random.Random(25)
    rows = []
    for _ in range(6):
        text = prose(rng, 80, 10**6)
        for _ in range(12):
            rows.append((len(rows) * 7 % 73, " ".join(text)))
            text = [w if rng.random() > 0.06 else f"e{rng.randrange(10**6)}" for w in text]
    # ids with several texts, which are documents of their own
    rows += [(rows[0][0], rows[20][1]), (rows[1][0], " ".join(prose(rng, 50)))]
    texts = [t.split() for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 2 * lcs(texts[i], texts[j]) >= 0.8 * (len(texts[i]) + len(texts[j])):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    want = sorted((rows[k][0], min(rows[i][0] for i in range(len(rows)) if root[i] == root[k])) for k in range(len(rows)))
    out = near_classes(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(set(root))


def test_near_dedup_of_ids_with_several_texts(spark):
    from linehaul.llm.near_dedup import near_dedup

    rng = random.Random(26)
    a, b = " ".join(prose(rng, 60)), " ".join(prose(rng, 60))
    d = docs(spark, [(1, a), (1, b), (1, b), (2, b + " x"), (3, a), (None, a), (None, a), (4, ""), (5, None)])
    assert sorted(((r["doc_id"] or -1), r["text"] or "") for r in near_dedup(d).collect()) == sorted([(1, a), (1, b), (-1, a), (-1, a), (4, ""), (5, "")])


# --- embeddings


def test_embedding_links_equal_brute_force(spark):
    from linehaul.llm.embedding_dedup import embedding_links, quantise

    rng = np.random.default_rng(10)
    base = rng.normal(size=(30, 16))
    vecs = [(int(i * 5 % 211), list(map(float, np.float32(base[i % 30] + rng.normal(size=16) * (0.02 if i % 3 else 0.25))))) for i in range(200)]
    vecs += [(500 + k, vecs[3][1]) for k in range(5)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] + [1.0] * 15), (603, [1.0, None] * 8), (604, []), (605, [1.0] * 8), (606, [float("inf")] * 16), (607, [2 * x for x in vecs[3][1]]), (608, [1e-30] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vecs] + [(None, vecs[0][1], 1, 2)], "vec_id long, embedding array<float>, label int, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_links(df, tile=64).collect()}
    good = {i: np.array(v, np.float64) for i, v in vecs if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    good = {i: np.array(np.float32(v), np.float64) for i, v in good.items()}
    links = {i: {j for j in good if j != i and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.95} for i in good}
    for i, v in vecs:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(links.get(i, ())), min(seen), min(seen) == i), i
    assert got[None] == (0, None, True)
    assert embedding_links(df.limit(0)).count() == 0
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    q, s, e = quantise(u)
    bound = e[:, None] + np.linalg.norm(q * s[:, None], axis=1)[:, None] * e[None, :]
    assert (np.abs(u @ u.T - (q * s[:, None]) @ (q * s[:, None]).T) <= bound).all()


def test_embedding_links_of_a_rare_length(spark):
    from linehaul.llm.embedding_dedup import embedding_links

    rng = np.random.default_rng(15)
    rows = [(i, list(map(float, rng.normal(size=16)))) for i in range(280)]
    rows += [(1000 + k, [1.0, 2.0, 3.0, 4.0 + k / 1000]) for k in range(30)]  # fewer than the 39 blocks: some have none of them
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=8).collect()}
    assert {got[1000 + k] for k in range(30)} == {(29, 1000)}


def test_embedding_links_of_ids_with_several_vectors(spark):
    from linehaul.llm.embedding_dedup import embedding_links

    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x), (1, y), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (3, [0.0, 1.0, 0.01])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_embedding_links_of_any_scale_and_length(spark):
    from linehaul.llm.embedding_dedup import embedding_links, products

    rng = np.random.default_rng(27)
    base = rng.normal(size=1500)
    rows = [(1, base * 1e200), (2, (base + rng.normal(size=1500) * 0.04) * 1e199), (3, base * 1e-310 + 0), (4, rng.normal(size=1500) * 1e200)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_links(spark.createDataFrame([(i, list(map(float, v))) for i, v in rows], "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
    q = rng.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()


def test_embedding_links_settle_what_the_codes_leave_open(spark):
    """Cosines spread closely around the threshold, most of them within the codes' error."""
    from linehaul.llm.embedding_dedup import embedding_links

    rng = np.random.default_rng(28)
    centre = rng.normal(size=24)
    v = centre + rng.normal(size=(150, 24)) * np.linspace(0.15, 0.35, 150)[:, None]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_links(spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), tile=20).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(150, dtype=bool)
    label = np.arange(150)
    for _ in range(150):
        label = np.minimum(label, np.where(near, label[None, :], 999).min(1))
    assert got == {i: (int(near[i].sum()), int(label[i])) for i in range(150)}
