"""The filter audit against a brute-force run of every order."""

from itertools import permutations

import numpy as np

from linehaul.llm import filter_audit as A


def brute(rows, labels):
    first, out = {}, {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    marks = {i: (any(q == 1 for j, q, _ in labels if j == i), any(t == 1 for j, _, t in labels if j == i)) for i, _, _ in labels if i is not None}
    docs = []
    for i, text, lang in rows:
        text = text or ""
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and first[text] < i}
        docs.append((lang or "", fails, marks.get(i, (False, False))))
    for part in {d[0] for d in docs}:
        mine, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(o):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                total[f] += len(gone)
                out[part, "".join(o), k + 1] = [len(left), len(gone), sum(d[1][f] for d in mine) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2][0] for d in gone), sum(d[2][1] for d in gone)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(total[o[k - 1]])
    return out


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, mask int, part string, digest long")
    return docs, spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, total int")


def test_filter_audit_equals_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(220))
    texts = [long, long + " $", "a " * 250, "SHOUT " * 3, "", None, long.upper(), "x|y", "é" * 40, "word " * 40_000]
    rows = [(k, texts[k % len(texts)], ["en", "de", None, ""][k // 3 % 4]) for k in range(60)]
    rows += [(None, long, "en"), (None, long, "en"), (7, texts[7], "en"), (7, texts[7], "de"), (100, long, "fr")]
    labels = [(k, k % 2, 1 - k % 3 % 2) for k in range(0, 60, 2)] + [(7, None, 1), (7, 1, None), (None, 1, 1), (100, 0, 0)]
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in A.filter_audit(*frames(spark, rows, labels)).collect()}
    assert got == brute(rows, labels)


def test_empty_table(spark):
    assert A.filter_audit(*frames(spark, [], [])).count() == 0


def test_survivors_by_definition():
    counts = np.random.default_rng(3).integers(0, 9, (2, 32))
    want = np.array([[sum(c[m] for m in range(32) if not m & s) for s in range(32)] for c in counts])
    assert (A.survivors(counts) == want).all()
