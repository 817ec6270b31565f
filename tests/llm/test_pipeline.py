"""The corpus pipeline over the smallest tables, stage by stage."""

import os
import re

import pytest

import corpus_pipeline

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_stages(spark, tmp_path):
    docs = first = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(names):
            assert docs.schema.simpleString() == first.schema.simpleString()
        kept.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    start = {r["doc_id"]: r["text"] for r in first.select("doc_id", "text").collect()}
    quality, near, sub, clean, mixed = kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in quality for i in good) >= 0.95 * len(good) and quality.items() <= start.items()
    # exact copies: one of each is left
    texts = [" ".join(WORD.findall(t)) for t in near.values()]
    assert len(set(texts)) == len(texts) and {" ".join(WORD.findall(t)) for t in quality.values()} >= set(texts)
    # no window of fifty words starts in two documents any more
    assert set(sub) == set(near)
    seen: dict[tuple, int] = {}
    for i in sorted(near):
        w = WORD.findall(near[i])
        gone = set()
        for p in range(len(w) - 49):
            if seen.setdefault(tuple(w[p : p + 50]), i) != i:
                gone |= set(range(p, p + 50))
        assert WORD.findall(sub[i]) == [x for k, x in enumerate(w) if k not in gone]
    # no benchmark item as a whole is left
    plain = lambda t: " ".join(x for x in re.split(r"[^\w]+", t.lower()) if x)
    items = [plain(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert clean.items() <= sub.items() and not any(item in plain(t) for t in clean.values() for item in items)
    assert len(clean) >= 0.8 * len(sub)
    assert mixed.items() <= clean.items()
    out = docs.selectExpr("sum(taken)", "max(taken / size)").collect()[0]
    assert out[1] <= 3 and abs(out[0] - sum(len(WORD.findall(t)) for t in clean.values())) <= 0.01 * out[0]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
