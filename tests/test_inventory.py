"""Catalogue: admission in dependency order, model identities, versions with one writer each."""

import random

import pytest

from linehaul.operators import inventory as V
from linehaul.scratch import Scratch
from linehaul.sources import artifacts as A

ART, NEED = "id string, fingerprint string", "id string, parent string, fingerprint string"


def brute(artifacts, needs):
    prints = {}
    for i, f in artifacts:
        prints.setdefault(i, set()).add(f)
    good = {}
    while True:
        new = {i: next(iter(f)) for i, f in prints.items() if i not in good and len(f) == 1 and all(good.get(p) == w for j, p, w in needs if j == i)}
        if not new:
            return good
        good |= new


def test_admission_equals_brute_force(spark):
    rng = random.Random(4)
    artifacts = [(f"a{k}", f"f{k}") for k in range(60)] + [("a7", "other")]
    needs = [(f"a{k}", f"a{p}", f"f{p}" if rng.random() < 0.95 else "stale") for k in range(60) for p in rng.sample(range(70), 2) if p < k or rng.random() < 0.05]
    needs += [needs[0], ("a58", "a59", "f59"), ("a59", "a58", "f58"), ("ghost", "a0", "f0")]
    got = V.admit(spark.createDataFrame(artifacts, ART), spark.createDataFrame(needs, NEED)).collect()
    want = brute(artifacts, set(needs))
    assert {r["id"]: r["fingerprint"] for r in got} == want and len(got) == len(want) > 5
    rounds = {r["id"]: r["round"] for r in got}
    assert all(rounds[p] < rounds[i] for i, p, _ in needs if i in rounds) and max(rounds.values()) > 1
    assert V.admit(spark.createDataFrame([], ART), spark.createDataFrame([], NEED)).count() == 0


def test_scan_reads_a_tree(spark):
    root = Scratch(spark, "t").path("tree")
    A.write_json(spark, f"{root}/feeds/x/source.json", {"id": "feed-x", "fingerprint": "fx"})
    A.write_json(spark, f"{root}/data/dataset-manifest.json", {"artifactId": "d", "fingerprint": "fd", "inputArtifacts": [{"artifactId": "feed-x", "fingerprint": "fx"}]})
    A.write_json(spark, f"{root}/models/model.json", {"id": "m", "fingerprint": "fm", "inputArtifacts": [{"artifactId": "d", "fingerprint": "old"}]})
    A.write_json(spark, f"{root}/notes.json", {"id": "n"})
    artifacts, needs = V.scan(spark, root)
    assert {(r["id"], r["kind"]) for r in artifacts.collect()} == {("feed-x", "feed"), ("d", "dataset"), ("m", "model")}
    assert {r["id"] for r in V.admit(artifacts, needs).collect()} == {"feed-x", "d"}


def test_model_identity_never_changes(spark):
    existing = spark.createDataFrame([("m1", "fa" * 20, 1), ("m2", "fb" * 20, 2)], "id string, fingerprint string, created int")
    offers = [("m1", "fa" * 20, 9), ("m1", "fc" * 20, 3), ("m2x", "fb" * 20, 4), ("n", "fd" * 20, 6), ("n", "fe" * 20, 5), (None, "ff" * 20, 7), ("late", "ff" * 20, 8), ("x", None, 1)]
    got = {r["id"]: (r["fingerprint"][:2], r["is_new"]) for r in V.register_models(existing, spark.createDataFrame(offers, "requested string, fingerprint string, created int")).collect()}
    assert got == {"m1": ("fa", False), "m2": ("fb", False), "model-" + "fc" * 8: ("fc", True), "n": ("fe", True), "model-" + "fd" * 8: ("fd", True), "model-" + "ff" * 8: ("ff", True)}
    assert V.alias(existing).first()["candidate"] == "m2"


def test_publication_needs_ready_rows_and_the_version_seen(spark):
    store = V.Versions(spark, Scratch(spark, "t").path("publications"))
    catalogue = spark.createDataFrame([("model", "m", "ready"), ("snapshot", "s", "pending")], "kind string, id string, status string")
    rows = spark.createDataFrame([("model", "m", "en")], "kind string, id string, note string")
    seen = store.latest()
    assert seen == -1 and V.publish(store, rows, catalogue, seen) == 0
    with pytest.raises(RuntimeError, match="has changed"):
        V.publish(store, rows.limit(0), catalogue, seen)
    with pytest.raises(ValueError, match="not ready: snapshot s"):
        V.publish(store, rows.union(spark.createDataFrame([("snapshot", "s", "")])), catalogue, 0)
    assert store.latest() == 0 and store.read().count() == 1 and store.commit(rows.limit(0), 0) == 1 and store.read().count() == 0
