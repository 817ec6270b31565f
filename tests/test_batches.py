"""Label batches that stop and go on, verification of a ranking's head, predictions."""

import numpy as np
import pytest

from linehaul.operators import batches as B
from linehaul.operators import inference as I
from linehaul.operators import router as R
from linehaul.scratch import Scratch
from linehaul.sources import artifacts as A

CALL = "trip_id string, line string, station int, pos int, arrival int, departure int, pickup int, drop_off int"


@pytest.fixture(scope="module")
def network(spark):
    rows, k = [], 0
    for line, stops in (("a", (0, 1, 2)), ("b", (2, 3)), ("c", (0, 3)), ("d", (1, 3))):
        for start in (0, 600, 1200):
            rows += [(f"{line}{k}", line, s, p, start + p * 300, start + p * 300 + 30, 0, 0) for p, s in enumerate(stops)]
            k += 1
    queries = spark.createDataFrame([(0, 0, 0, None, None, None, None), (1, 1, 100, None, None, None, None)], R.QUERY)
    walks = spark.createDataFrame([(2, 3, 100)], "from_station int, to_station int, seconds int")
    return spark.createDataFrame(rows, CALL).cache(), walks, queries


def plain(df):
    return sorted(map(str, df.select(*sorted(set(df.columns) - {"router_algorithm_version", "policy_fingerprint"})).collect()))


def test_batch_stopped_and_resumed_equals_one_run(spark, network, monkeypatch):
    calls, walks, queries = network
    lines, scratch = calls.select("line").distinct(), Scratch(spark, "t")
    one = B.removal_labels(calls, walks, queries, lines, 4, 3, 7200, scratch)
    make = lambda folder, **how: B.LabelBatch(spark, folder, "s", calls, walks, queries, 4, **{"rides": 3} | how)
    folder = scratch.path("batch")
    batch = make(folder)
    assert batch.labels() is None and batch.run(lines, step=1, most_steps=2) == 2 and batch.status(lines) == "in-progress"
    first = plain(batch.labels())
    asked = []
    route = R.one_to_all
    monkeypatch.setattr(R, "one_to_all", lambda c, w, q, *a, **k: (asked.append(q.count()), route(c, w, q, *a, **k))[1])
    again = make(folder)
    assert again.run(lines, step=3) == 2 and again.run(lines) == 0 and again.status(lines) == "committed"
    assert asked == [2 * queries.count()]  # two lines' removals, no baseline and no committed line
    assert plain(again.labels()) == plain(one) and set(first) < set(plain(one))
    for other in (dict(rides=2), dict(cap=600), dict(thresholds=(60,))):
        with pytest.raises(ValueError, match="another batch"):
            make(folder, **other)
    with pytest.raises(ValueError, match="another batch"):
        B.LabelBatch(spark, folder, "s", calls, walks, queries.limit(1), 4, 3)
    # an attempt that did not finish is not seen
    one.limit(1).withColumn("line", one["removed"]).write.parquet(f"{folder}/_attempts/dead")
    assert plain(make(folder).labels()) == plain(one)


def test_second_writer_of_a_line_keeps_the_first(spark, network):
    calls, walks, queries = network
    folder, lines = Scratch(spark, "t").path("batch"), spark.createDataFrame([("a",)], "line string")
    x, y = (B.LabelBatch(spark, folder, "s", calls, walks, queries, 4, 3) for _ in range(2))
    monkey = y.open_lines(lines).collect()
    assert x.run(lines) == 1 and [r["line"] for r in monkey] == ["a"]
    y.open_lines = lambda _: lines  # y looked before x committed
    assert y.run(lines) == 1 and x.labels().count() == 1


def test_verify_top_routes_the_head_alone(spark, network, monkeypatch):
    calls, walks, queries = network
    ranked = spark.createDataFrame([("d", 1, 0.2), ("b", 0, 0.9), ("a", 2, 0.1)], "line string, place long, guess double")
    scratch, asked, route = Scratch(spark, "t"), [], R.one_to_all
    monkeypatch.setattr(R, "one_to_all", lambda c, w, q, *a, **k: (asked.append(q.count()), route(c, w, q, *a, **k))[1])
    got = B.verify_top(ranked, 2, calls, walks, queries, 4, 3, 7200).collect()
    assert asked == [queries.count(), 2 * queries.count()]
    exact = {r["removed"]: r["accessibility_auc_loss"] for r in B.removal_labels(calls, walks, queries, calls.select("line").distinct(), 4, 3, 7200, scratch).collect()}
    assert {r["line"]: r["accessibility_auc_loss"] for r in got} == {x: exact[x] for x in "bd"} and {r["guess"] for r in got} == {0.9, 0.2}


def test_json_documents_and_renames(spark):
    folder = Scratch(spark, "t").path("docs")
    A.write_json(spark, f"{folder}/x.json", {"a": [1, "é"]})
    A.write_json(spark, f"{folder}/x.json", {"a": [1, "é"]})
    assert A.read_json(spark, f"{folder}/x.json") == {"a": [1, "é"]}
    with pytest.raises(FileExistsError):
        A.write_json(spark, f"{folder}/x.json", {"a": 2})
    spark.range(1).write.parquet(f"{folder}/one")
    spark.range(2).write.parquet(f"{folder}/two")
    assert A.rename_once(spark, f"{folder}/one", f"{folder}/at/here") and not A.rename_once(spark, f"{folder}/two", f"{folder}/at/here")
    assert spark.read.parquet(f"{folder}/at/here").count() == 1 and A.folders(spark, folder) == ["at", "two"]


def test_predictions_clamp_rank_and_count_ties(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [-1.0, 0.5])], "line string, x array<double>")
    p = I.predict(rows, np.array([[1.0, 0.0]] * 6), np.zeros(6))
    got = {r["line"]: r["metrics"] for r in p.collect()}
    assert got["a"] == [1, 1, 3600, 3600, 1, 1] and got["c"] == [0.0] * 6
    share = {(r["line"], r["metric"]): r["percentile"] for r in I.metric_percentiles(p).collect()}
    assert share["a", I.METRICS[0]] == 1 and abs(share["c", I.METRICS[2]] - 1 / 3) < 1e-12
    assert {r["line"]: r["place"] for r in I.rank_by(p).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(Exception, match="takes 3 inputs"):
        I.predict(rows, np.zeros((6, 3)), np.zeros(6)).collect()


def test_table_digest_ignores_order_alone(spark):
    x = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert B.table_digest(x) == B.table_digest(x.orderBy("v", ascending=False).select("v", "k"))
    assert B.table_digest(x) != B.table_digest(x.distinct()) and B.table_digest(x.limit(0))
