"""Registered queries against their SQL twins at the smallest scale, and the streams against their batch twins."""

import os

import pytest

import __spark_entry__ as entry
from linehaul import catalogue
from linehaul.streaming import events as E

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = catalogue.queries()[name](spark, DIR)
    got = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(df.columns)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in got.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams(spark, tmp_path):
    log = [{"run": r, "seq": i, "ts": f"2024-01-01T00:{i:02d}:00Z", "type": t, "payload": "{}"} for r in ("a", "b") for i, t in enumerate(("run.started", "step", "checkpoint", "run.finished"))]
    E.append_events(str(tmp_path / "log"), log[:5])
    E.append_events(str(tmp_path / "log"), log[5:] + log[5:6])
    stream = E.read_events(spark, str(tmp_path / "log"))
    for _ in range(2):  # the second run finds nothing new
        E.import_log(stream, str(tmp_path / "table"), str(tmp_path / "cursor")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.count() == 4
    q = E.run_states(E.read_events(spark, str(tmp_path / "log"), own=True)).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["run"], r["status"], r["checkpoints"]) for r in spark.table("states").collect()} == {("a", "run.finished", 1), ("b", "run.finished", 1)}
    assert E.conflicts(table).count() == 0
    assert [r["seq"] for r in E.replay(table, "a", 1).collect()] == [2]


def test_import_keeps_late_runs(spark, tmp_path):
    os.makedirs(tmp_path / "log")
    stream = E.read_events(spark, str(tmp_path / "log"))
    event = lambda run, seq, day: {"run": run, "seq": seq, "ts": f"2024-01-{day:02d}T00:00:00Z", "type": "step", "payload": "{}"}
    for batch in ([event("new", 1, 9)], [event("new", 2, 9)], [event("old", 1, 1), event("new", 1, 9)], [event("old", 1, 1), event("old", 2, 2)]):
        E.append_events(str(tmp_path / "log"), batch)
        E.import_log(stream, str(tmp_path / "table"), str(tmp_path / "cursor")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "table")).select("run", "seq").collect()
    assert sorted((r["run"], r["seq"]) for r in rows) == [("new", 1), ("new", 2), ("old", 1), ("old", 2)]
