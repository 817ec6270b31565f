"""Random networks against an exhaustive router."""

import random
import re

import pytest

from linehaul.operators import router as R
from linehaul.scratch import Scratch

CALL = "trip_id int, line string, station int, pos int, arrival int, departure int, pickup int, drop_off int"


def make(seed):
    rng = random.Random(seed)
    n, calls, trip = rng.randint(3, 7), [], 0
    for line in range(rng.randint(1, 4)):
        stops = [rng.randrange(n) for _ in range(rng.randint(2, 5))]
        for _ in range(rng.randint(1, 4)):
            t = rng.randint(0, 3000)
            for pos, s in enumerate(stops):
                dwell = rng.randrange(90)
                calls.append((trip, f"L{line}", s, pos, t, t + dwell, int(rng.random() < 0.05), int(rng.random() < 0.05)))
                t += dwell + rng.randint(30, 700)
            trip += 1
    walks = {}
    for _ in range(rng.randint(0, 2 * n)):
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            walks[a, b] = min(walks.get((a, b), 10**9), rng.randint(30, 600))
    return n, calls, walks


def exhaustive(n, calls, walks, origin, start, rides, cap, disabled, closed):
    def walk(reach):
        best = dict(reach)
        todo = list(best)
        while todo:
            s = todo.pop()
            for (a, b), sec in walks.items():
                if a == s and closed not in (a, b) and best[s] + sec <= start + cap and best[s] + sec < best.get(b, 10**9):
                    best[b] = best[s] + sec
                    todo.append(b)
        return best

    trips = {}
    for c in calls:
        trips.setdefault(c[0], []).append(c)
    if origin == closed:
        return {}
    reach = walk({origin: start})
    found = {s: (t, 0) for s, t in reach.items()}
    for k in range(1, rides + 1):
        new = {}
        for rows in trips.values():
            on = False
            for c in sorted(rows, key=lambda c: c[3]):
                if on and c[7] != 1 and c[2] != closed and start <= c[4] <= start + cap:
                    new[c[2]] = min(new.get(c[2], 10**9), c[4])
                if c[6] != 1 and c[2] != closed and c[1] not in disabled and c[5] >= reach.get(c[2], 10**9):
                    on = True
        reach = walk(new)
        if not reach:
            break
        for s, t in reach.items():
            found[s] = min(found.get(s, (10**9, 99)), (t, k))
    return {s: (t, max(k - 1, 0)) for s, (t, k) in found.items()}


@pytest.mark.parametrize("seed", range(4))
def test_agrees_with_the_exhaustive_router(spark, seed):
    n, calls, walks = make(seed)
    df = spark.createDataFrame(calls, CALL).cache()
    tr = spark.createDataFrame([(a, b, s) for (a, b), s in walks.items()], "from_station int, to_station int, seconds int")
    queries, want = [], {}
    for i, (origin, start, disabled, closed) in enumerate((o, t, d, c) for o in range(min(n, 2)) for t in (0, 1500) for d, c in ((None, None), (["L0"], None), (None, n - 1))):
        queries.append((i, origin, start, disabled, closed, None, None))
        want[i] = exhaustive(n, calls, walks, origin, start, 3, 3600, disabled or [], closed)
    got = {}
    for r in R.one_to_all(df, tr, spark.createDataFrame(queries, R.QUERY), 3, 3600).collect():
        got.setdefault(r["query_id"], {})[r["station"]] = (r["arrival"], r["transfers"])
    assert got == {k: v for k, v in want.items() if v}


def test_retained_trips(spark):
    from pyspark.sql import functions as F

    rows = spark.range(6).select(R.retained(F.col("id"), F.lit(6), F.lit(0.5)).alias("k")).collect()
    assert [r["k"] for r in rows] == [True, False, True, False, True, False]


def test_rides_are_joined_in_as_many_tasks_as_rows_fill(spark, monkeypatch):
    n, calls, walks = make(1)
    df = spark.createDataFrame(calls, CALL).cache()
    tr = spark.createDataFrame([(a, b, s) for (a, b), s in walks.items()], "from_station int, to_station int, seconds int")
    queries = spark.createDataFrame([(0, 0, 0, None, None, None, None), (1, 1, 1500, ["L0"], None, None, None)], R.QUERY)
    asked, table = [], Scratch.table

    def seen(self, t, name="t"):
        if name == "reach":
            asked.append(re.findall(r"hashpartitioning\(trip_id#\d+L?, (\d+)\)", t._jdf.queryExecution().executedPlan().toString()))
        return table(self, t, name)

    rows = lambda **how: sorted(map(tuple, R.one_to_all(df, tr, queries, 2, 3600, **how).collect()))
    want = rows()
    monkeypatch.setattr(Scratch, "table", seen)
    # a row to a task: every boarding and place to get off counts, and both sides of the join have the same tasks
    assert rows(at_once=1) == want != []
    first, *rounds = asked
    assert first == [] and rounds and all(len(set(r)) == 1 and int(r[0]) > 4 for r in rounds)  # the session's shuffle partitions


def test_calls_are_derived_once(spark):
    n, calls, walks = make(1)
    read = spark.sparkContext.accumulator(0)

    def derive(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(calls, CALL)
    df = df.mapInArrow(derive, df.schema)
    tr = spark.createDataFrame([(a, b, s) for (a, b), s in walks.items()], "from_station int, to_station int, seconds int")
    R.one_to_all(df, tr, spark.createDataFrame([(0, 0, 0, None, None, None, None)], R.QUERY), 2, 3600).collect()
    assert read.value == len(calls)
