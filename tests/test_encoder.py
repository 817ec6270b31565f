"""Encoder and facets against plain numpy on a small network."""

import math

import numpy as np
import pytest

from linehaul.operators import encoder as E
from linehaul.operators import facets as FA
from linehaul.operators import network as N

W = 4


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(6)
    vec = lambda n, k: [[float(x) for x in row] for row in rng.random((n, k))]
    stations, lines = range(5), ["a", "b", "c"]
    parts = {
        "station_features": (list(zip(stations, vec(5, 16), strict=True)), "station int, features array<double>"),
        "line_features": (list(zip(lines, vec(3, 18), strict=True)), "line string, features array<double>"),
        "station_channels": ([(s, vec(4, 128)) for s in (0, 1, 2)], "station int, channels array<array<double>>"),
        "line_channels": ([(x, vec(4, 128)) for x in ("a", "b")], "line string, channels array<array<double>>"),
        "serves": ([(0, "a"), (1, "a"), (2, "a"), (1, "b"), (3, "b")], "station int, line string"),
        "transfers": ([(0, 3), (3, 0), (1, 2)], "from_station int, to_station int"),
        "edge_features": ([(0, 1, "a", [0.1] * 4 + [0.0, 1.0, 0.5]), (1, 2, "a", [0.3] * 4 + [0.99, 0.2, 0.5]), (1, 3, "b", [0.7] * 4 + [0.5, 0.1, 0.1])], "from_station int, to_station int, line string, features array<double>"),
        "interchanges": ([("a", "b"), ("b", "a")], "line string, other string"),
        "line_patterns": ([("a", [0, 1, 2], [0, 1, 0], [3, 0, 0], 5), ("a", [0, 2], [0, 0], [0, 0], 1), ("b", [1, 3], [0, 0], [0, 2], 2)], "line string, stops array<int>, pickups array<int>, drop_offs array<int>, trips long"),
    }
    return {k: spark.createDataFrame(*v) for k, v in parts.items()}, {k: v[0] for k, v in parts.items()}


def brute(p, layers):
    def project(x, seed):
        return np.tanh([sum(v * math.sin((i + seed + 1) * (o + 1) * 0.017) * 0.05 for i, v in enumerate(x)) for o in range(W)])

    def first(kind, seed):
        ch = dict(p[f"{kind}_channels"])
        return {k: project([*f, *([y for c in ch[k] for y in (sum(c) / 128, max(0, *c))] if k in ch else [0.0] * 8)], seed) for k, f in p[f"{kind}_features"]}

    s, t = first("station", 17), first("line", 31)
    edge = {(a, b, x): f for a, b, x, f in p["edge_features"]}
    context = {x: np.zeros(W) for x in t}
    for x in t:
        mine = [q for q in p["line_patterns"] if q[0] == x]
        for _, stops, up, down, trips in mine:
            state = np.zeros(W)
            for k, at in enumerate(stops):
                f = edge.get((at, stops[k + 1], x), [0.0]) if k + 1 < len(stops) else [0.0]
                place = k / max(len(stops) - 1, 1)
                state = np.tanh([0.58 * state[i] + 0.34 * s[at][i] + 0.08 * f[i % len(f)] + 0.03 * sum(v * math.sin((i + 1) * (j + 1) * 0.37) for j, v in enumerate((up[k] / 3, down[k] / 3, place))) + 0.05 * t[x][i] + 0.002 * place for i in range(W)])
            context[x] += state * trips / sum(q[4] for q in mine)
    t = {x: np.tanh(v + 0.22 * context[x]) for x, v in t.items()}
    mean = lambda rows: np.mean(rows, axis=0) if rows else np.zeros(W)
    for layer in range(layers):
        wave = lambda z: np.sin(np.arange(W) * 0.0001 + z * 0.01) * 0.001
        ns = {k: np.tanh(0.58 * v + 0.14 * mean([t[x] for a, x in p["serves"] if a == k]) + 0.12 * mean([s[a] for a, b in p["transfers"] if b == k]) + 0.16 * mean([0.5 * s[a] + 0.25 * t[x] + 0.001 * np.resize(f, W) for a, b, x, f in p["edge_features"] if b == k]) + wave(layer)) for k, v in s.items()}
        t = {x: np.tanh(0.58 * v + 0.2 * mean([s[a] for a, y in p["serves"] if y == x]) + 0.14 * mean([t[a] for a, b in p["interchanges"] if b == x]) + wave(layer + 0.5)) for x, v in t.items()}
        s = ns
    pool = lambda d: [np.mean(list(d.values()), axis=0), np.maximum(0, np.max(list(d.values()), axis=0))]
    return s, t, sum(pool(s) + pool(t)) / 4


def test_encode_equals_numpy(spark, graph):
    frames, plain = graph
    got, (s, t, city) = E.encode(frames, W, 3), brute(plain, 3)
    for name, key, want in (("stations", "station", s), ("lines", "line", t)):
        rows = {r[key]: r["v"] for r in got[name].collect()}
        assert rows.keys() == want.keys() and all(np.allclose(rows[k], want[k], atol=1e-12) for k in rows)
    assert np.allclose(got["city"].first()["city"], city)


def test_facets_are_unit_vectors_of_fixed_shape(spark, graph):
    frames, _ = graph
    raw = FA.raw_facets(frames, E.encode(frames, W, 1), W)
    sizes = {len(r["service"]): len(r["geometry"]) for r in raw.collect()}
    assert sizes == {18 + 512 + 16: 16 * 7 + 7 + 4}
    rows = FA.project_facets(raw).collect()
    assert {r["line"] for r in rows} == {"a", "b", "c"}
    for r in rows:
        for name, width in FA.WIDTHS.items():
            assert len(r[name]) == width and abs(np.linalg.norm(r[name]) - 1) < 1e-9
    x = np.array(next(r["geometry"] for r in raw.collect() if r["line"] == "a"))
    o, i = np.arange(FA.WIDTHS["geometry"])[None, :], np.arange(len(x))[:, None]
    angle = (i + 1) * (o + 1) * ((73 + 29) * 0.001 + 0.017)
    y = np.tanh((x / (1 + abs(x)) / math.sqrt(len(x))) @ (np.sin(angle) + 0.5 * np.cos(0.61 * angle)))
    assert np.allclose(next(r["geometry"] for r in rows if r["line"] == "a"), y / np.linalg.norm(y))


def test_matrix_product_of_empty_and_mixed_lengths(spark):
    f = E.matrix_product(lambda i, o: i + 2.0 * o, 3)
    got = [r["y"] for r in spark.createDataFrame([([],), ([1.0],), ([1.0, -1.0],)], "x array<double>").coalesce(1).select(f("x").alias("y")).collect()]
    assert np.allclose(got, [[0, 0, 0], np.tanh([0.0, 2.0, 4.0]), np.tanh([-1.0, -1.0, -1.0])])


def test_gap_medians_of_ties(spark):
    rows = [("a", 10), ("a", 10), ("a", 10), ("a", 40), ("b", 5), ("c", 1), ("c", 4)]
    got = E.gap_medians(spark.createDataFrame(rows, "k string, t int"), ["k"], "t", "m").collect()
    assert {r["k"]: r["m"] for r in got} == {"a": 0, "c": 3}


def test_channels_count_every_call(spark):
    calls = spark.createDataFrame([("t", "a", 1, 0, 0, 30), ("t", "a", 2, 1, 900, 930), ("u", "b", 1, 0, 10, 20), ("u", "b", 2, 1, 200_000, 200_100)], "trip_id string, line string, station int, pos int, arrival int, departure int")
    got = {r["station"]: r["channels"] for r in E.temporal_channels(calls, "station").collect()}
    assert got[1][0][0] == 2 and got[1][2][0] == 2 and got[1][3][0] == 10 and got[2][1][127] == 1 and sum(map(sum, got[2])) == 6
    lines = {r["line"]: r["channels"] for r in E.temporal_channels(calls, "line").collect()}
    assert lines["a"][0][0] == lines["a"][1][0] == lines["a"][2][0] == 1 and sum(map(sum, lines["a"])) == 3


def test_weighted_upper_median(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 5, 2), ("b", 7, 1)], "k string, v int, n int")
    assert {r["k"]: r["m"] for r in N.weighted_upper_median(rows, ["k"], "v", "n", "m").collect()} == {"a": 5, "b": 7}
