"""One accumulated step of the decoders against numpy."""

import numpy as np
import pytest

from linehaul.operators.training import decoder_gradients, decoder_step

ROWS, WEIGHTS = "part string, vector array<double>, features array<double>", "part string, output int, weights array<double>, bias double"


def test_accumulated_step_equals_numpy(spark):
    rng = np.random.default_rng(3)
    width, outputs = 4, {"station": 5, "line": 3}
    data = {p: (rng.normal(size=(n, width)), rng.normal(size=(n, outputs[p]))) for p, n in (("station", 60), ("line", 25))}
    w = {p: (rng.normal(size=(k, width)), rng.normal(size=k)) for p, k in outputs.items()}
    rows = [(p, v.tolist(), f.tolist()) for p, (vs, fs) in data.items() for v, f in zip(vs, fs, strict=True)]
    weights = spark.createDataFrame([(p, o, w[p][0][o].tolist(), float(w[p][1][o])) for p in w for o in range(outputs[p])], WEIGHTS)
    # two graphs whose rows lie apart, and rows that count nothing
    some, others = spark.createDataFrame(rows[::2], ROWS), spark.createDataFrame([*rows[1::2], ("line", None, [1.0] * 3), ("line", [1.0] * 4, [None] * 3), ("line", [1.0] * 4, None)], ROWS)
    got = decoder_gradients(some.unionByName(others), weights, width)
    total = sum(f.size for _, f in data.values())
    moved = {(r["part"], r["output"]): r for r in decoder_step(weights, got, 0.1, 0.01).collect()}
    grads = {(r["part"], r["output"]): r for r in got.collect()}
    for p, (v, f) in data.items():
        e = v @ w[p][0].T + w[p][1] - f
        for o in range(outputs[p]):
            g = grads[p, o]
            assert g["targets"] == len(f) and g["loss"] == pytest.approx((e[:, o] ** 2).sum())
            assert g["weight_gradient"] == pytest.approx((e.T @ v)[o].tolist()) and g["bias_gradient"] == pytest.approx(e[:, o].sum())
            assert moved[p, o]["weights"] == pytest.approx((w[p][0][o] - 0.1 * ((e.T @ v)[o] / total + 0.01 * w[p][0][o])).tolist())
            assert moved[p, o]["bias"] == pytest.approx(w[p][1][o] - 0.1 * e[:, o].sum() / total)


def test_no_rows_only_decay(spark):
    weights = spark.createDataFrame([("line", 0, [1.0, 2.0], 3.0)], WEIGHTS)
    none = decoder_gradients(spark.createDataFrame([], ROWS), weights, 2)
    assert none.count() == 0
    row = decoder_step(weights, none, 0.5, 0.1).collect()[0]
    assert row["weights"] == pytest.approx([0.95, 1.9]) and row["bias"] == 3.0
