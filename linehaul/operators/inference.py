"""Predicted impacts of lines: a linear head over line vectors, ranks and percentiles, and how odd a line's features are."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linehaul.functions.scalars import denormalize_targets
from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch

#: Fixed order of the predicted metrics.
METRICS = ("accessibility_auc_loss", "unreachable_share", "mean_delay_reachable_seconds", "p95_delay_reachable_seconds", "mean_extra_transfers", "stations_losing_all_service_share")
LINE_DECODER_SEED = 151


def linear(weights: np.ndarray, bias: np.ndarray):
    """A function of a vector column: weights (outputs x inputs) times the vector, plus bias. Another length is an error.

    The arrays go to the tasks with the function: they are a model's parameters, as large as one layer.
    """

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        if any(len(x) != weights.shape[1] for x in v):
            raise ValueError(f"the head takes {weights.shape[1]} inputs")
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, weights.shape[1]))
        return pd.Series(list(x @ weights.T + bias))

    return run


def rule_head(rule: Callable[[np.ndarray, np.ndarray], np.ndarray], inputs: int) -> tuple[np.ndarray, np.ndarray]:
    """A head whose weights follow a rule over (output, input), without bias."""
    return rule(np.arange(len(METRICS))[:, None], np.arange(inputs)[None, :]), np.zeros(len(METRICS))


def head_inputs(lines: DataFrame, city: DataFrame, features: DataFrame) -> DataFrame:
    """(line, x): a line's vector, the city's and its own features one after another. ``city`` is one row."""
    return lines.join(features, "line").crossJoin(F.broadcast(city)).select("line", F.concat("v", "city", F.transform("features", lambda x: x.cast("double"))).alias("x"))


def predict(inputs: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(line, metrics): predictions in their own units, 0 at least, in the order of ``METRICS``."""
    raw = inputs.select("line", linear(weights, bias)("x").alias("raw"))
    return raw.select("line", F.transform(denormalize_targets(F.col("raw")), lambda x: F.greatest(x, F.lit(0.0))).alias("metrics"))


def metric_percentiles(predictions: DataFrame) -> DataFrame:
    """(line, metric, value, percentile): the share of lines whose value is not larger.

    Lines are counted by value, so that ties and common values (clamped zeros) are one row of the running sum.
    """
    names = F.array(*[F.lit(m) for m in METRICS])
    long = predictions.select("line", F.explode(F.arrays_zip(names.alias("metric"), F.col("metrics").alias("value"))).alias("m")).select("line", "m.metric", "m.value")
    counts = long.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("metric")
    shares = counts.select("metric", "value", (F.sum("_n").over(w.orderBy("value")) / F.sum("_n").over(w)).alias("percentile"))
    return long.join(shares, ["metric", "value"]).select("line", "metric", "value", "percentile")


def decoded(vector: Column, width: int, seed: int = LINE_DECODER_SEED) -> Column:
    """The features that a vector stands for, by the fixed decoder."""
    place = lambda o: F.aggregate(F.transform(vector, lambda x, i: x * F.cos((i + 1) * (o + seed + 1) * 0.013) * 0.1), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), place)


def uniqueness(lines: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """(line, uniqueness): the mean absolute residual of a line's features after decoding its vector."""
    gaps = F.zip_with("features", decoded(F.col("v"), width), lambda a, b: F.abs(a - b))
    return lines.join(features, "line").select("line", (F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / width).alias("uniqueness"))


def rank_by(predictions: DataFrame, place: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """``predictions`` with ``place`` from 0: by a metric downwards, equal ones by line. No task orders all of them."""
    key = F.get("metrics", F.lit(place))
    return numbered(predictions, [F.coalesce(key, F.lit(0.0)).desc(), F.col("line")], "place", scratch or Scratch(predictions.sparkSession, "rank"))
