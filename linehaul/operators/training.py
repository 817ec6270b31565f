"""Gradients of the linear decoders, summed over rows and graphs, and the step taken from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decoder_gradients(rows: DataFrame, weights: DataFrame, width: int) -> DataFrame:
    """(part, output, targets, loss, bias_gradient, weight_gradient): sums of the error and of error times vector.

    ``rows``: part (station or line), vector of ``width`` places, features, of all masked rows of all graphs whose
    gradients are accumulated. ``weights``: part, output from 0, weights, bias; a row for each feature, which bounds it.
    Every place of a gradient is a sum, combined on the map side, so a task hands on a row for each output. Rows with a
    null vector or feature count nothing; outputs without targets are not returned, and no rows give an empty table.
    """
    at = lambda c, i: F.get(c, F.lit(i))
    targets = rows.select("part", "vector", F.posexplode("features").alias("output", "target")).where("vector IS NOT NULL AND target IS NOT NULL")
    error = sum((at("weights", i) * at("vector", i) for i in range(width)), F.col("bias")) - F.col("target")
    errors = targets.join(F.broadcast(weights), ["part", "output"]).select("part", "output", "vector", error.alias("e"))
    sums = [F.sum(F.col("e") * at("vector", i)) for i in range(width)]
    return errors.groupBy("part", "output").agg(F.count("e").alias("targets"), F.sum(F.col("e") * F.col("e")).alias("loss"), F.sum("e").alias("bias_gradient"), F.array(*sums).alias("weight_gradient"))


def decoder_step(weights: DataFrame, gradients: DataFrame, rate: float, decay: float) -> DataFrame:
    """``weights`` after one step; gradients are divided by all targets of both parts. Biases do not decay.

    Outputs without a gradient only decay.
    """
    total = gradients.agg(F.greatest(F.coalesce(F.sum("targets"), F.lit(0)), F.lit(1)).alias("total"))
    both = weights.join(gradients, ["part", "output"], "left").crossJoin(F.broadcast(total))  # one row
    step = lambda w, g: w - rate * (F.coalesce(g, F.lit(0.0)) / F.col("total") + decay * w)
    moved = F.when(F.col("weight_gradient").isNull(), F.transform("weights", lambda w: step(w, F.lit(0.0)))).otherwise(F.zip_with("weights", "weight_gradient", step))
    return both.select("part", "output", moved.alias("weights"), (F.col("bias") - rate * F.coalesce("bias_gradient", F.lit(0.0)) / F.col("total")).alias("bias"))
