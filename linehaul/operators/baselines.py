"""Baselines of the evaluation: distributed gradient steps and scores per line."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_linear(rows: DataFrame, features: Sequence[str], target: str, iterations: int = 250, rate: float = 0.05, l2: float = 1e-4, from_mean: bool = False) -> tuple[dict[str, tuple[float, float]], list[float], float]:
    """(mean and deviation of each feature, weights, intercept) of full-batch gradient descent on squared error from zero.

    The gradient of squared error needs the second moments alone, so the data are read once, in one aggregate, and the
    iterations run on a matrix as wide as there are features. ``from_mean``: the intercept starts at the mean target.
    """
    names = list(features)
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("y"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).collect()[0]
    scale = {c: (first[f"m_{c}"] or 0.0, max(first[f"s_{c}"] or 0.0, 1e-6)) for c in names}
    if not first["n"]:
        return scale, [0.0] * len(names), 0.0
    z = {c: (F.col(c) - scale[c][0]) / scale[c][1] for c in names}
    second = rows.agg(*[F.avg(z[a] * z[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j], *[F.avg(z[c] * F.col(target)).alias(f"y_{i}") for i, c in enumerate(names)]).collect()[0]
    k = len(names)
    xx = np.array([[second[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    xy = np.array([second[f"y_{i}"] for i in range(k)])
    w, b = np.zeros(k), float(first["y"] or 0.0) if from_mean else 0.0
    for _ in range(iterations):
        w, b = w - rate * (xx @ w - xy + l2 * w), b - rate * (b - first["y"])
    return scale, w.tolist(), float(b)


def linear_score(scale: dict[str, tuple[float, float]], weights: Sequence[float], intercept: float) -> Column:
    return sum((F.lit(w) * (F.col(c) - m) / s for (c, (m, s)), w in zip(scale.items(), weights, strict=True)), F.lit(intercept))


def evaluate(rows: DataFrame, scores: Sequence[str], target: str, k: int) -> DataFrame:
    """(baseline, examples, snapshots, spearman, pairwise_accuracy, top_k_overlap); means over snapshots of two lines or more, pairs pooled.

    ``rows``: snapshot, line, the target and a column for each score.
    """
    from linehaul.operators import metrics as M

    out = None
    for name in scores:
        some = rows.select("snapshot", "line", F.col(name).alias("p"), F.col(target).alias("t"))
        many = some.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
        big = some.join(many.where("n >= 2").select("snapshot"), "snapshot", "left_semi")
        rank, recall, pairs = M.spearman(big, ["snapshot"], "p", "t"), M.top_k_recall(big, ["snapshot"], "p", "t", "line", max(k, 1)), M.pairwise_accuracy(big, ["snapshot"], "p", "t", "line")
        one = many.agg(F.sum("n").alias("examples"), F.count(F.lit(1)).alias("snapshots")).crossJoin(rank.agg(F.avg("spearman").alias("spearman"))).crossJoin(pairs.agg((F.sum(F.col("pairs") * F.col("pairwise_accuracy")) / F.sum("pairs")).alias("pairwise_accuracy"))).crossJoin(recall.agg(F.avg("recall").alias("top_k_overlap")))  # rows of totals
        one = one.select(F.lit(name).alias("baseline"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def random_score(seed: int):
    """A function of (snapshot, line number): a fixed score in [0, 1] by mixing the bytes of the snapshot into the line."""

    @F.pandas_udf("double")
    def run(snapshot: pd.Series, line: pd.Series) -> pd.Series:
        u, texts = np.uint64, [s.encode() for s in snapshot]
        z = u(seed) ^ (line.to_numpy().astype(np.int64).view(u) * u(0x9E3779B97F4A7C15))
        for k in range(max(map(len, texts), default=0)):
            has = np.array([k < len(t) for t in texts])
            x = (z[has] ^ np.array([t[k] for t in texts if k < len(t)], u)) * u(0xBF58476D1CE4E5B9)
            z[has] = (x << u(13)) | (x >> u(51))
        z = z ^ (z >> u(29))
        return pd.Series(z.astype(np.float64) / float(2**64 - 1))

    return run


def cosine_to(features: Sequence[str], centroid: Sequence[float]) -> Column:
    """Cosine of a row's features and a fixed vector; 0 where either is next to nothing."""
    dot = sum((F.col(c) * v for c, v in zip(features, centroid, strict=True)), F.lit(0.0))
    own, other = F.sqrt(sum((F.col(c) * F.col(c) for c in features), F.lit(0.0))), float(np.sqrt(sum(v * v for v in centroid)))
    return F.when((own <= 1e-8) | F.lit(other <= 1e-8), 0.0).otherwise(dot / (own * other))


LEARNED = ("engineered-linear", "handcrafted-cosine")


def evaluation_report(rows: DataFrame, features: Sequence[str], model: str, frequency: str, target: str, split: str, k: int = 10, seed: int = 7) -> DataFrame:
    """``evaluate`` of a model's scores and of the baselines on one split: linear, frequency, cosine to the centroid, random.

    ``rows``: snapshot, line (a number), split, the target, the model's score, the frequency and the features. What is
    fitted sees rows of the split ``train`` alone; with fewer than two of them its metrics are null and ``status`` is
    ``unavailable``. A split without rows is an error. The baseline that is fitted to pairs one after another is not here.
    """
    rows = rows.select("snapshot", "line", "split", F.col(target).cast("double").alias("_t"), F.col(model).cast("double").alias("gnn"), F.col(frequency).cast("double").alias("frequency"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)])
    some = rows if split == "all" else rows.where(F.col("split") == split)
    if not some.limit(1).count():
        raise ValueError(f"no labelled examples in split {split}")
    train, names = rows.where("split = 'train'"), [f"_{i}" for i in range(len(features))]
    fits = train.limit(2).count() >= 2
    scale, weights, intercept = fit_linear(train, names, "_t", rate=0.01, l2=0.0, from_mean=True) if fits else ({c: (0.0, 1.0) for c in names}, [0.0] * len(names), 0.0)
    centroid = [float(v or 0.0) for v in train.agg(*[F.avg(c) for c in names]).collect()[0]]
    scored = some.withColumns({"engineered-linear": linear_score(scale, weights, intercept), "handcrafted-cosine": cosine_to(names, centroid), "random": random_score(seed)("snapshot", "line")})
    out = evaluate(scored, ["gnn", "engineered-linear", "frequency", "handcrafted-cosine", "random"], "_t", k)
    lacks = F.col("baseline").isin(*LEARNED) & F.lit(not fits)
    return out.select("baseline", "examples", "snapshots", *[F.when(lacks, None).otherwise(F.col(c)).alias(c) for c in ("spearman", "pairwise_accuracy", "top_k_overlap")], F.when(lacks, "unavailable").otherwise("ok").alias("status"))
