"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A feature is present in a text or not. L1 keeps few weights, which go to the workers as sorted index and value arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm import kernels as K
from linehaul.llm.labelled import training_rows

U = np.uint64


@dataclass
class SparseModel:
    """Weights of the features that have one, by feature index in rising order."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray


def features(w: K.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature index) of every word, pair of neighbours and pair with one word between, all within a text."""
    h, n = w.hash, len(w.hash)
    doc = np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))
    shift = U(64 - bits)
    docs, found = [doc], [K.mix(h) >> shift]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if n > gap:
            inside = doc[:-gap] == doc[gap:]
            pair = K.mix(h[:-gap] * U(salt) + (h[gap:] ^ U(salt >> 1))) >> shift
            docs.append(doc[:-gap][inside])
            found.append(pair[inside])
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the bias is one more coordinate without L1."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << self.bits, 0.0, self.l1)
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def examples(rows: DataFrame, bits: int) -> list[tuple[np.ndarray, int]]:
    """(distinct features of the whole text, label) of each row (id, y, text), by id. Features are made in tasks; no text reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in K.each(b.column(2), lower=True, gap=K.NOT_ALNUM):
                doc, at = features(w, bits)
                pair = np.unique(doc << bits | at)
                edge = np.searchsorted(pair >> bits, np.arange(j - i + 1))
                at = (pair & ((1 << bits) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([at[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["id", "y", "at"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", F.col("y").cast("int").alias("y"), "text").mapInArrow(run, f"id {kind}, y int, at binary").toArrow().sort_by("id")
    return [(np.append(np.frombuffer(at, np.int32), np.int32(1 << bits)), y) for at, y in zip(found["at"].to_pylist(), found["y"].to_pylist(), strict=True)]


def train(examples: list[tuple[np.ndarray, int]], bits: int = 22, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1, epochs: int = 4, seed: int = 7) -> SparseModel:
    """A model of (features and bias, label). Rows of label 1, if few, are shown up to six times an epoch, to be a third of the other's."""
    ftrl = Ftrl(bits, alpha, beta, l1, l2)
    ones = [k for k, x in enumerate(examples) if x[1]]
    shows = min(6, max(1, round((len(examples) - len(ones)) / max(1, len(ones)) / 3)))
    deck = np.array([*range(len(examples)), *ones * (shows - 1)], np.int64)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(deck):
            ftrl.learn(*examples[k])
    size, step = (1 << bits) + 1, 1 << 18
    w = np.concatenate([ftrl.weights(np.arange(k, min(k + step, size))) for k in range(0, size, step)])
    index = np.flatnonzero(w[:-1])
    return SparseModel(bits, float(w[-1]), index, w[index].astype(np.float32))


def score_texts(col: pa.Array, model: SparseModel) -> np.ndarray:
    """Probability of each text; a null or empty text has the bias's."""
    dense = getattr(model, "_dense", None)
    if dense is None:
        dense = model._dense = np.zeros(1 << model.bits, np.float32)
        dense[model.index] = model.weight
    out = np.full(len(col), model.bias)
    for i, j, w in K.each(col, lower=True, gap=K.NOT_ALNUM):
        doc, at = features(w, model.bits)
        hit = dense[at] != 0
        pair = np.unique(doc[hit] << model.bits | at[hit])
        out[i:j] += np.bincount(pair >> model.bits, dense[pair & ((1 << model.bits) - 1)], j - i)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def scored(docs: DataFrame, model, id_col: str, text_col: str, score: Callable) -> DataFrame:
    """``(id, score)`` per row of ``docs``; the model is a broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(score(b.column(1), shared.value), np.float64))], ["id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], max_train_rows: int = 12_000, bits: int = 22, **training) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``, from its text alone.

    Learns from the whole texts of at most ``max_train_rows`` labelled rows for which ``held_out`` is false; the driver
    holds their distinct features, at most 2**``bits`` each. Scores every whole text, however long. Null and empty
    texts score the bias. Repeated rows score alike; rows of one id are scored by the text of each. Without labels
    every score is the bias's, 0.5. An empty table gives an empty result.
    """
    rows = training_rows(docs, labels, "toxic", max_train_rows, held_out)
    out = scored(docs, train(examples(rows, bits), bits, **training), "doc_id", "text", score_texts)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
