"""Quality classifier: a byte-level convolutional network in numpy.

A filter's response at a byte is the sum of one learned value for each of the bytes it covers, so the convolution is
table look-ups. Overlapping chunks cover the whole text; each chunk keeps its largest response per filter; the
text's features are the mean and the largest of the chunks' values, combined by a logistic output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm import kernels as K
from linehaul.llm.labelled import drawn, training_rows
from linehaul.llm.toxicity import scored


@dataclass
class ByteCnn:
    """table: (width, 256, filters), an even width; bias: (filters,); out: (2 * filters,); chunk and overlap in bytes."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    chunk: int = 256
    overlap: int = 32


def bordered(data: np.ndarray, offsets: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``gap`` zero bytes after each, and where they begin: no response reads the next text."""
    n = np.diff(offsets)
    begin = offsets[:-1] + np.arange(len(n)) * gap
    out = np.zeros(len(data) + len(n) * gap, np.uint8)
    out[K.ranges(begin, n)] = data
    return out, begin


def chunks(begin: np.ndarray, n: np.ndarray, chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the overlapping chunks that cover every text of n bytes; an empty text has none."""
    step = chunk - overlap
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - chunk) // step)), 0)
    text = np.repeat(np.arange(len(n)), count)
    start = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    return text, start, np.minimum(start + chunk, (begin + n)[text])


def pair_tables(table: np.ndarray) -> np.ndarray:
    """(filters, width / 2, 65536): a filter's value for each pair of neighbouring bytes. width is even."""
    width, _, filters = table.shape
    pairs = table[0::2, :, None, :] + table[1::2, None, :, :]
    return np.ascontiguousarray(pairs.reshape(width // 2, 65536, filters).transpose(2, 0, 1))


def responses(data: np.ndarray, begin: np.ndarray, size: np.ndarray, m: ByteCnn, tables: np.ndarray, totals: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk its text, start, end and its largest response of each filter (before the bias); data is bordered.

    ``totals``, if given, gets every filter's response at every byte.
    """
    text, start, end = chunks(begin, size, m.chunk, m.overlap)
    filters, half, _ = tables.shape
    n = len(data)
    padded = np.zeros(n + 2 * half + 1, np.int64)
    padded[:n] = data
    pair = padded[:-1] << 8 | padded[1:]
    best = np.empty((filters, len(text)), np.float32)
    edges = np.empty(2 * len(text), np.int64)
    edges[::2], edges[1::2] = start, end
    total, more = np.empty(n + 1, np.float32), np.empty(n, np.float32)
    total[n] = -1e30
    for f in range(filters):  # one filter at a time: the arrays stay in the cache
        np.take(tables[f, 0], pair[:n], out=total[:n], mode="clip")
        for k in range(1, half):
            np.take(tables[f, k], pair[2 * k : 2 * k + n], out=more, mode="clip")
            total[:n] += more
        if totals is not None:
            totals.append(total[:n].copy())
        best[f] = np.maximum.reduceat(total, edges)[::2] if len(text) else 0
    return text, start, end, best.T


def _pool(text: np.ndarray, best: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with chunks, the features of all, chunk index of each text's largest value)."""
    filters = best.shape[1]
    feats = np.zeros((n, 2 * filters), np.float32)
    have, first = np.unique(text, return_index=True)
    if len(have):
        feats[have, :filters] = np.add.reduceat(best, first, axis=0) / np.diff(np.append(first, len(text)))[:, None]
        feats[have, filters:] = np.maximum.reduceat(best, first, axis=0)
    return have, feats, first


def predict(data: np.ndarray, offsets: np.ndarray, m: ByteCnn, tables: np.ndarray) -> np.ndarray:
    """Probability of each text; an empty text has the output's bias alone."""
    data, begin = bordered(data, offsets, len(m.table) - 1)
    text, _, _, best = responses(data, begin, np.diff(offsets), m, tables)
    best = np.maximum(best + m.bias, 0)
    _, feats, _ = _pool(text, best, len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip((feats * m.out).sum(1) + m.out_bias, -35, 35).astype(np.float64)))


def score_texts(col: pa.Array, m: ByteCnn) -> np.ndarray:
    data, offsets = K.text_bytes(col)
    out, tables = np.empty(len(col)), pair_tables(m.table)
    for i, j in K.pieces(offsets, 1 << 16):
        out[i:j] = predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], m, tables)
    return out


def train(rows: list[tuple[str, int]], filters: int = 12, width: int = 6, epochs: int = 16, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, good_share: float = 0.7, seed: int = 7) -> ByteCnn:
    """Adam on the logistic loss, label 1 weighing ``good_share`` of it; gradients flow to the bytes of each largest response."""
    rng = np.random.default_rng(seed)
    m = ByteCnn(rng.normal(0, 0.3, (width, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.3, 2 * filters).astype(np.float32), 0.0)
    y = np.array([label for _, label in rows], np.float64)
    if len(set(y)) < 2:
        m.out[:] = 0
        m.out_bias = (4.0 if y[0] else -4.0) if len(y) else 0.0
        return m
    data, offsets = K.text_bytes(pa.array([t for t, _ in rows], pa.string()))
    weight = np.where(y == 1, good_share / y.sum(), (1 - good_share) / (1 - y).sum()) * len(y)
    params = [m.table, m.bias, m.out, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        for ids in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            size = offsets[ids + 1] - offsets[ids]
            part, at = data[K.ranges(offsets[ids], size)], np.concatenate([[0], np.cumsum(size)])
            totals: list[np.ndarray] = []
            part, at = bordered(part, at, width - 1)
            text, start, end, raw = responses(part, at, size, m, pair_tables(m.table), totals)
            best = np.maximum(raw + m.bias, 0)
            have, feats, begin = _pool(text, best, len(ids))
            p = 1 / (1 + np.exp(-np.clip(feats @ m.out + params[3][0], -35, 35)))
            g = ((p - y[ids]) * weight[ids] / len(ids)).astype(np.float32)
            grads = [np.zeros_like(x) for x in params]
            grads[2], grads[3] = feats.T @ g + decay * m.out, np.array([g.sum()], np.float32)
            # to the chunks: the mean's share, and all of the largest's
            per = np.diff(np.append(begin, len(text)))
            back = np.repeat((g[have, None] * m.out[:filters]) / per[:, None], per, axis=0)
            for k, h in enumerate(have):
                lo, n = begin[k], per[k]
                top = lo + best[lo : lo + n].argmax(0)
                back[top, np.arange(filters)] += g[h] * m.out[filters:]
            back *= best > 0
            grads[1] = back.sum(0)
            padded = np.concatenate([part, np.zeros(width, np.uint8)])
            for f in range(filters):
                live = np.flatnonzero(back[:, f])
                if not len(live):
                    continue
                # the first byte of each chunk's largest response
                size_ = end[live] - start[live]
                flat = K.ranges(start[live], size_)
                equal = totals[f][flat] >= np.repeat(raw[live, f], size_)
                where, firsts = np.unique(np.repeat(np.arange(len(live)), size_)[equal], return_index=True)
                spot, val = flat[equal][firsts], back[live[where], f]
                for k in range(width):
                    np.add.at(grads[0][k, :, f], padded[spot + k], val)
            step += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
            for q, gr, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (gr - a)
                b += 0.001 * (gr * gr - b)
                q -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.out_bias = float(params[3][0])
    return m


def _fit(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], rows: int, chars: int, training: dict) -> ByteCnn:
    # at most ``rows`` texts of about ``chars`` characters reach the driver
    sample = training_rows(docs, labels, "quality", rows, held_out).select("id", drawn(F.col("text"), chars).alias("text"), "y").collect()
    return train([(r["text"], int(r["y"])) for r in sorted(sample, key=lambda r: r["id"])], **training)


def quality(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], max_train_rows: int = 2400, max_train_chars: int = 6_000, **training) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``, from its text alone; label 1 is good.

    Learns from at most ``max_train_rows`` labelled rows for which ``held_out`` is false, of texts over
    ``max_train_chars`` characters from pieces spaced over all of them; scores every whole text, however long.
    Null and empty texts score the output's bias; without labels of both kinds that is all there is: above 0.5 if the
    only label is 1, below it if that is 0, and 0.5 without any. Repeated rows score alike; rows of one id are scored
    by the text of each. An empty table gives an empty result.
    """
    out = scored(docs, _fit(docs, labels, held_out, max_train_rows, max_train_chars, training), "doc_id", "text", score_texts)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], max_train_rows: int = 2400, max_train_chars: int = 6_000, **training) -> DataFrame:
    """``docs`` with the columns it has, without the rows whose text scores below 0.5; nulls, empty and long texts, ties and labels as in ``quality``."""
    shared = docs.sparkSession.sparkContext.broadcast(_fit(train_docs, labels, held_out, max_train_rows, max_train_chars, training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score_texts(b.column(at), shared.value) >= 0.5))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
