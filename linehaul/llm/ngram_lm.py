"""Interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in memory-mapped sorted hash arrays.

Counting: each task counts the bigrams of a few million tokens, sorts them into buckets and hands on one block per
bucket. A bucket (by context and bits of the next word, so that a frequent context is spread over all) is merged by one task, which writes the
bucket's sorted array to the shared folder and hands on what it knows of each word; a second round merges that.
Scoring: workers map the arrays they need.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.llm import kernels as K
from linehaul.scratch import Scratch

U = np.uint64
_START, _END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
_WORD_FIELDS = ("count", "continuations", "context", "once", "twice", "more")
_SUMS = ("n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "m_more", "types", "tokens", "words")
_BLOCK = "bucket int, u binary, nu binary, w binary, c binary"
_PART = "part int, kind int, h binary, v binary"


def bigram_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix(u * U(K._WORD_R) + K.mix(w))


def bucket_of(u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """A context's bucket depends on bits of the next word too, as many as spread a context over all buckets."""
    bits = max(3, int(buckets - 1).bit_length())
    return ((K.mix(u + (w >> U(64 - bits)) * U(K._WORD_Q)) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def tokens(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, offsets of texts): of each text its words and an end, each after the token before or a start."""
    n = len(w.doc) - 1
    off = w.doc + np.arange(n + 1)
    token = np.full(off[-1], _END, U)
    token[np.arange(len(w.hash)) + np.repeat(np.arange(n), np.diff(w.doc))] = w.hash
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[off[:-1]] = _START
    return context, token, off


def _runs(*cols: np.ndarray) -> np.ndarray:
    """First places of the runs of equal rows of sorted columns."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]))


def _count(buckets: int, most: int):
    def blocks(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        b = bucket_of(u, w, buckets)
        order = np.lexsort((w, u, b))
        u, w, b = u[order], w[order], b[order]
        first = _runs(u, w)
        c = np.diff(np.append(first, len(u))).astype(np.uint32)
        u, w, b = u[first], w[first], b[first]
        edge = _runs(b)
        rows: dict[str, list] = {k: [] for k in ("bucket", "u", "nu", "w", "c")}
        for lo, hi in zip(edge, np.append(edge[1:], len(b)), strict=True):
            run = _runs(u[lo:hi])
            for k, v in (("bucket", int(b[lo])), ("u", u[lo:hi][run].tobytes()), ("nu", np.diff(np.append(run, hi - lo)).astype(np.uint32).tobytes()), ("w", w[lo:hi].tobytes()), ("c", c[lo:hi].tobytes())):
                rows[k].append(v)
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("u", "nu", "w", "c"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for _, _, w in K.each(batch.column(0), lower=True):
                u, t, _ = tokens(w)
                parts.append((u, t))
                n += len(t)
                if n >= most:
                    yield blocks(parts)
                    parts, n = [], 0
        if n:
            yield blocks(parts)

    return run


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file of a count and then the arrays; written under a name of this attempt and then renamed."""
    from pyspark import TaskContext

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    temp = f"{path}/{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(temp) as out:
        out.write(np.array([len(arrays[0])], np.int64).tobytes())
        for a in arrays:
            out.write(a.tobytes())
    try:
        fs.move(temp, f"{path}/{name}")
    except OSError:  # some stores do not rename over the same file of an earlier attempt
        fs.delete_file(temp)


def _cat(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()] or [np.zeros(0, kind)])


def _merge_bigrams(folder: str, parts: int):
    def run(table: pa.Table) -> pa.Table:
        u, w, c = np.repeat(_cat(table, "u", U), _cat(table, "nu", np.uint32)), _cat(table, "w", U), _cat(table, "c", np.uint32).astype(np.int64)
        order = np.lexsort((w, u))
        u, w, c = u[order], w[order], c[order]
        first = _runs(u, w)
        c = np.add.reduceat(c, first)
        u, w = u[first], w[first]
        key = bigram_key(u, w)
        order = np.argsort(key)
        small = np.minimum(c[order], 255).astype(np.uint8)
        big = np.flatnonzero(small == 255)
        _save(folder, f"bigram-{table['bucket'][0].as_py():06d}", [key[order], small, np.concatenate([big, c[order][big]]).astype(np.int64)])
        # what the bucket knows of each context and of each word
        run_u = _runs(u)
        of_u = np.stack([np.add.reduceat(x, run_u) for x in (c, c == 1, c == 2, c > 2)]).astype(np.int64)
        order = np.argsort(w, kind="stable")
        run_w = _runs(w[order])
        of_w = np.stack([np.add.reduceat(c[order], run_w), np.diff(np.append(run_w, len(w)))]).astype(np.int64)
        rows: dict[str, list] = {"part": [-1], "kind": [0], "h": [b""], "v": [np.array([(c == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()]}
        for kind, h, v in ((0, u[run_u], of_u), (1, w[order][run_w], of_w)):
            at = part_of(h, parts)
            edge = _runs(at)  # h is sorted, and so are the parts
            for lo, hi in zip(edge, np.append(edge[1:], len(h)), strict=True):
                for k, x in (("part", int(at[lo])), ("kind", kind), ("h", h[lo:hi].tobytes()), ("v", v[:, lo:hi].astype(np.uint32).T.tobytes() if v.max(initial=0) < 2**32 else v[:, lo:hi].T.tobytes())):
                    rows[k].append(x)
        return pa.table(rows, schema=pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("v", pa.binary())]))

    return run


def _merge_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        sums = dict.fromkeys(_SUMS, 0)
        if part < 0:
            n = np.sum([np.frombuffer(x, np.int64) for x in table["v"].to_pylist()], axis=0)
            sums |= {f"n{k + 1}": int(n[k]) for k in range(4)}
        else:
            hs, vs = [], []
            for kind, h, v in zip(table["kind"].to_pylist(), table["h"].to_pylist(), table["v"].to_pylist(), strict=True):
                h, width = np.frombuffer(h, U), 4 if kind == 0 else 2
                got = np.frombuffer(v, np.uint32 if len(v) == 4 * width * len(h) else np.int64).reshape(len(h), width)
                full = np.zeros((len(h), 6), np.int64)
                full[:, 2:6] = got if kind == 0 else full[:, 2:6]
                full[:, 0:2] = got if kind == 1 else full[:, 0:2]
                hs.append(h)
                vs.append(full)
            h, v = np.concatenate(hs), np.concatenate(vs)
            order = np.argsort(h, kind="stable")
            h, v = h[order], v[order]
            first = _runs(h)
            h, v = h[first], np.add.reduceat(v, first)
            _save(folder, f"word-{part:06d}", [h, v[:, :2].astype(np.int64).T.copy(), v[:, 2:].astype(np.int64).T.copy()])
            cont = v[:, 1]
            sums |= {f"m{k}": int((cont == k).sum()) for k in (1, 2, 3, 4)} | {"m_more": int((cont > 2).sum()), "types": int(cont.sum()), "tokens": int(v[:, 0].sum()), "words": int((v[:, 0] > 0).sum())}
        return pa.table({k: pa.array([x], pa.int64()) for k, x in sums.items()})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two and more; 0.75 of what there is where the counts don't tell."""
    out = []
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else 0.75
        out.append(d if 0 < d <= k else 0.75)
    return out[0], out[1], out[2]


class Model:
    """Folder of arrays and the few numbers that go with them."""

    def __init__(self, folder: str, buckets: int, parts: int, sums: dict[str, int]):
        self.folder, self.buckets, self.parts, self.sums = folder, buckets, parts, sums


def count(docs: DataFrame, block_tokens: int = 2_000_000, scratch: Scratch | None = None) -> Model:
    """A model of the ``text`` of ``docs``; the number of buckets follows the amount of text."""
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    folder = f"{scratch.root}/model"
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    buckets = int(size // (6 * block_tokens)) + 1
    parts = buckets // 4 + 1
    blocks = docs.select("text").mapInArrow(_count(buckets, block_tokens), _BLOCK)
    words = blocks.groupBy("bucket").applyInArrow(_merge_bigrams(folder, parts), _PART)
    done = words.groupBy("part").applyInArrow(_merge_words(folder), ", ".join(f"{k} long" for k in _SUMS))
    sums = done.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in _SUMS]).collect()[0].asDict()
    return Model(folder, buckets, parts, {k: int(v) for k, v in sums.items()})


_open: dict[tuple[str, str], list[np.ndarray] | None] = {}


def _load(folder: str, name: str, kinds: list[tuple[type, int]]) -> list[np.ndarray] | None:
    """Arrays of a file, mapped to memory; None if there is no such file. A file elsewhere than on a mounted disk is copied, mapped and unlinked."""
    if (folder, name) not in _open:
        fs, path = pafs.FileSystem.from_uri(folder)
        path = f"{path}/{name}"
        if fs.get_file_info(path).type != pafs.FileType.File:
            _open[folder, name] = None
            return None
        if urlparse(folder).scheme in ("", "file"):
            raw = np.memmap(path, np.uint8, "r")
        else:
            with tempfile.NamedTemporaryFile(delete=False) as local, fs.open_input_stream(path) as source:
                while data := source.read(1 << 22):
                    local.write(data)
            raw = np.memmap(local.name, np.uint8, "r")
            os.unlink(local.name)
        n, at, arrays = int(raw[:8].view(np.int64)[0]), 8, []
        for kind, width in kinds:
            size = n * width * np.dtype(kind).itemsize if width else len(raw) - at
            arrays.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at).reshape(width or 1, -1)[0 if width in (0, 1) else slice(None)])
            at += size
        _open[folder, name] = arrays
    return _open[folder, name]


def _find(h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of keys in the sorted h."""
    order = np.argsort(keys)
    at = np.empty(len(keys), np.int64)
    at[order] = np.searchsorted(h, keys[order])
    at = np.minimum(at, len(h) - 1)
    return at, h[at] == keys


def word_stats(m: Model, words: np.ndarray) -> np.ndarray:
    """(len(_WORD_FIELDS), words) of sorted word hashes; zeros for unknown ones."""
    out = np.zeros((6, len(words)), np.int64)
    at = part_of(words, m.parts)
    edge = _runs(at)
    for lo, hi in zip(edge, np.append(edge[1:], len(words)), strict=True):
        got = _load(m.folder, f"word-{at[lo]:06d}", [(np.uint64, 1), (np.int64, 2), (np.int64, 4)])
        if got:
            place, found = _find(got[0], words[lo:hi])
            out[:2, lo:hi] = np.where(found, got[1][:, place], 0)
            out[2:, lo:hi] = np.where(found, got[2][:, place], 0)
    return out


def bigram_counts(m: Model, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(u), np.int64)
    bucket, key = bucket_of(u, w, m.buckets), bigram_key(u, w)
    order = np.argsort(bucket.astype(np.uint16) if m.buckets < 65536 else bucket, kind="stable")
    edge = _runs(bucket[order])
    for lo, hi in zip(edge, np.append(edge[1:], len(u)), strict=True):
        at = order[lo:hi]
        got = _load(m.folder, f"bigram-{bucket[at[0]]:06d}", [(np.uint64, 1), (np.uint8, 1), (np.int64, 0)])
        if got:
            place, found = _find(got[0], key[at])
            c = np.where(found, got[1][place], 0).astype(np.int64)
            full = np.flatnonzero(c == 255)
            if len(full):
                big = got[2].reshape(2, -1)
                c[full] = big[1][np.searchsorted(big[0], place[full])]
            out[at] = c
    return out


def token_scores(m: Model, u: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of the model's probability, log10 of the base's, count in training) of each token after its context."""
    s = m.sums
    known, back = np.unique(np.concatenate([t, u]), return_inverse=True)
    stats = word_stats(m, known).astype(np.float64)
    of_t, of_u = back[: len(t)], back[len(t) :]
    low = discounts(s["m1"], s["m2"], s["m3"], s["m4"])
    types, vocabulary = max(s["types"], 1), s["words"] + 1
    cont = stats[1]
    left = (low[0] * s["m1"] + low[1] * s["m2"] + low[2] * s["m_more"]) / types if s["types"] else 1.0
    unigram = np.maximum(cont - np.choose(np.minimum(cont, 3).astype(int), [0.0, *low]), 0) / types + left / vocabulary
    high = discounts(s["n1"], s["n2"], s["n3"], s["n4"])
    total = np.maximum(stats[2], 1)
    backoff = np.where(stats[2] > 0, (high[0] * stats[3] + high[1] * stats[4] + high[2] * stats[5]) / total, 1.0)
    c = bigram_counts(m, u, t)
    p = np.maximum(c - np.choose(np.minimum(c, 3), [0.0, *high]), 0) / total[of_u] + backoff[of_u] * unigram[of_t]
    seen = stats[0][of_t]
    return np.log10(p), np.log10((seen + 0.5) / (s["tokens"] + 0.5 * vocabulary)), seen


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` per row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, known, base, full = [], [], [], []
            for _, _, w in K.each(b.column(1), lower=True):
                u, t, off = tokens(w)
                p, q, seen = token_scores(model, u, t)
                n.append(np.diff(off))
                for out, x in ((known, (seen > 0).astype(np.int64)), (base, q), (full, p)):
                    out.append(np.add.reduceat(x, off[:-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate(x or [np.zeros(0)]), k) for x, k in ((n, pa.int64()), (known, pa.int64()), (base, pa.float64()), (full, pa.float64())))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def perplexity(docs: DataFrame, held_out: Callable[[Column], Column], block_tokens: int = 2_000_000) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` per row of ``docs``.

    Learns from all whole texts for which ``held_out`` is false and scores all whole texts. Tokens are the words, A-Z
    lower-cased, and one end. Null and empty texts are the end alone. A null id counts as not held out. Rows that
    repeat count as often as they occur. An empty table gives an empty result.
    """
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = count(docs.where(~out), block_tokens)
    scored = score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.sums["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
