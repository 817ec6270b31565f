"""Substring dedup by level-wise doubling.

Short windows are compared first: of every window of the wanted length the one inside it with the smallest hash, which
is chosen alike wherever the stretch stands. Windows of the wanted length whose chosen one repeats across documents
are candidates, and alone are looked at with one of about twice that length, then four times, until the wanted length
is reached or no candidate is left. From the first level on, candidates are stretches of word hashes; texts are read
once more at the end, where words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.llm import kernels as K
from linehaul.llm.frames import bounded, long_id
from linehaul.scratch import Scratch

_SECOND = 0xAF251AF3B0F025B5 | 1
#: Document ids up to this many are broadcast to choose the documents whose texts are moved.
_IDS = 2_000_000


def chosen(w: K.Words, base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of each window of ``length`` words, smallest hash of the windows of ``base`` words inside it)."""
    at = K.ranges(w.doc[:-1], np.maximum(np.diff(w.doc) - length + 1, 0))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    h, span = K.window_hash(w.hash, base), length - base + 1
    # a sliding minimum: prefix minima and suffix minima of blocks of ``span`` meet inside every window
    x = np.concatenate([h, np.full(-len(h) % span, ~np.uint64(0))]).reshape(-1, span)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return at, np.minimum(right[at], left[at + span - 1])


def _text_of(w: K.Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))


def joined(w: K.Words, keep: np.ndarray) -> list[bytes]:
    """Of each text its kept words, joined by one space."""
    k = np.flatnonzero(keep)
    size = w.end[k] - w.start[k] + 1
    out = np.append(w.data, np.uint8(32))[K.ranges(w.start[k], size)]
    ends = np.cumsum(size)
    out[ends - 1] = 32
    raw, stop = out.tobytes(), np.concatenate([[0], ends])
    edge = stop[np.searchsorted(k, w.doc)]
    return [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, sha = [], []
        for _, _, w in K.each(b.column(2), hashes=False):
            n.append(np.diff(w.doc))
            sha += [hashlib.sha256(x).digest() for x in joined(w, np.ones(len(w.start), bool))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n or [np.zeros(0, np.int64)]), pa.int64()), pa.array(sha, pa.binary())], ["doc_id", "row", "n_words", "sha"])


def _keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)


def _batch_of(hashes: np.ndarray, edge: np.ndarray) -> K.Words:
    """Stretches of word hashes, as the kernels take words."""
    none = np.zeros(0, np.int64)
    return K.Words(np.zeros(0, np.uint8), none, none, edge, hashes)


_STRETCH = "doc_id long, row long, at long, words array<long>"


def _held(b: pa.RecordBatch, most: int = 1 << 17) -> Iterator[tuple[int, int, K.Words]]:
    """(first stretch, past the last, their words) over a batch of stretches, about ``most`` words at a time."""
    edge = b.column(3).offsets.to_numpy().astype(np.int64)
    hashes, edge = b.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64), edge - edge[0]
    for i, j in K.pieces(edge, most):
        yield i, j, _batch_of(hashes[edge[i] : edge[j]], edge[i : j + 1] - edge[i])


def _smallest(base: int, length: int, texts: bool):
    """Rows of a level: the chosen windows of ``base`` words of texts or stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = _keys(b)
            for i, j, w in K.each(b.column(2)) if texts else _held(b):
                at, low = chosen(w, base, length)
                if not len(at):
                    continue
                text = _text_of(w)[at]
                new = np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])])
                text = text[new]
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(low[new])), pa.array(ids[i:j][text]), pa.array(rows[i:j][text])], ["h", "doc", "row"])

    return run


def _stretches(base: int, length: int, texts: bool):
    """What is left of texts or stretches: runs of windows of ``length`` words whose chosen window their document lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (ids, rows), repeated = _keys(b), b.column(b.schema.get_field_index("repeated"))
            values, edge = repeated.flatten().to_numpy(zero_copy_only=False).view(np.uint64), repeated.offsets.to_numpy().astype(np.int64)
            edge = edge - edge[0]
            before = np.zeros(b.num_rows, np.int64) if texts else b.column(2).to_numpy()
            for i, j, w in K.each(b.column(2)) if texts else _held(b):
                at, low = chosen(w, base, length)
                if not len(at):
                    continue
                text = _text_of(w)[at]
                mine, of = values[edge[i] : edge[j]], np.repeat(np.arange(j - i), np.diff(edge[i : j + 1]))
                # a window is a candidate if its text lists its chosen window: both as pairs (text, hash)
                pairs = np.unique(K.mix(mine) + of.astype(np.uint64) * np.uint64(K._BYTE_R))
                hit = np.isin(K.mix(low) + text.astype(np.uint64) * np.uint64(K._BYTE_R), pairs)
                at, text = at[hit], text[hit]
                if not len(at):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (text[1:] != text[:-1])]))
                last = np.append(first[1:], len(at)) - 1
                lo, size, text = at[first], at[last] - at[first] + length, text[first]
                for k in range(0, len(lo), 4096):
                    s = slice(k, k + 4096)
                    ends = np.concatenate([[0], np.cumsum(size[s])])
                    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(K.signed(w.hash[K.ranges(lo[s], size[s])])))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][text[s]]), pa.array(rows[i:j][text[s]]), pa.array(before[i:j][text[s]] + lo[s] - w.doc[:-1][text[s]]), words], ["doc_id", "row", "at", "words"])

    return run


_HIGH = np.uint64(0xFFFFFFFF00000000)


def _sliced(first: np.ndarray, second: np.ndarray, at: np.ndarray, doc: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a level: two hashes of each window, the second's upper half packed with the place."""
    packed = (second & _HIGH) | at.astype(np.uint64)
    for k in range(0, len(at), 1 << 16):
        s = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(K.signed(first[s])), pa.array(K.signed(packed[s])), pa.array(doc[s]), pa.array(row[s])], ["a", "c", "doc", "row"])


_LEVEL = "a long, c long, doc long, row long"


def _windows(length: int):
    """Rows of the last level: all windows of the stretches that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (ids, rows), before = _keys(b), b.column(2).to_numpy()
            for i, j, w in _held(b):
                at = K.ranges(w.doc[:-1], np.maximum(np.diff(w.doc) - length + 1, 0))
                if not len(at):
                    continue
                text = _text_of(w)[at]
                first, second = K.window_hash(w.hash, length)[at], K.window_hash(w.hash, length, _SECOND)[at]
                yield from _sliced(first, second, before[i:j][text] + at - w.doc[:-1][text], ids[i:j][text], rows[i:j][text])

    return run


def _runs(length: int):
    """Starts of windows as ranges of the words they cover, the ranges apart from each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edge = b.column(2).offsets.to_numpy().astype(np.int64)
            starts, edge = b.column(2).flatten().to_numpy(zero_copy_only=False), edge - edge[0]
            lo, size, count = [], [], []
            for k in range(b.num_rows):
                p = np.unique(starts[edge[k] : edge[k + 1]])
                first = np.flatnonzero(np.concatenate([[True], np.diff(p) > length]))
                lo.append(p[first])
                size.append(p[np.append(first[1:], len(p)) - 1] + length - p[first])
                count.append(len(first))
            ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x or [np.zeros(0, np.int64)]), pa.int64())) for x in (lo, size))], ["doc_id", "row", "lo", "size"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their ranges."""
    for b in batches:
        edge = b.column(3).offsets.to_numpy().astype(np.int64)
        lo, size = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (3, 4))
        edge, sha, text, removed = edge - edge[0], [], [], []
        for i, j, w in K.each(b.column(2), hashes=False):
            s = slice(edge[i], edge[j])
            gone = np.zeros(len(w.start), bool)
            gone[K.ranges(lo[s] + np.repeat(w.doc[:-1], np.diff(edge[i : j + 1])), size[s])] = True
            removed += np.add.reduceat(np.append(gone, False), w.doc[:-1]).astype(int).tolist() if len(w.start) else [0] * (j - i)
            kept = joined(w, ~gone)
            sha += [hashlib.sha256(x).hexdigest() for x in kept]
            text += kept
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(sha), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "row", "n_removed", "kept_sha256", "kept"])


_ROW = ["doc_id", "row"]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): row tells the texts of one id apart; rows of one id and text are alike in all that follows."""
    return docs.select(long_id(docs, "doc_id").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


class Repeats:
    """What ``find`` leaves in the shared folder, by (doc_id, row).

    ``measure``: n_words and sha of every row. ``whole``: the rows whose whole text repeats one of a smaller id.
    ``removed``: of the others the ranges (lo, size) of words that repeated windows cover.
    """

    def __init__(self, measure: DataFrame, whole: DataFrame, removed: DataFrame):
        self.measure, self.whole, self.removed = measure, whole, removed


def ladder(length: int, least: int = 6) -> list[int]:
    """Lengths below ``length``, each about half the next and of ``least`` words at least; ``length`` itself if it has no such half."""
    out = [length]
    while -(-out[0] // 2) >= least:
        out.insert(0, -(-out[0] // 2))
    return out[:-1] or out


def narrowed(df: DataFrame, base: int, length: int, scratch: Scratch) -> DataFrame:
    """A level: of texts (doc_id, row, text) or stretches the stretches whose chosen windows of ``base`` words repeat across documents.

    A chosen window that many documents have costs each of them a row, which are summed map-side and joined with skew
    splitting; a document then gets the list of its own.
    """
    texts = "text" in df.columns
    rows = scratch.table(df.mapInArrow(_smallest(base, length, texts), "h long, doc long, row long"), "chosen")
    again = scratch.table(rows.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h"), "again")
    lists = scratch.table(rows.join(again, "h").groupBy(F.col("doc").alias("doc_id"), "row").agg(F.collect_set("h").alias("repeated")), "lists")
    scratch.drop(rows, again)
    some = df.join(bounded(lists.select(*_ROW), _IDS), _ROW, "left_semi") if texts else df
    left = scratch.table(some.join(lists, _ROW).select(*df.columns, "repeated").mapInArrow(_stretches(base, length, texts), _STRETCH), "stretches")
    scratch.drop(lists)
    return left


def find(docs: DataFrame, length: int = 50, scratch: Scratch | None = None) -> Repeats:
    """Windows of ``length`` words of ``docs`` (doc_id, text) that also start in a document with a smaller doc_id.

    Text is moved once, for documents with candidates of the first level; what they have left after it are stretches of
    word hashes, of which every level keeps a part. The last level compares all windows that are left.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "substring")
    docs = keyed(docs)
    measure = scratch.table(docs.mapInArrow(_measure, "doc_id long, row long, n_words long, sha binary"), "measure")
    # copies of one text need no windows
    long = measure.where(f"n_words >= {length} AND doc_id IS NOT NULL")
    first = scratch.table(long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first"), "first")
    whole = scratch.table(long.join(first, "sha").where("doc_id > first").select(*_ROW).distinct(), "whole")
    left = docs.where("doc_id IS NOT NULL").join(bounded(whole, _IDS), _ROW, "left_anti").select(*_ROW, "text")
    for base in ladder(length):
        now = narrowed(left, base, length, scratch)
        if "text" not in left.columns:
            scratch.drop(left)
        left = now
        if not left.limit(1).count():
            break
    windows = scratch.table(left.mapInArrow(_windows(length), _LEVEL), "windows")
    pair = windows.select("a", F.shiftright("c", 32).alias("b"), "c", "doc", "row")
    least = scratch.table(pair.groupBy("a", "b").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("a", "b", "lo"), "least")
    later = pair.join(least, ["a", "b"]).where("doc > lo").groupBy(F.col("doc").alias("doc_id"), "row").agg(F.collect_set(F.col("c").bitwiseAND(F.lit(0xFFFFFFFF))).alias("starts"))
    removed = scratch.table(later.mapInArrow(_runs(length), "doc_id long, row long, lo array<long>, size array<long>"), "removed")
    scratch.drop(windows, least, left)
    return Repeats(measure, whole, removed)


def cut(docs: DataFrame, repeats: Repeats) -> DataFrame:
    """``(doc_id, row, n_removed, kept_sha256, kept)`` of the rows with some but not all words removed by windows."""
    removed = repeats.removed
    some = keyed(docs).join(bounded(removed.select(*_ROW), _IDS), _ROW, "left_semi")
    return some.join(removed, _ROW).select(*_ROW, "text", "lo", "size").mapInArrow(_cut, "doc_id long, row long, n_removed long, kept_sha256 string, kept string")


def substring_digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per row of ``docs``.

    Null and empty texts have no words and keep the empty text; very long ones are treated as
    all are. Ids are integers; a null one is compared with nothing. Rows of one id repeat nothing of each other; each
    has the result of its own text. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    r = find(docs, length, scratch)
    part = scratch.table(cut(docs, r).drop("kept").dropDuplicates(_ROW), "part")
    m = r.measure.join(r.whole.withColumn("_gone", F.lit(True)), _ROW, "left").join(part, _ROW, "left")
    gone, n = F.coalesce("_gone", F.lit(False)), F.col("n_words")
    removed = F.when(gone, n).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha"))))
    return m.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"))


def substring_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with the columns it has; texts lose the words of repeated windows and are joined by one space where they lost some.

    A document that is wholly repeated keeps an empty text. Nulls and repeated rows as in ``substring_digest``.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    r = find(docs, length, scratch)
    part = scratch.table(cut(docs, r).select(*_ROW, "kept").dropDuplicates(_ROW), "part")
    changed = part.unionByName(r.whole.select(*_ROW, F.lit("").alias("kept"))).toDF("_cut_id", "_cut_row", "_cut_text")
    # the columns of docs are c0, c1, ... in here, so that no name of theirs meets one of these
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = docs.toDF(*own.values())
    out = out.join(changed, (F.col(own["doc_id"]).cast("long") == F.col("_cut_id")) & (F.xxhash64(own["text"]) == F.col("_cut_row")), "left")
    return out.select(*[(F.coalesce("_cut_text", own[c]) if c == "text" else F.col(own[c])).alias(c) for c in docs.columns])
