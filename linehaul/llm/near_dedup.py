"""MinHash near-dedup by Order MinHash.

A sketch is the text order of the few k-mers (five words, labelled by occurrence) with the smallest hashes; documents
that share one of several sketches are candidates, and a banded alignment of their words decides. Similarity is
2 * aligned words / words of both.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from linehaul.llm import kernels as K
from linehaul.llm.frames import bounded
from linehaul.llm.substring_dedup import _IDS, _ROW, _measure, _text_of, keyed
from linehaul.operators.components import connected_components
from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch

U = np.uint64
#: Survivors of a text's k-mers that a hash function keeps on average before the smallest are chosen; fewer fall back to all.
_FEW = 12
#: (most words, bands, words): sketches of single words that texts of at most so many words have as well. An edit of a
#: short text leaves few of its five-word k-mers; the shorter the text, the fewer words in a sketch, and the longer, the
#: more, so that texts which only have common words alike do not meet.
SHORT = ((64, 96, 8), (36, 40, 5), (9, 24, 3), (3, 12, 2))
#: Length of a text's bitmap of words, in longs.
_LONGS = 16


def labelled(w: K.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every k-mer with its occurrence number; a text shorter than k words is one k-mer."""
    size = np.diff(w.doc)
    at = K.ranges(w.doc[:-1], np.maximum(size - k + 1, 0))
    text, h = _text_of(w)[at], K.window_hash(w.hash, k)[at]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        text = np.concatenate([text, short])
        h = np.concatenate([h, K.span_hash(w.hash, w.doc[short], w.doc[short + 1])])
        order = np.argsort(text, kind="stable")
        text, h = text[order], h[order]
    if not len(h):
        return text, h
    key = K.mix(h + text.astype(U) * U(K._WORD_Q))
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    number = np.empty(len(h), np.int64)
    number[order] = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    again = number > 0
    h[again] = K.mix(h[again] + number[again].astype(U) * U(K._BYTE_R))
    return text, h


def sketches(text: np.ndarray, h: np.ndarray, bands: int, few: int, start: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the bands from ``start`` on (texts, sketches)."""
    if not len(h):
        return
    have, first, count = np.unique(text, return_index=True, return_counts=True)
    limit = np.minimum(1.0, _FEW / count) * float(1 << 64)
    limit = np.where(count <= _FEW, ~U(0), np.minimum(limit, 1.8e19).astype(U))
    row = np.repeat(np.arange(len(have)), count)
    bound, want = limit[row], np.minimum(few, count)
    for band in range(start, start + bands):
        x = (h ^ U((band * 0xA0761D6478BD642F + 0xE7037ED1A0B428DB) & (2**64 - 1))) * U((band * 0x8EBC6AF09C88C6E2 + 0x589965CC75374CC3) & (2**64 - 1) | 1)
        at = np.flatnonzero(x <= bound)
        found = np.bincount(row[at], minlength=len(have))
        lack = found < want
        if lack.any():
            at = np.flatnonzero((x <= bound) | lack[row])
        own, left = row[at], x[at]
        begin = np.searchsorted(own, np.arange(len(have)))
        chosen = np.zeros(len(at), bool)
        for t in range(few):  # the smallest of what is left
            low = np.minimum.reduceat(left, begin)
            eq = np.flatnonzero((left == low[own]) & (want[own] > t))
            if not len(eq):  # every text has fewer
                break
            eq = eq[np.concatenate([[True], own[eq[1:]] != own[eq[:-1]]])]
            chosen[eq], left[eq] = True, ~U(0)
        at = at[chosen]  # in text order
        begin = np.cumsum(want) - want
        rank = np.arange(len(at)) - np.repeat(begin, want)
        mixed = K.mix(h[at] + (rank.astype(U) + U(1)) * U(0x9FB21C651E98DF25))
        yield have, K.mix(np.add.reduceat(mixed, begin) + U((band + 1) * K._BYTE_R & (2**64 - 1)))


def all_sketches(w: K.Words, k: int, bands: int, few: int, short: tuple[tuple[int, int, int], ...] = SHORT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each band (texts, sketches): ``bands`` of k-mers, then those of the single words of short texts."""
    yield from sketches(*labelled(w, k), bands, few)
    size = np.diff(w.doc)
    if not short or not (size <= short[0][0]).any():
        return
    text, h = labelled(w, 1)
    for most, more, words in short:
        some = size[text] <= most
        yield from sketches(text[some], h[some], more, words, bands)
        bands += more


def _sketch_rows(k: int, bands: int, few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, w in K.each(b.column(1)):
                found = list(all_sketches(w, k, bands, few))
                if found:
                    texts = np.concatenate([t for t, _ in found])
                    key, size = np.concatenate([x for _, x in found]), np.diff(w.doc)[texts].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(key)), pa.array(ids[i:j][texts]), pa.array(size)], ["key", "doc", "n"])

    return run


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text a bitmap in which every word, labelled by occurrence, flips one bit.

    Two texts' bitmaps differ in at most as many bits as they have words that the other lacks.
    """
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i, j, w in K.each(b.column(1)):
            text, h = labelled(w, 1)
            flips = np.bincount(text * (64 * _LONGS) + (K.mix(h) % U(64 * _LONGS)).astype(np.int64), minlength=(j - i) * 64 * _LONGS) & 1
            longs = np.packbits(flips.astype(np.uint8).reshape(j - i, -1), axis=1).view(np.int64).reshape(j - i, _LONGS)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), *(pa.array(longs[:, k]) for k in range(_LONGS))], ["doc", *(f"p{k}" for k in range(_LONGS))])


def lcs_banded(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence of a and b over cells at most ``band`` off the diagonal, a bit for each word of a."""
    if not a or not b:
        return 0
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for j, y in enumerate(b):
        m = masks.get(y)
        if m:
            if j > band:
                m = m >> (j - band) << (j - band)
            m &= (1 << (j + band + 1)) - 1
            u = v & m
            if u:
                v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _chain(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Longest rising chain of k-mers that occur once in a and once in b, as (place in a, place in b)."""
    x, y = K.window_hash(a, k), K.window_hash(b, k)
    ux, ix, cx = np.unique(x, return_index=True, return_counts=True)
    uy, iy, cy = np.unique(y, return_index=True, return_counts=True)
    _, p, q = np.intersect1d(ux[cx == 1], uy[cy == 1], assume_unique=True, return_indices=True)
    p, q = ix[cx == 1][p], iy[cy == 1][q]
    order = np.argsort(p)
    p, q = p[order].tolist(), q[order].tolist()
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(q)
    for i, v in enumerate(q):
        s = bisect_left(tails, v)
        back[i] = at[s - 1] if s else -1
        tails[s : s + 1] = [v]
        at[s : s + 1] = [i]
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append((p[i], q[i]))
        i = back[i]
    return chain[::-1]


def lcs_window(a: list[int], b: list[int], band: int, block: int = 4096) -> int:
    """As ``lcs_banded``, with only the bits of the band in memory: those of a before it are final, those after it untouched."""
    masks: dict[int, dict[int, bytes]] = {}
    none = bytes(block // 8)

    def of_block(k: int) -> dict[int, bytes]:
        found: dict[int, bytearray] = {}
        for i, x in enumerate(a[k * block : (k + 1) * block]):
            found.setdefault(x, bytearray(block // 8))[i >> 3] |= 1 << (i & 7)
        return {x: bytes(m) for x, m in found.items()}

    lo = hi = done = v = 0  # v has the bits of a[lo:hi]
    for j, y in enumerate(b):
        start, stop = min(max(0, j - band), len(a)), min(len(a), j + band + 1)
        if start >= len(a):
            break
        done += start - lo - (v & ((1 << (start - lo)) - 1)).bit_count()
        v >>= start - lo
        v |= ((1 << (stop - hi)) - 1) << (hi - start)
        lo, hi = start, stop
        first, last = lo // block, (hi - 1) // block
        for k in [k for k in masks if k < first]:
            del masks[k]
        for k in range(first, last + 1):
            if k not in masks:
                masks[k] = of_block(k)
        m = int.from_bytes(b"".join(masks[k].get(y, none) for k in range(first, last + 1)), "little") >> (lo - first * block)
        u = v & m
        if u:
            v = ((v + u) | (v - u)) & ((1 << (hi - lo)) - 1)
    return done + hi - lo - v.bit_count()


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Words that a and b have in common at both ends, and what lies between."""
    n = min(len(a), len(b))
    same = a[:n] != b[:n]
    head = int(same.argmax()) if same.any() else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
    tail = int(same.argmax()) if n and same.any() else n
    return head + tail, a[: len(a) - tail], b[: len(b) - tail]


def aligned(a: np.ndarray, b: np.ndarray, band: int, most: int = 4096) -> int:
    """Words of a and b aligned in order, at most ``band`` off the diagonal. Beyond ``most`` words memory is that of the band."""
    done, a, b = _trimmed(a, b)
    if not len(a) or not len(b):
        return done
    lcs = lcs_banded if max(len(a), len(b)) <= most else lcs_window
    return done + lcs(a.tolist(), b.tolist(), band)


def aligned_between(a: np.ndarray, b: np.ndarray, band: int, k: int = 5, most: int = 4096) -> int:
    """A number of words that can be aligned at least, found fast: between k-mers that both have once, of up to ``most`` words."""
    done, a, b = _trimmed(a, b)
    i = j = 0
    for p, q in [*_chain(a, b, k), (len(a), len(b))]:
        if p < i or q < j:  # inside what is aligned already
            continue
        if max(p - i, q - j) <= most:
            done += lcs_banded(a[i:p].tolist(), b[j:q].tolist(), band)
        i, j = p, q
        if p < len(a):
            done, i, j = done + 1, i + 1, j + 1
    return done


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 2 * aligned / (words of both) reaches ``least``. a, b: hashes of the words."""
    total = len(a) + len(b)
    need = math.ceil(least * total / 2 - 1e-9)
    if min(len(a), len(b)) < max(need, 1):
        return False
    if len(a) == len(b) and int((a == b).sum()) >= need:
        return True
    # no alignment has more words than the texts have in common, whatever their order
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, p, q = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[p], cb[q]).sum()) < need:
        return False
    # words left over on either side bound how far an alignment of that many can leave the diagonal
    band = max(len(a), len(b)) - need
    if max(len(a), len(b)) > 4096 and aligned_between(a, b, band) >= need:
        return True
    return aligned(a, b, band) >= need


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = ([w.hash[w.doc[t] : w.doc[t + 1]] for _, _, w in K.each(b.column(c)) for t in range(len(w.doc) - 1)] for c in (2, 3))
            ok = pa.array([similar(x, y, least) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


def _links(docs: DataFrame, pairs: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    ids = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    some = docs.join(bounded(scratch.table(ids, "ids"), _IDS), docs["doc_id"] == F.col("_id"), "left_semi")
    x, y = some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return scratch.table(pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(least), "a long, b long"), "links")


def _classes(docs: DataFrame, similarity: float, k: int, bands: int, few: int) -> DataFrame:
    """(doc_id, row, class_id, kept) per row of ``docs``; see ``near_classes``."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = keyed(docs)
    measure = scratch.table(docs.mapInArrow(_measure, "doc_id long, row long, n_words long, sha binary"), "measure")
    # texts of one id are documents of their own: all but one get an id above all others in the search
    several = scratch.table(measure.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "several")
    repeated, extra = several.limit(1).count() > 0, None
    if repeated and several.where("lo < hi").limit(1).count():
        top = measure.agg(F.max("doc_id").alias("top")).collect()[0]["top"]
        extra = measure.join(several.where("lo < hi"), "doc_id").where("row > lo").select(*_ROW).distinct()
        extra = scratch.table(numbered(extra, _ROW, "node", scratch).withColumn("node", F.col("node") + F.lit(top + 1)), "extra")

    def with_node(df: DataFrame) -> DataFrame:
        if extra is None:
            return df.withColumn("node", F.col("doc_id"))
        return df.join(bounded(extra, _IDS), _ROW, "left").withColumn("node", F.coalesce("node", "doc_id"))

    texts = with_node(docs).select(F.col("node").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    measure = with_node(measure)
    worded = measure.where("n_words > 0 AND doc_id IS NOT NULL")
    first = scratch.table(worded.groupBy("sha").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("sha", "first"), "first")
    copies = scratch.table(worded.join(first, "sha").where("node > first").groupBy(F.col("node").alias("doc_id")).agg(F.min("first").alias("first")), "copies")
    alone = texts.join(bounded(copies.select("doc_id"), _IDS), "doc_id", "left_anti")
    if repeated:
        alone = alone.dropDuplicates(["doc_id"])  # rows of one id and text are one document

    sketch = scratch.table(alone.mapInArrow(_sketch_rows(k, bands, few), "key long, doc long, n int"), "sketch")
    parts = [f"p{k}" for k in range(_LONGS)]
    parity = scratch.table(alone.mapInArrow(_parities, "doc long, " + ", ".join(f"{p} long" for p in parts)), "parity")
    shared = scratch.table(sketch.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key", "size"), "shared")
    members = scratch.table(sketch.join(shared, "key"), "members")
    scratch.drop(sketch)
    # the document that meets most others stands in the middle of its group: what the rest of its buckets start from
    weight = scratch.table(members.groupBy("doc").agg(F.sum("size").alias("weight")), "weight")
    members = scratch.table(members.join(weight, "doc").select("key", "doc", "n", "weight"), "members")
    # lengths of similar texts differ by at most this factor
    factor = (2 - similarity) / similarity

    def side(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select("key", *(F.col(c).alias(f"{name}_{c}") for c in ("doc", "n", *more)))

    sized = F.least("x_n", "y_n") * factor >= F.greatest("x_n", "y_n") - 1e-9
    differ = sum((F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in parts), F.lit(0))
    common = differ <= (1 - similarity) * (F.col("x_n") + F.col("y_n")) + 1e-9

    # in every bucket all with its centre; the bound on common words is for each pair once
    centre = members.groupBy("key").agg(F.max_by(F.struct("doc", "n"), F.struct("weight", -F.col("doc"))).alias("c")).select("key", "c.*")
    centre = scratch.table(side(centre, "y"), "centre")
    met = side(members, "x").join(centre, "key").where(sized & (F.col("x_doc") != F.col("y_doc")))
    ends = [(F.when(F.col("x_doc") < F.col("y_doc"), F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}"))).alias(f"{p}_{c}") for p, q in (("x", "y"), ("y", "x")) for c in ("doc", "n")]
    met = scratch.table(met.select(*ends).distinct(), "met")
    bits = lambda name: parity.select(F.col("doc").alias(f"{name}_doc"), *(F.col(p).alias(f"{name}_{p}") for p in parts))
    star = met.join(bits("x"), "x_doc").join(bits("y"), "y_doc").where(common)
    star = scratch.table(star.select(F.col("x_doc").alias("a"), F.col("y_doc").alias("b")), "star")
    links = _links(alone, star, similarity, scratch)
    component = connected_components(spark, links, "a", "b", scratch)

    # what shares a sketch but not a class yet
    at = members.join(component.withColumnRenamed("node", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc"))
    at = scratch.table(at.select("key", "doc", "n", "weight", "c"), "at")
    major = at.groupBy("key").agg(F.max_by("c", F.struct("weight", -F.col("doc"))).alias("major"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", "major")
    open_ = scratch.table(at.join(scratch.table(major, "major"), "key").withColumn("other", F.col("c") != F.col("major")), "open")
    # a document's open buckets, at most one per band: a pair is taken up in the first that both are in
    open_ = open_.join(open_.groupBy("doc").agg(F.collect_list("key").alias("keys")), "doc").join(parity, "doc")
    open_ = scratch.table(open_, "open")
    apart = (F.col("x_c") != F.col("y_c")) & (~F.col("y_other") | (F.col("x_doc") < F.col("y_doc")))
    x, y = side(open_.where("other"), "x", "c", "keys", *parts).withColumnRenamed("key", "x_key"), side(open_, "y", "c", "other", "keys", *parts)
    once = F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("key")
    rest = x.join(y, (F.col("x_key") == F.col("key")) & apart & sized & common & once)
    rest = rest.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()
    rest = scratch.table(rest.join(star, ["a", "b"], "left_anti"), "rest")
    # later links join the classes found so far; a copy is of the class of the document that stands for it
    found = _links(alone, rest, similarity, scratch)
    of = component.select(F.col("node"), "component")
    more = found.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = connected_components(spark, more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b", scratch).select(F.col("node").alias("_c"), F.col("component").alias("_low"))
    linked = scratch.table(component.unionByName(found.select(F.col("a").alias("node"), F.col("a").alias("component"))).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), "linked")
    classes = scratch.table(linked.join(merged, F.col("component") == F.col("_c"), "left").select("node", F.coalesce("_low", "component").alias("component")), "classes")
    stand = classes.select(F.col("node").alias("first"), F.col("component").alias("_class"))
    of_copies = copies.join(stand, "first", "left").select(F.col("doc_id").alias("node"), F.coalesce("_class", "first").alias("component"))
    # the smallest id of a class is among those that stand for copies, as these are the smallest of their copies
    classes = classes.unionByName(of_copies)
    out = measure.select(*_ROW, "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if extra is None:
        return out.select(*_ROW, F.col("component").alias("class_id"), F.coalesce(F.col("component") == F.col("node"), F.lit(True)).alias("kept"))
    # a class is called by the smallest of the ids that its documents came with
    out = scratch.table(out, "out")
    named = out.where("node IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "node")).alias("least"))
    out = out.join(named, "component", "left")
    return out.select(*_ROW, "class_id", F.coalesce(F.col("least.node") == F.col("node"), F.lit(True)).alias("kept"))


def near_classes(docs: DataFrame, similarity: float = 0.8, k: int = 5, bands: int = 96, few: int = 2) -> DataFrame:
    """``(doc_id, class_id, kept)`` per row of ``docs`` (doc_id, text): class_id is the smallest id of its class, the linked and their linked.

    Copies of one word sequence are one document in the search. In each bucket of a sketch all members
    are first compared with one of them, that which meets most others; after that only pairs of the bucket that are in different
    classes by then, none of them in the bucket's first class twice over, and none compared before. Pairs that cannot
    be similar, by their lengths or by a bound on their common words, are left out before their texts are fetched. So
    no similar candidate pair is lost, and a group of near copies costs its size, not its square. Texts of at most 64
    words have sketches of single words as well (``SHORT``), as two edits can leave a short text without a k-mer.

    Null and empty texts are their own class, and so are null ids. Ids are integers. Rows of one id and text have the
    same class; rows of one id with other texts are documents of their own, and of those of the smallest id in a class
    one text is kept. Very long texts are aligned over their whole band. Ties go to the smaller id. An empty table
    gives an empty result.
    """
    return _classes(docs, similarity, k, bands, few).select("doc_id", "class_id", "kept")


def near_dedup(docs: DataFrame, similarity: float = 0.8, k: int = 5, bands: int = 96, few: int = 2) -> DataFrame:
    """``docs`` with the columns it has: the document of smallest id of each class; of rows with one id and text, one stays.

    Nulls, empty and long texts, ties and repeated rows are treated as in ``near_classes``; rows with a null id all stay.
    """
    scratch = Scratch(docs.sparkSession, "near")
    classes = scratch.table(_classes(docs, similarity, k, bands, few), "classes").where("doc_id IS NOT NULL")
    # the columns of docs are c0, c1, ... in here, so that no name of theirs meets one of these
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = docs.toDF(*own.values()).withColumns({"_id": F.col(own["doc_id"]).cast("long"), "_row": F.xxhash64(own["text"])})
    names = {"doc_id": "_id", "row": "_row"}
    gone = classes.where("NOT kept").select(*_ROW).distinct().withColumnsRenamed(names)
    out = out.join(bounded(gone, _IDS), ["_id", "_row"], "left_anti")
    twice = scratch.table(classes.groupBy(*_ROW).count().where("count > 1").select(*_ROW).withColumnsRenamed(names), "twice")
    if twice.limit(1).count():
        twice = bounded(twice, _IDS)
        hashed = [f.name for f in out.schema if not isinstance(f.dataType, MapType | VariantType)]
        first = Window.partitionBy("_id", "_row").orderBy(F.xxhash64(*hashed))
        once = out.join(twice, ["_id", "_row"], "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        out = out.join(twice, ["_id", "_row"], "left_anti").unionByName(once)
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])
