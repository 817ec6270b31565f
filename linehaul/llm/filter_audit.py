"""Audit of text filters that interact: what each step of each order removes, from counts of failure masks.

Every document is reduced to the set of filters it fails, five bits. Counts of sets per part are all that is kept; a
subset-zeta transform turns them into the survivors of every subset of filters, and a step of an order is the
difference between two neighbouring subsets. The same holds for the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm.frames import WORD
from linehaul.scratch import Scratch

FILTERS = "ABCDE"
_STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text (not null) fails."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = (n < 200, 100 * different.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def failure_masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, part, mask)`` per row of ``docs``.

    A text's first document is found by (digest, doc_id), so that neither a digest that a third of all rows share nor
    an id meets in one task: digests are summed map-side, and rows are joined by both.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = scratch.table(rows, "rows")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """``(part, total, good, toxic)``: per part arrays of documents by the set of filters they fail."""
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counted = masks.join(marked, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    held = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("total", "good", "toxic")))).alias("m"))
    places = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    array = lambda c: F.transform(places, lambda k: F.coalesce(F.col("m")[k][c], F.lit(0)).cast("long"))
    return held.select("part", *[array(c).alias(c) for c in ("total", "good", "toxic")])


def survivors(counts: np.ndarray) -> np.ndarray:
    """Of counts by failed set (last axis, 2**k sets) the documents that survive every set of filters."""
    sums = counts.copy()
    sets = np.arange(counts.shape[-1])
    for bit in (1 << k for k in range(counts.shape[-1].bit_length() - 1)):
        has = sets[(sets & bit) > 0]
        sums[..., has] += sums[..., has ^ bit]  # now: documents whose failed set lies within this one, in the bits so far
    return sums[..., sets[::-1]]  # survivors of a set of filters: the failed set lies within its complement


def steps(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """All orders of the filters and their steps from ``mask_counts``: one row per part, order and step."""
    k = len(names)
    orders = np.array(list(permutations(range(k))))
    bits = 1 << orders
    after = np.cumsum(bits, axis=1)
    before = after - bits
    labels = ["".join(names[f] for f in o) for o in orders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                raw = np.array([b.column(c)[row].as_py() for c in (1, 2, 3)], np.int64)
                left = survivors(raw)
                lost = left[:, before] - left[:, after]
                removed = lost[0]
                fails = left[0, 0] - left[0, 1 << np.arange(k)]
                shapley = np.array([removed[orders == f].sum() for f in range(k)])
                cells = [left[0][after], removed, fails[orders] - removed, raw[0][bits], lost[1], lost[2], shapley[orders]]
                n = orders.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[row].as_py()] * n, pa.string()), pa.array(np.repeat(labels, k).tolist(), pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))), *[pa.array(c.ravel()) for c in cells]],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
                )

    return counts.mapInArrow(run, _STEP)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (``lang``), order of the five filters and step; columns as in ``steps``.

    Null and empty texts are the empty text, which fails A alone, and E where a smaller id has it. A null id is no
    smaller than any other and has no labels, so it never fails E. Rows of one id and text are documents of their own
    and do not fail E because of each other; an id with several labels takes the larger. Very long texts are counted
    whole. An empty table has no parts and gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    return steps(mask_counts(failure_masks(docs, scratch), labels))
