"""Bounded training samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, held_out: Callable[[Column], Column]) -> DataFrame:
    """``(id, y, text)``: at most ``rows`` labelled documents outside the held-out part, half of each label where there are enough.

    They are chosen by the id's hash among the ids that ``docs`` has; texts are whole. Null labels and null texts are
    left out; an id with several labels takes the largest, one with several texts the smallest.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).alias("y"))
    marked = marked.where(~held_out(F.col("id")))
    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    marked = marked.join(texts.select("doc"), F.col("id") == F.col("doc"), "left_semi")
    half = F.xxhash64(F.lit("sample"), F.col("id"))
    ids = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(half, "id").limit(rows // 2)
        ids = part if ids is None else ids.unionByName(part)
    # at most ``rows`` ids: a bounded broadcast
    return texts.join(F.broadcast(ids), F.col("doc") == F.col("id")).groupBy("id", "y").agg(F.min("text").alias("text"))


def drawn(text: Column, chars: int, piece: int = 500) -> Column:
    """A text of at most ``chars`` characters whole; of a longer one pieces of that many in all, evenly spaced from its beginning to its end."""
    n = max(2, chars // piece)
    at = lambda i: (F.floor(i * (F.length(text) - piece) / (n - 1)) + 1).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: text.substr(at(i), F.lit(piece)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(pieces, "\n"))
