"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over neighbouring words; the masked-out words may differ. Benchmark seeds meet document seeds in
one hash join, and around every hit the words on its diagonal are compared: an overlap counts if enough words of a
window are equal, whichever were substituted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which words of a window count: 1 is compared, 0 ignored.
MASKS = ("111011", "1101011", "10110011")
#: Between words: all of ASCII but letters and digits.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; the first and the last may be empty."""
    return F.split(F.lower(text), _GAP)


def _once(value: Column) -> Column:
    """``value`` as a generated column, which the optimizer does not write out again wherever it is used."""
    return F.explode(F.array(value))


def _unseen(placed: Sequence[frozenset[int]], most: int, hit: frozenset[int] = frozenset()) -> frozenset[int] | None:
    """At most ``most`` substituted places of a window that leave no seed whole, or None if there are none."""
    whole = next((p for p in placed if not p & hit), None)
    if whole is None:
        return hit
    if len(hit) == most:
        return None
    return next((u for x in sorted(whole) if (u := _unseen(placed, most, hit | {x})) is not None), None)


def complete_masks(masks: Sequence[str], lengths: Sequence[int], least: float) -> dict[str, list[int]]:
    """Masks to add, each with the window lengths it is for, so that no window with ``least`` equal words is without a seed.

    Of a length at which some choice of substituted words leaves no mask whole, the equal words of that choice give a
    mask of four of them, as close together as can be; a mask added for another length is taken first.
    """
    more: dict[str, list[int]] = {}
    for n in sorted(lengths):
        spare = n - math.ceil(n * least - 1e-9)
        at = lambda mask, n=n: [frozenset(o + i for i, c in enumerate(mask) if c == "1") for o in range(n - len(mask) + 1)]
        placed = [p for mask in masks for p in at(mask)]
        while (gone := _unseen(placed, spare)) is not None:
            fit = next((mask for mask in more if any(not p & gone for p in at(mask))), None)
            if fit is None:
                equal = [i for i in range(n) if i not in gone]
                seed = min((equal[i : i + 4] for i in range(max(1, len(equal) - 3))), key=lambda x: x[-1] - x[0])
                fit = "".join("1" if i in seed else "0" for i in range(seed[0], seed[-1] + 1))
            more.setdefault(fit, []).append(n)
            placed += at(fit)
    return more


def _seeds(word_list: Column, pos: Column, masks: Sequence[str], window: Column | None = None, only: dict[str, list[int]] | None = None) -> Column:
    """Hashes of the masks at a position as an array of structs; null where the mask leaves the list.

    With ``window`` (of benchmark items) a mask in ``only`` is for items of those window lengths.
    """
    out = []
    for k, mask in enumerate(masks):
        at = [F.get(word_list, pos + i) for i, c in enumerate(mask) if c == "1"]
        fits = pos + len(mask) <= F.size(word_list)
        if window is not None and mask in only:
            fits = fits & window.isin(only[mask])
        out.append(F.struct(F.when(fits, F.xxhash64(F.lit(mask), *at)).alias("h"), F.lit(k).alias("mask")))
    return F.array(*out)


def _whole(word_list: Column) -> Column:
    return F.xxhash64(F.lit("whole"), F.array_join(word_list, " "))


def benchmark_seeds(items: DataFrame, masks: Sequence[str], window: int, least: float, id_col: str = "item_id", text_col: str = "text", min_words: int = 5) -> tuple[DataFrame, list[str]]:
    """Seeds at every position of the benchmark with the words around them; masks are added where the items' lengths need them.

    Items of fewer than ``min_words`` words have one seed, for documents of just these words.
    """
    base = items.select(F.col(id_col).alias("item_id"), F.filter(words(F.col(text_col)), lambda x: x != "").alias("iw")).withColumn("item_words", F.size("iw"))
    short, long = base.where(f"item_words BETWEEN 1 AND {min_words - 1}"), base.where(f"item_words >= {min_words}")
    size = F.least(F.lit(window), F.size("iw"))
    lengths = [r["n"] for r in long.select(size.alias("n")).distinct().collect()]  # at most ``window``
    only = complete_masks(masks, lengths, least)
    masks = [*masks, *only]
    longest = max(len(m) for m in masks)
    placed = long.select("item_id", "iw", "item_words", F.posexplode("iw").alias("ipos", "_w"))
    begin = F.greatest(F.lit(0), F.col("ipos") - (window - 1))
    seeds = placed.select("item_id", "ipos", "item_words", begin.alias("ib"), F.slice("iw", begin + 1, 2 * window + longest).alias("near"), F.inline(_seeds(F.col("iw"), F.col("ipos"), masks, size, only)))
    short = short.select("item_id", F.lit(0).alias("ipos"), "item_words", F.lit(0).alias("ib"), F.col("iw").alias("near"), _whole(F.col("iw")).alias("h"))
    return seeds.where("h IS NOT NULL").drop("mask").unionByName(short), masks


def _overlaps(docs: DataFrame, items: DataFrame, masks: Sequence[str], window: int, least: float, min_words: int, broadcast_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, item_id, window, matched) of every hit that leads to an overlap; row tells the texts of one id apart."""
    seeds, masks = benchmark_seeds(items, masks, window, least, min_words=min_words)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), words(F.col(text_col)).alias("w"))
    at = texts.select("doc_id", "row", "w", F.posexplode_outer("w").alias("pos", "_w"))
    # (an outer explode, as for an inner one the optimizer adds a filter that splits every text once more)
    # a text of fewer words than are looked for in windows, whose first and last word may be empty, is a seed as a whole
    # (no lambda here: one would end the generated code, and its rows would be copied with all words for each place)
    solid = F.array_remove("w", "")
    few = (F.size("w") <= min_words + 1) & (F.col("pos") == F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0))
    own = F.when(few, F.when(F.size(solid).between(1, min_words - 1), _whole(solid)))
    keys = F.concat(_seeds(F.col("w"), F.col("pos"), masks), F.array(F.struct(own.alias("h"), F.lit(-1).alias("mask"))))
    probes = at.where("pos IS NOT NULL").select("doc_id", "row", "w", "pos", F.inline(keys)).where("h IS NOT NULL").drop("mask")
    if seeds.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hits = probes.join(F.broadcast(seeds), "h")
    else:
        # hashes and places are shuffled, and texts for hits alone
        met = probes.select("doc_id", "row", "pos", "h").join(seeds, "h").drop("h").dropDuplicates(["doc_id", "row", "pos", "item_id", "ipos"])
        of = texts.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "w")
        hits = met.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    inside = F.col("ipos") - F.col("ib")
    left = F.least("pos", inside)
    size = left + F.least(F.size("near") - inside, F.size("w") - F.col("pos"))
    hits = hits.select("doc_id", "row", "item_id", "item_words", F.slice("w", F.col("pos") - left + 1, size).alias("d"), F.slice("near", inside - left + 1, size).alias("i"))
    hits = hits.select("doc_id", "row", "item_id", F.least(F.lit(window), F.col("item_words")).alias("window"), _once(F.zip_with("d", "i", lambda x, y: F.when(x == y, 1).otherwise(0))).alias("eq"))
    need = F.ceil(F.col("window") * F.lit(least) - 1e-9)
    hits = hits.where((F.size("eq") >= F.col("window")) & (F.size(F.filter("eq", lambda x: x == 1)) >= need))
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("b"))

    def slide(acc: Column, i: Column) -> Column:
        s = acc["s"] + F.get("eq", i) - F.when(i >= F.col("window"), F.get("eq", i - F.col("window"))).otherwise(0)
        return F.struct(s.alias("s"), F.when(i >= F.col("window") - 1, F.greatest(acc["b"], s)).otherwise(acc["b"]).alias("b"))

    best = F.aggregate(F.sequence(F.lit(0), F.size("eq") - 1), zero, slide, lambda acc: acc["b"])
    return hits.select("doc_id", "row", "item_id", "window", _once(best).alias("matched"), need.alias("need")).where(F.col("matched") >= F.col("need")).drop("need")


def overlaps(docs: DataFrame, items: DataFrame, masks: Sequence[str] = MASKS, window: int = 20, least: float = 0.8, min_words: int = 5, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, seeds, matched, window)``: items of which a document has a window with at least ``least`` equal words.

    A window is ``window`` words, or the whole item if that is shorter; ``matched`` is the best window's number of
    equal words, ``seeds`` the hits that led to such a window. Every position of every whole text, however long, is
    looked up against every position of the items, with masks that leave no choice of substituted words without a hit.
    Items of fewer than ``min_words`` words, which are common in any prose, are found where they are a document's only
    words. The benchmark's seeds are broadcast up to ``broadcast_rows`` rows; beyond, hashes and places are shuffled.

    Null and empty texts and items have no overlaps; rows with the same id, or none, give one row per item. Ties need
    no order. Empty tables give an empty result.
    """
    found = _overlaps(docs, items, masks, window, least, min_words, broadcast_rows, id_col, text_col)
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("seeds"), F.max("matched").alias("matched"), F.first("window").alias("window"))


def decontaminate(docs: DataFrame, items: DataFrame, masks: Sequence[str] = MASKS, window: int = 20, least: float = 0.8, min_words: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with the columns it has, without the rows whose text overlaps with a benchmark item; see ``overlaps``.

    Null and empty texts stay, and so do null ids. Of rows with one id those go whose own text overlaps.
    """
    bad = _overlaps(docs, items, masks, window, least, min_words, broadcast_rows, "doc_id", "text").select(F.col("doc_id").alias("_bad"), F.col("row").alias("_row")).distinct()
    # the columns of docs are c0, c1, ... in here, so that no name of theirs meets one of these
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = docs.toDF(*own.values()).join(bad, (F.col(own["doc_id"]) == F.col("_bad")) & (F.xxhash64(own["text"]) == F.col("_row")), "left_anti")
    return out.toDF(*docs.columns)
